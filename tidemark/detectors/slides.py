"""Slide returns and brief slides, on recordings that look like presentations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import aspect_ratio
from ..operators import states
from ..schema import facts, measurements
from .base import Signals

#: A recording less wide, or less stable, is taken for no presentation. Fixed values.
ASPECT_LEAST, STABILITY_LEAST = 1.2, 0.35


def gate_reason(aspect: Column, stability: Column, least: float = STABILITY_LEAST) -> Column:
    """Why a recording is no presentation; null where nothing speaks against it. Unknown values never do."""
    narrow = F.format_string(f"content is not landscape (aspect ratio %.2f < {ASPECT_LEAST}); slide decks and screen shares are virtually always landscape, so this is very unlikely to be one.", aspect)
    restless = F.format_string(f"content does not look slide-like (stability ratio %.2f < {least}); this detector assumes long-held slide states and would otherwise flood the report on ordinary video.", stability)
    return F.when(aspect < ASPECT_LEAST, narrow).when(stability < least, restless)


def presentations(signals: Signals, least: float) -> DataFrame:
    """(recording_id, n_states, reason) of recordings with video."""
    s = states.stability(signals.slide_states())
    r = signals.recordings.where("has_video").select("recording_id", aspect_ratio(F.col("width"), F.col("height")).alias("aspect"))
    d = r.join(s, "recording_id", "left")
    return d.select("recording_id", F.coalesce("n_states", F.lit(0)).alias("n_states"), gate_reason(F.col("aspect"), F.col("stability"), least).alias("reason"))


@dataclass
class _Gated:
    stability_least: float = STABILITY_LEAST

    def gated(self, signals: Signals) -> DataFrame:
        fine = presentations(signals, self.stability_least).where(F.col("reason").isNull()).select("recording_id")
        return signals.slide_states().join(fine, "recording_id", "left_semi")

    def skipped(self, signals: Signals) -> DataFrame:
        d = presentations(signals, self.stability_least)
        return d.where(F.col("reason").isNotNull() & (F.col("n_states") >= self.states_least)).select("recording_id", "reason")


@dataclass
class SlideRollback(_Gated):
    brief: float = 2.0
    name: str = "slide_rollback_pattern"
    tier: int = 2
    requires: str = "video"
    states_least: int = 3

    def find(self, signals: Signals) -> DataFrame:
        d = states.rollbacks(self.gated(signals))
        long = lambda c: F.col(f"{c}.end") - F.col(f"{c}.start")
        d = d.withColumns({"d0": F.col("end") - F.col("start"), "d1": long("b"), "d2": long("a2"), "d3": long("b2")})
        short, again = F.col("d1") < self.brief, F.col("repeat")
        three = lambda a, b, c: F.array(a, b, c)
        ids = three(F.col("state_id"), F.col("b.state_id"), F.col("a2.state_id"))
        times = three(F.col("d0"), F.col("d1"), F.col("d2"))
        m = measurements(sequence=F.when(again, F.array_append(ids, F.col("b2.state_id"))).otherwise(ids), sequence_durations=F.when(again, F.array_append(times, F.col("d3"))).otherwise(times), first_intervening_duration=F.col("d1"), confirmed_repeat=again)
        variant = F.when(short & again, "rollback_confirmed").when(short, "rollback_brief").when(again, "rollback_long_repeat").otherwise("rollback_long")
        return d.select("recording_id", F.col("end").alias("start"), F.when(again, F.col("b2.start")).otherwise(F.col("a2.end")).alias("end"), F.lit(self.name).alias("type"), F.when(short, "medium").otherwise("low").alias("severity"), F.when(short & again, "medium").otherwise("low").alias("confidence"), variant.alias("variant"), m.alias("measurements"), facts(s0=F.col("state_id"), s1=F.col("b.state_id"), d0=F.col("d0"), d1=F.col("d1"), d2=F.col("d2"), d3=F.col("d3")).alias("facts"))


@dataclass
class BriefSlide(_Gated):
    most: float = 1.2
    name: str = "brief_unexpected_slide"
    tier: int = 2
    requires: str = "video"
    states_least: int = 2

    def find(self, signals: Signals) -> DataFrame:
        d, t = states.brief_states(self.gated(signals), self.most), F.col("duration")
        return d.select("recording_id", "start", "end", F.lit(self.name).alias("type"), F.lit("medium").alias("severity"), F.lit("low").alias("confidence"), F.lit("brief").alias("variant"), measurements(duration=t, previous_state=F.col("previous_state"), next_state=F.col("next_state")).alias("measurements"), facts(duration=t, state=F.col("state_id"), previous=F.col("previous_state"), next=F.col("next_state")).alias("facts"))
