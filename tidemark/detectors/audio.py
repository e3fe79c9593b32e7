"""Clipping, dropouts, channel faults and feedback."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import runs
from ..schema import banded, facts, measurements
from .base import Signals


@dataclass
class Clipping:
    peak: float = -1.0
    flat: float = 0.5
    least: float = 0.2
    high: float = 3.0
    name: str = "clipping"
    tier: int = 1
    requires: str = "audio"

    def find(self, signals: Signals) -> DataFrame:
        d, t = signals.only(runs.clipping_runs(signals.level_windows, self.peak, self.flat, self.least), "has_audio"), F.col("duration")
        return d.select("recording_id", "start", "end", F.lit("clipping").alias("type"), banded(t, self.high).alias("severity"), F.lit("high").alias("confidence"), F.lit("clipping").alias("variant"), measurements(duration=t, max_peak_db=F.col("max_peak_db"), max_flat_factor=F.col("max_flat_factor")).alias("measurements"), facts(duration=t, peak=F.col("max_peak_db"), flat=F.col("max_flat_factor")).alias("facts"))


@dataclass
class Dropout:
    active: float = -35.0
    quiet: float = -45.0
    least: float = 0.4
    most: float = 6.0
    context: float = 2.0
    high: float = 2.0
    name: str = "audio_dropout"
    tier: int = 2
    requires: str = "audio"

    def find(self, signals: Signals) -> DataFrame:
        d, t = signals.only(runs.dropouts(signals.level_windows, self.quiet, self.active, self.least, self.most, round(self.context * 1000)), "has_audio"), F.col("duration")
        return d.select("recording_id", "start", "end", F.lit("possible_audio_dropout").alias("type"), banded(t, self.high).alias("severity"), F.lit("medium").alias("confidence"), F.lit("dropout").alias("variant"), measurements(duration=t).alias("measurements"), facts(duration=t, level=F.col("first_level"), context=F.lit(self.context)).alias("facts"))


@dataclass
class ChannelImbalance:
    active: float = -40.0
    missing: float = -55.0
    gap: float = 12.0
    least: float = 1.0
    high: float = 5.0
    name: str = "channel_imbalance"
    tier: int = 1
    requires: str = "audio (multi-channel)"

    def find(self, signals: Signals) -> DataFrame:
        several = signals.recordings.where("channels >= 2").select("recording_id")
        d = runs.channel_runs(signals.channel_windows, self.active, self.missing, self.gap, self.least).join(several, "recording_id", "left_semi")
        t, lost = F.col("duration"), F.col("label") == "missing"
        kind = F.concat(F.lit("channel_"), F.col("label"))
        return d.select("recording_id", "start", "end", kind.alias("type"), F.when(lost, banded(t, self.high)).otherwise("low").alias("severity"), F.when(lost, "medium").otherwise("low").alias("confidence"), kind.alias("variant"), measurements(duration=t, channel_rms_db=F.col("channel_rms_db")).alias("measurements"), facts(duration=t).alias("facts"))

    def skipped(self, signals: Signals) -> DataFrame:
        few = signals.recordings.where("coalesce(channels, 0) < 2")
        return few.select("recording_id", F.format_string("input has %d audio channel(s); channel-imbalance detection needs at least 2.", F.coalesce("channels", F.lit(0))).alias("reason"))


@dataclass
class Feedback:
    """Experimental; in no profile unless asked for."""

    hop: float = 0.25
    concentration: float = 0.45
    rms: float = 0.02
    jump: float = 80.0
    least: float = 1.0
    sure: float = 0.6
    name: str = "feedback_howling_experimental"
    tier: int = 3
    requires: str = "audio (numpy)"

    def find(self, signals: Signals) -> DataFrame:
        d = signals.only(runs.peak_runs(signals.spectral_windows, self.hop, self.concentration, self.rms, self.jump, self.least), "has_audio")
        t, c, f = F.col("duration"), F.col("max_concentration"), F.col("dominant_frequency_hz")
        return d.select("recording_id", "start", "end", F.lit("possible_feedback_howling").alias("type"), F.lit("medium").alias("severity"), F.when(c >= self.sure, "medium").otherwise("low").alias("confidence"), F.lit("feedback").alias("variant"), measurements(duration=t, dominant_frequency_hz=f, max_concentration=c).alias("measurements"), facts(duration=t, frequency=f, concentration=c).alias("facts"))
