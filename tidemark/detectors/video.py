"""Blackouts and freezes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.overlap import overlap_any
from ..schema import banded, facts, measurements
from .base import Signals


@dataclass
class Blackout:
    least: float = 0.10
    high: float = 2.0
    medium: float = 0.5
    name: str = "blackout"
    tier: int = 1
    requires: str = "video"

    def find(self, signals: Signals) -> DataFrame:
        d, t = signals.of("measured_segments", "has_video").where("kind = 'black'").where(F.col("duration") >= self.least), F.col("duration")
        return d.select("recording_id", "start", "end", F.lit("blackout").alias("type"), banded(t, self.high, self.medium).alias("severity"), F.lit("high").alias("confidence"), F.lit("blackout").alias("variant"), measurements(duration=t).alias("measurements"), facts(duration=t).alias("facts"))


@dataclass
class Freeze:
    """A freeze is judged by the sound meanwhile: active speaks for a static shot, silence for a stall."""

    least: float = 2.0
    high: float = 6.0
    floor_db: float = -40.0
    bucket: float = 10.0
    name: str = "freeze"
    tier: int = 1
    requires: str = "video (audio improves confidence)"

    def find(self, signals: Signals) -> DataFrame:
        d = signals.of("measured_segments", "has_video").where("kind = 'freeze'").where(F.col("duration") >= self.least)
        levels = signals.of("level_windows", "has_audio")
        d = overlap_any(d, levels, (F.col("rms_db") > self.floor_db) & ~F.isnan("rms_db"), self.bucket, out="active")
        d = d.join(levels.select("recording_id").distinct().withColumn("heard", F.lit(True)), "recording_id", "left")
        heard, t = F.coalesce("heard", F.lit(False)), F.col("duration")
        case = lambda alone, active, quiet: F.when(~heard, alone).when(F.col("active"), active).otherwise(quiet)
        long = F.when(t >= self.high, "high").otherwise("medium")
        return d.select("recording_id", "start", "end", F.lit("freeze").alias("type"), case(long, F.lit("low"), long).alias("severity"), case(F.lit("medium"), F.lit("low"), long).alias("confidence"), case(F.lit("freeze_alone"), F.lit("freeze_active"), F.lit("freeze_quiet")).alias("variant"), measurements(duration=t, audio_active_during=F.col("active")).alias("measurements"), facts(duration=t).alias("facts"))
