"""Long stretches in which nothing moves, sounds or changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.overlap import quiet_buckets
from ..operators.runs import label_runs
from ..schema import banded, facts, measurements
from .base import Signals


@dataclass
class ProgressionInterruption:
    """A run of quiet buckets. The last bucket may reach beyond the recording; clamp_end cuts the event there."""

    least: float = 30.0
    quiet_db: float = -40.0
    still: float = 20.0
    bucket: float = 2.0
    clamp_end: bool = False
    name: str = "progression_interruption"
    tier: int = 2
    requires: str = "video"

    def find(self, signals: Signals) -> DataFrame:
        b = quiet_buckets(signals.recordings, signals.of("level_windows", "has_audio"), signals.visual_activity, signals.slide_states(), self.bucket, self.quiet_db, self.still)
        d = label_runs(b, ["recording_id"], ["bucket"], F.when(F.col("quiet"), "quiet")).groupBy("recording_id", "run").agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"), F.first("has_audio").alias("has_audio"))
        d = d.withColumns({"start": F.col("first") * self.bucket, "end": (F.col("last") + 1) * self.bucket})
        if self.clamp_end:
            d = d.join(signals.recordings.select("recording_id", F.col("duration").alias("__d")), "recording_id").withColumn("end", F.least("end", "__d"))
        d, t = d.withColumn("duration", F.col("end") - F.col("start")), F.col("duration")
        heard = F.col("has_audio")
        return d.where(t >= self.least).select("recording_id", "start", "end", F.lit(self.name).alias("type"), banded(t, 3 * self.least).alias("severity"), F.when(heard, "medium").otherwise("low").alias("confidence"), F.when(heard, "progress_audio").otherwise("progress_alone").alias("variant"), measurements(duration=t).alias("measurements"), facts(duration=t).alias("facts"))
