"""Joins of intervals, by a sweep over their ends or by equal keys of time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_buckets(df: DataFrame, start: Column, end: Column, width: float, out: str = "bucket") -> DataFrame:
    """df with a row for every bucket [i * width, (i + 1) * width) that [start, end) overlaps. Empty and null intervals have none."""
    first, last = F.floor(start / width).cast("long"), (F.ceil(end / width) - 1).cast("long")
    return df.where(start < end).withColumn(out, F.explode(F.sequence(first, F.greatest(first, last))))


def overlap_any(left: DataFrame, right: DataFrame, flag: Column, width: float, part: str = "recording_id", out: str = "any") -> DataFrame:
    """left with `out`: whether a row of right that overlaps it (end > start and start < end, both strict) has the flag; false without any.

    Both sides have part, start, end. One sweep in order of time tells: of the flagged rows that start before a
    row of left ends, the latest end must lie beyond its start. So an interval is one row on either
    side, however long it is. The sweep is cut into ranges of `width` seconds, each in a task of
    its own; what a range needs of those before it is their latest end, one number each. Empty and null intervals overlap nothing.
    """
    keys, range_ = [part, "start", "end"], lambda c: F.floor(F.col(c) / width).cast("long")
    asked = left.where(F.col("start") < F.col("end")).select(*keys).distinct().select(part, range_("end").alias("range"), F.col("end").alias("at"), F.lit(0).alias("side"), F.col("start"), F.lit(None).cast("double").alias("until"))
    told = right.where(flag & (F.col("start") < F.col("end"))).select(part, range_("start").alias("range"), F.col("start").cast("double").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("double").alias("start"), F.col("end").cast("double").alias("until"))
    # at one time the row of left comes first: what starts as it ends does not overlap it
    within = Window.partitionBy(part, "range").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(part).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    rows = asked.unionByName(told)
    carried = rows.groupBy(part, "range").agg(F.max("until").alias("latest")).withColumn("carried", F.max("latest").over(earlier)).drop("latest")
    swept = rows.withColumn("latest", F.max("until").over(within)).where("side = 0").join(carried, [part, "range"])
    hit = swept.where(F.greatest("latest", "carried") > F.col("start")).select(part, "start", F.col("at").alias("end")).withColumn(out, F.lit(True))
    return left.join(hit, keys, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def quiet_buckets(recordings: DataFrame, levels: DataFrame, activity: DataFrame, states: DataFrame, width: float = 2.0, quiet: float = -40.0, still: float = 20.0) -> DataFrame:
    """(recording_id, bucket, quiet) for every bucket of each recording with video: floor(duration / width) + 1 of them.

    A bucket is quiet if nothing in it speaks against that: no level above `quiet` (asked only of
    recordings with audio), no picture change above `still`, and one slide state at most. Three
    aggregates by bucket are joined to the buckets; each is on (recording, bucket).
    """
    spine = recordings.where(F.col("has_video") & (F.col("duration") > 0)).select("recording_id", "has_audio", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("duration") / width).cast("long"))).alias("bucket"))
    key = ["recording_id", "bucket"]
    # a level that isn't a number is not at or below the threshold
    loud = in_buckets(levels, F.col("start"), F.col("end"), width).groupBy(*key).agg(F.bool_or(F.isnan("rms_db") | (F.col("rms_db") > quiet)).alias("loud"))
    moved = activity.withColumn("bucket", F.floor(F.col("time") / width).cast("long")).groupBy(*key).agg((F.max("distance") > still).alias("moved"))
    changed = in_buckets(states, F.col("start"), F.col("end"), width).groupBy(*key).agg((F.count_distinct("state_id") > 1).alias("changed"))
    d = spine.join(loud, key, "left").join(moved, key, "left").join(changed, key, "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return d.select(*key, "has_audio", (no(F.col("moved")) & no(F.col("changed")) & (~F.col("has_audio") | no(F.col("loud")))).alias("quiet"))
