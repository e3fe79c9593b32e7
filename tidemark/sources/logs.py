"""Segments and levels from the text output of media filters, one row a line: (recording_id, line_no, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import SILENT_DB, decibels

# fixed values: the formats of the lines
BLACK = r"black_start:([\d.]+)\s+black_end:([\d.]+)\s+black_duration:([\d.]+)"
FREEZE = {"start": r"freeze_start:\s*([\d.]+)", "end": r"freeze_end:\s*([\d.]+)", "duration": r"freeze_duration:\s*([\d.]+)"}
SILENCE_START = r"silence_start:\s*(-?[\d.]+)"
SILENCE_END = r"silence_end:\s*(-?[\d.]+)\s*\|\s*silence_duration:\s*([\d.]+)"
FRAME = r"^frame:\d+\s+pts:\d+\s+pts_time:([\d.]+)"
LEVEL = r"^lavfi\.astats\.([\w.]+)=(.+)$"


def black_spans(text: Column) -> Column:
    """array<struct<start, end, duration>> of every black segment in a text."""
    part = lambda i: F.transform(F.regexp_extract_all(text, F.lit(BLACK), F.lit(i)), lambda x: x.cast("double"))
    return F.arrays_zip(part(1).alias("start"), part(2).alias("end"), part(3).alias("duration"))


def black_segments(lines: DataFrame) -> DataFrame:
    """(recording_id, kind, start, end, duration) of all black segments."""
    d = lines.where(F.col("line").contains("black_start")).select("recording_id", F.explode(black_spans(F.col("line"))).alias("s"))
    return d.select("recording_id", F.lit("black").alias("kind"), "s.start", "s.end", "s.duration")


def _numbered(lines: DataFrame, pattern: str, *names: str) -> DataFrame:
    """Every match of the pattern, numbered in its recording: (recording_id, i, *groups)."""
    cols = [F.regexp_extract_all("line", F.lit(pattern), F.lit(k + 1)).alias(n) for k, n in enumerate(names)]
    d = lines.where(F.col("line").rlike(pattern)).select("recording_id", "line_no", *cols)
    d = d.select("recording_id", "line_no", F.posexplode(F.arrays_zip(*names)).alias("p", "m"))
    order = Window.partitionBy("recording_id").orderBy("line_no", "p")
    return d.select("recording_id", F.row_number().over(order).alias("i"), *[F.col(f"m.{n}").cast("double").alias(n) for n in names])


def freeze_segments(lines: DataFrame) -> DataFrame:
    """Freezes: the i-th start with the i-th end and the i-th duration. A missing end follows from the
    duration and the other way round; a freeze with neither (it lasts to the end) is left out."""
    key = ["recording_id", "i"]
    d = _numbered(lines, FREEZE["start"], "start").join(_numbered(lines, FREEZE["end"], "end"), key, "left").join(_numbered(lines, FREEZE["duration"], "duration"), key, "left")
    d = d.withColumns({"end": F.coalesce("end", F.col("start") + F.col("duration")), "duration": F.coalesce("duration", F.col("end") - F.col("start"))})
    return d.where(F.col("end").isNotNull()).select("recording_id", F.lit("freeze").alias("kind"), "start", "end", "duration")


def silence_segments(lines: DataFrame) -> DataFrame:
    """Silences: the i-th start with the i-th end; a start without an end is left out. Starts may be negative."""
    d = _numbered(lines, SILENCE_START, "start").join(_numbered(lines, SILENCE_END, "end", "duration"), ["recording_id", "i"])
    return d.select("recording_id", F.lit("silence").alias("kind"), "start", "end", "duration")


def level_values(lines: DataFrame) -> DataFrame:
    """(recording_id, pts, key, value): each key=value line belongs to the last frame line before it; those before any are dropped.
    Of lines that repeat a key within a frame the last counts."""
    w = Window.partitionBy("recording_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    pts = F.nullif(F.regexp_extract("line", FRAME, 1), F.lit("")).cast("double")
    d = lines.withColumn("head", F.when(pts.isNotNull(), F.struct(F.col("line_no").alias("no"), pts.alias("pts"))))
    d = d.withColumn("head", F.last("head", ignorenulls=True).over(w)).where(F.col("line").rlike(LEVEL) & F.col("head").isNotNull())
    d = d.select("recording_id", "head", F.regexp_extract("line", LEVEL, 1).alias("key"), F.regexp_extract("line", LEVEL, 2).alias("value"), "line_no")
    d = d.groupBy("recording_id", "head", "key").agg(F.max_by("value", "line_no").alias("value"))
    return d.select("recording_id", F.col("head.pts").alias("pts"), F.col("head.no").alias("frame"), "key", "value")


def level_windows(lines: DataFrame, window: float = 0.5) -> DataFrame:
    """level_windows of the overall statistics in a log; a level that is missing is SILENT_DB, a missing flat factor 0."""
    of = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    frames = level_values(lines).groupBy("recording_id", "frame", "pts").agg(of("Overall.RMS_level").alias("r"), of("Overall.Peak_level").alias("p"), of("Overall.Flat_factor").alias("f"))
    order = Window.partitionBy("recording_id").orderBy("frame")
    known = lambda c: F.when(F.col(c).isNull(), SILENT_DB).otherwise(decibels(F.col(c)))
    return frames.select("recording_id", (F.row_number().over(order) - 1).alias("idx"), F.round(F.col("pts") * 1000).cast("long").alias("start_ms"), F.col("pts").alias("start"), (F.col("pts") + window).alias("end"), known("r").alias("rms_db"), known("p").alias("peak_db"), F.coalesce(F.col("f").try_cast("double"), F.lit(0.0)).alias("flat_factor"))


def channel_windows(lines: DataFrame, window: float = 0.5) -> DataFrame:
    """channel_windows of the statistics by channel in a log; channels without a level are absent."""
    d = level_values(lines).where(F.col("key").rlike(r"^\d+\.RMS_level$"))
    d = d.groupBy("recording_id", "frame", "pts").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.split("key", r"\.")[0].cast("int").alias("c"), decibels(F.col("value")).alias("v"))))).alias("channel_rms_db"))
    order = Window.partitionBy("recording_id").orderBy("frame")
    return d.select("recording_id", (F.row_number().over(order) - 1).alias("idx"), F.round(F.col("pts") * 1000).cast("long").alias("start_ms"), F.col("pts").alias("start"), (F.col("pts") + window).alias("end"), "channel_rms_db")
