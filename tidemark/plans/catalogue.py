"""Queries of the engine's operators over the driver's tables.

The tables hold no media, so events stand for signals: a user is a recording, a window is six
hours, its level the root mean square of values; an event's type is a slide state, and a channel.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import timeline as tl
from ..detectors.slides import gate_reason
from ..functions import hashing, scalar
from ..operators import overlap, quality, runs, states
from ..reporting.texts import LABELS
from ..schema import banded
from ..sources import logs

#: Seconds in a window, and the first moment of the events.
WINDOW, EPOCH = 21600, 1704067200

_MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    d = _read(spark, sf, "events")
    return d.select(F.col("user_id").cast("string").alias("recording_id"), "event_id", "event_type", "value", F.expr(f"{_MICROS} div 1000").alias("ms"))


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    return levels_of(_events(spark, sf))


def levels_of(events: DataFrame) -> DataFrame:
    d = events.withColumn("idx", F.expr(f"ms div {WINDOW * 1000}"))
    d = d.groupBy("recording_id", "idx").agg(F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rms_db"), F.max("value").alias("peak_db"), F.count_if(F.col("value") >= 100).cast("double").alias("flat_factor"))
    start = F.col("idx") * F.lit(float(WINDOW))
    return d.select("recording_id", "idx", (F.col("idx") * WINDOW * 1000).alias("start_ms"), start.alias("start"), (start + WINDOW).alias("end"), "rms_db", "peak_db", "flat_factor")


def _channels(spark: SparkSession, sf: str) -> DataFrame:
    return channels_of(_events(spark, sf))


def channels_of(events: DataFrame) -> DataFrame:
    d = events.withColumn("idx", F.expr("ms div 86400000"))
    return d.groupBy("recording_id", "idx", "event_type").agg(F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("level"))


def _channel_windows(spark: SparkSession, sf: str) -> DataFrame:
    return channel_windows_of(_channels(spark, sf))


def channel_windows_of(channels: DataFrame) -> DataFrame:
    d = channels.groupBy("recording_id", "idx").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "level"))).alias("channel_rms_db"))
    start = F.col("idx") * F.lit(86400.0)
    return d.select("recording_id", "idx", (F.col("idx") * 86400000).alias("start_ms"), start.alias("start"), (start + 86400).alias("end"), "channel_rms_db")


def _states(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of one event type: pos from 0; each ends where the next begins, the last at its last event."""
    d = runs.label_runs(_events(spark, sf), ["recording_id"], ["ms", "event_id"], F.col("event_type"))
    d = d.groupBy("recording_id", "run", F.col("label").alias("state_id")).agg(F.min("ms").alias("start_ms"), F.max("ms").alias("last_ms"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("recording_id").orderBy("run")
    end = F.coalesce(F.lead("start_ms").over(w), F.col("last_ms"))
    return d.select("recording_id", (F.row_number().over(w) - 1).alias("pos"), "state_id", "start_ms", end.alias("end_ms"), (F.col("start_ms") / 1000).alias("start"), (end / 1000).alias("end"), "n")


def level_envelope(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf).drop("start_ms")


def clipping_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs.clipping_runs(_levels(spark, sf), 150.0, 1.0, 0.0)


def _dropouts(spark: SparkSession, sf: str) -> DataFrame:
    return runs.dropouts(_levels(spark, sf), 20.0, 30.0, WINDOW, 6 * WINDOW, 2 * WINDOW * 1000)


def dropout_context(spark: SparkSession, sf: str) -> DataFrame:
    return _dropouts(spark, sf).withColumn("severity", banded(F.col("duration"), 2.0 * WINDOW))


def channel_levels(spark: SparkSession, sf: str) -> DataFrame:
    return _channels(spark, sf)


def channel_classify(spark: SparkSession, sf: str) -> DataFrame:
    return _channel_windows(spark, sf).select("recording_id", "idx", runs.channel_label(F.col("channel_rms_db"), 40.0, 10.0, 12.0).alias("label"))


def channel_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs.channel_runs(_channel_windows(spark, sf), 40.0, 10.0, 12.0, 2 * 86400.0).drop("channel_rms_db")


def state_runs(spark: SparkSession, sf: str) -> DataFrame:
    return _states(spark, sf).drop("start", "end")


def rollback_pattern(spark: SparkSession, sf: str) -> DataFrame:
    d = states.rollbacks(_states(spark, sf))
    again = F.col("repeat")
    return d.select("recording_id", "pos", "state_id", F.col("b.state_id").alias("other_state"), F.col("end").alias("start"), F.when(again, F.col("b2.start")).otherwise(F.col("a2.end")).alias("end"), again.alias("confirmed_repeat"))


def brief_states(spark: SparkSession, sf: str) -> DataFrame:
    return states.brief_states(_states(spark, sf), 4320.0).select("recording_id", "pos", "state_id", "previous_state", "next_state", F.round("duration", 3).alias("duration"))


def stability_ratio(spark: SparkSession, sf: str) -> DataFrame:
    d = states.stability(_states(spark, sf), 7200.0)
    return d.select("recording_id", F.round("stability", 6).alias("stability"), "n_states")


def presentation_gate(spark: SparkSession, sf: str) -> DataFrame:
    d = states.stability(_states(spark, sf), 6 * 3600.0).withColumn("aspect", (F.pmod(F.col("recording_id").cast("long"), F.lit(3)) + 1) * F.lit(0.7))
    return d.select("recording_id", F.regexp_extract(F.coalesce(gate_reason(F.col("aspect"), F.col("stability"), 0.9), F.lit("")), "(not landscape|not look slide-like)", 1).alias("gate"))


def severity_bands(spark: SparkSession, sf: str) -> DataFrame:
    d = _states(spark, sf).withColumn("severity", banded(F.col("end") - F.col("start"), 86400.0, 21600.0))
    return d.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"))


def freeze_audio_overlap(spark: SparkSession, sf: str) -> DataFrame:
    long = _states(spark, sf).where(F.col("end") - F.col("start") >= 6 * 3600).select("recording_id", "start", "end")
    return overlap.overlap_any(long, _levels(spark, sf), F.col("rms_db") > 100.0, 86400.0, out="audio_active")


def persistent_peak_runs(spark: SparkSession, sf: str) -> DataFrame:
    d = _events(spark, sf).select("recording_id", (F.col("ms") / 1000).alias("time"), F.col("value").alias("dominant_freq"), F.col("value").alias("concentration"), F.lit(1.0).alias("rms"))
    out = runs.peak_runs(d, 7200.0, 20.0, 0.5, 80.0, 10800.0)
    return out.select("recording_id", "start", "end", F.round("dominant_frequency_hz", 6).alias("dominant_frequency_hz"), "max_concentration", "n")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    d = _read(spark, sf, "embeddings")
    return d.select("vec_id", "label", hashing.average_hash(F.col("embedding")).alias("hash"), F.lit(0).alias("bucket"))


def average_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).select("vec_id", F.lpad(F.bin(F.col("hash")[0]), 64, "0").alias("bits"))


def hamming_pairs(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    w = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("hash").alias("other"))
    return v.join(w, "vec_id").select("vec_id", hashing.hamming(F.col("hash"), F.col("other")).alias("distance"))


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).select((F.col("label") % 4).cast("string").alias("recording_id"), F.col("vec_id").cast("double").alias("time"), "hash", "bucket")


def visual_activity(spark: SparkSession, sf: str) -> DataFrame:
    return states.visual_activity(_frames(spark, sf))


def anchor_segments(spark: SparkSession, sf: str) -> DataFrame:
    return states.anchor_segments(_frames(spark, sf), 30, 1.0).select("recording_id", "pos", "start", "end", "sample_count", "max_internal_distance")


def online_states(spark: SparkSession, sf: str) -> DataFrame:
    return states.online_states(states.anchor_segments(_frames(spark, sf), 30, 1.0), 24)


def _shifted(d: DataFrame) -> DataFrame:
    return d.withColumns({"start": F.col("start") - EPOCH, "end": F.col("end") - EPOCH})


def progress_buckets(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    rec = e.groupBy("recording_id").agg((F.max("ms") / 1000 - EPOCH).alias("duration")).withColumns({"has_video": F.lit(True), "has_audio": F.lit(True)})
    w = Window.partitionBy("recording_id").orderBy("ms", "event_id")
    moved = e.withColumn("distance", F.abs(F.col("value") - F.lag("value").over(w))).where("distance IS NOT NULL").select("recording_id", (F.col("ms") / 1000 - EPOCH).alias("time"), "distance")
    b = overlap.quiet_buckets(rec, _shifted(_levels(spark, sf)), moved, _shifted(_states(spark, sf)), 43200.0, 60.0, 60.0)
    d = runs.label_runs(b, ["recording_id"], ["bucket"], F.when(F.col("quiet"), "quiet")).groupBy("recording_id", "run").agg(F.min("bucket").alias("first_bucket"), F.count(F.lit(1)).alias("n"))
    return d.where("n >= 2").drop("run")


def metadata_diff(spark: SparkSession, sf: str) -> DataFrame:
    l = _read(spark, sf, "lineitem")
    stats = l.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").cast("long").alias("max_qty"), F.round(F.min("l_discount") * 100).cast("long").alias("min_disc")).withColumn("pair_id", F.lit(1))
    of = lambda f: stats.where(F.col("l_returnflag") == f)
    return quality.diff_fields(of("R"), of("N"), ["pair_id"], ["n", "max_qty", "min_disc"])


def _prices(spark: SparkSession, sf: str, *key: str) -> DataFrame:
    l = _read(spark, sf, "lineitem")
    return quality.frame_quality(l.select(*key, F.col("l_linenumber").alias("frame"), F.col("l_extendedprice").alias("a"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("b")), list(key), 100000.0)


def psnr_compare(spark: SparkSession, sf: str) -> DataFrame:
    d = _prices(spark, sf, "l_returnflag", "l_linestatus")
    return d.select("l_returnflag", "l_linestatus", *[F.round(c, 4).alias(c) for c in ("psnr_avg_db", "psnr_min_db", "ssim_avg")])


def quality_classify(spark: SparkSession, sf: str) -> DataFrame:
    d = _prices(spark, sf, "l_returnflag")
    return d.select("l_returnflag", F.round("psnr_avg_db", 4).alias("psnr_avg_db"), quality.conclusion(F.lit(True), F.col("ssim_avg"), F.col("psnr_avg_db"), 0.5, 29.0).alias("conclusion"))


def _timeline(spark: SparkSession, sf: str) -> DataFrame:
    kind = lambda d, t, c, o, s: d.select("recording_id", "start", "end", F.lit(t).alias("type"), F.lit(c).alias("category"), s.alias("severity"), F.lit(o).alias("detector_ord"), F.lit(0).alias("seq_in_detector"))
    span = F.col("end") - F.col("start")
    parts = [
        kind(clipping_runs(spark, sf), "clipping", "audio", 0, banded(span, 3.0 * WINDOW)),
        kind(_dropouts(spark, sf), "possible_audio_dropout", "audio", 1, banded(span, 2.0 * WINDOW)),
        kind(states.brief_states(_states(spark, sf), 4320.0), "brief_unexpected_slide", "presentation", 2, F.lit("medium")),
        kind(rollback_pattern(spark, sf), "slide_rollback_pattern", "presentation", 3, F.lit("low")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def unified_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return tl.ordered(_timeline(spark, sf)).drop("seq_in_detector")


def summary_rollup(spark: SparkSession, sf: str) -> DataFrame:
    d = tl.summary(_timeline(spark, sf))
    return d.select("recording_id", "total_events", *[F.col("by_severity")[s].alias(f"n_{s}") for s in ("low", "medium", "high")], *[F.coalesce(F.col("by_category")[c], F.lit(0)).alias(f"n_{c}") for c in ("audio", "presentation")])


def timeline_filter(spark: SparkSession, sf: str) -> DataFrame:
    return tl.filtered(_timeline(spark, sf), "audio", "medium").select("recording_id", "start", "end", "type", "severity")


def evidence_plan(spark: SparkSession, sf: str) -> DataFrame:
    return tl.evidence_plan(_timeline(spark, sf).withColumn("id", F.lit("")), "high").drop("id")


def batch_index(spark: SparkSession, sf: str) -> DataFrame:
    n = tl.summary(_timeline(spark, sf))
    rec = _events(spark, sf).groupBy("recording_id").agg(((F.max("ms") - F.min("ms")) / 1000).alias("duration"))
    d = rec.join(n, "recording_id", "left")
    return d.select("recording_id", "duration", F.coalesce("total_events", F.lit(0)).alias("total"), *[F.coalesce(F.col("by_severity")[s], F.lit(0)).alias(s) for s in ("high", "medium", "low")])


def nearest_frame(spark: SparkSession, sf: str) -> DataFrame:
    plan = tl.evidence_plan(_timeline(spark, sf).withColumn("id", F.lit("")), "high").select("recording_id", "incident", "event_at")
    frames = _events(spark, sf).select("recording_id", F.col("event_id").cast("int").alias("idx"), (F.col("ms") / 1000).alias("time"))
    return tl.nearest_frames(plan, frames, "event_at")


def timestamp_format(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("event_id", scalar.timestamp_text(F.col("value") * 371.25).alias("at"))


def slugify(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "pages").select("page_id", scalar.slug(F.col("url")).alias("slug"))


def i18n_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(k, lang, v[i]) for k, v in LABELS["severity"].items() for i, lang in enumerate(("en", "ja"))]
    labels = spark.createDataFrame(rows, "severity string, lang string, label string")
    want = _timeline(spark, sf).groupBy("type", "severity").agg(F.count(F.lit(1)).alias("n")).withColumn("lang", F.explode(F.array(F.lit("ja"), F.lit("fr"))))
    own = want.join(F.broadcast(labels), ["severity", "lang"], "left")
    english = labels.where("lang = 'en'").select("severity", F.col("label").alias("__en"))
    return own.join(F.broadcast(english), "severity", "left").select("type", "severity", "lang", "n", F.coalesce("label", "__en", "severity").alias("label"))


def parse_segment_log(spark: SparkSession, sf: str) -> DataFrame:
    line = F.format_string("[black @ 0x1] black_start:%d.25 black_end:%d.75 black_duration:%d.5", F.col("event_id"), F.col("event_id") + F.length("event_type"), F.length("event_type"))
    return logs.black_segments(_events(spark, sf).select("recording_id", F.col("event_id").alias("line_no"), line.alias("line")))


def parse_level_log(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    text = F.array(F.format_string("frame:%d pts:%d pts_time:%d.5", F.col("event_id"), F.col("event_id"), F.col("event_id")), F.format_string("lavfi.astats.Overall.RMS_level=-%d.25", F.length("event_type")), F.when(F.col("event_id") % 3 == 0, F.lit("lavfi.astats.Overall.Peak_level=-inf")).otherwise(F.lit("lavfi.astats.Overall.Peak_level=-1.5")))
    lines = e.select("recording_id", "event_id", F.posexplode(text).alias("p", "line")).withColumn("line_no", F.col("event_id") * 10 + F.col("p"))
    return logs.level_windows(lines.select("recording_id", "line_no", "line")).drop("idx")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        level_envelope, clipping_runs, dropout_context, channel_levels, channel_classify, channel_runs, state_runs, rollback_pattern, brief_states, stability_ratio,
        presentation_gate, severity_bands, freeze_audio_overlap, persistent_peak_runs, average_hash, hamming_pairs, visual_activity, anchor_segments, online_states,
        progress_buckets, metadata_diff, psnr_compare, quality_classify, unified_timeline, summary_rollup, timeline_filter, evidence_plan, batch_index, nearest_frame,
        timestamp_format, slugify, i18n_labels, parse_segment_log, parse_level_log,
    )
}
