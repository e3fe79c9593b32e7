"""Queries that run the product itself: sources, detectors, reports and comparison, over signals made of the driver's tables.

An event's type is what a frame shows and a channel; its value is a level, a length and a
frequency. Texts stand for raw frames and samples, orders for probe documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import detectors as d
from .. import timeline as tl
from ..detectors.base import Signals
from ..operators import levels, spectral
from ..operators import quality as q
from ..reporting import documents
from ..sources import logs, media, probe
from . import analysis, catalogue, comparison
from .catalogue import EPOCH, WINDOW


def _relative(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue._events(spark, sf).withColumn("ms", F.col("ms") - EPOCH * 1000)


def _number(c: str = "recording_id") -> Column:
    return F.col(c).cast("long")


#: Pictures of 1024 bits for the types of events, far apart from one another.
_TYPES = ("click", "error", "purchase", "signup", "view")


def _type_number() -> Column:
    """An event's type as a number from 1; 0 for others."""
    out = F.lit(0)
    for i, t in enumerate(_TYPES):
        out = F.when(F.col("event_type") == t, i + 1).otherwise(out)
    return out


def _picture() -> Column:
    words = lambda k: F.array(*[F.lit(-1 if i % len(_TYPES) == k else 0).cast("long") for i in range(16)])
    out = F.array(*[F.lit(0x5555).cast("long")] * 16)
    for k, t in enumerate(_TYPES):
        out = F.when(F.col("event_type") == t, words(k)).otherwise(out)
    return out


def signals(spark: SparkSession, sf: str) -> Signals:
    """Signals of every user's events, in seconds since the first day."""
    e = _relative(spark, sf)
    n, time = _number(), F.col("ms") / 1000
    rec = e.groupBy("recording_id").agg((F.max("ms") / 1000).alias("duration"))
    wide = n % 3 != 0
    rec = rec.select("recording_id", F.concat(F.lit("/media/"), "recording_id").alias("path"), "duration", (n % 7 != 0).alias("has_video"), (n % 11 != 0).alias("has_audio"), F.when(wide, 1280).otherwise(360).alias("width"), F.when(wide, 720).otherwise(640).alias("height"), F.when(n % 11 != 0, 5).otherwise(0).alias("channels"), F.lit(25.0).alias("frame_rate"), F.lit(None).cast("string").alias("error"))
    length = F.when(F.col("event_type") == "error", F.col("value") / 100).when(F.col("event_type") == "signup", F.col("value") / 10)
    kind = F.when(F.col("event_type") == "error", "black").otherwise("freeze")
    return Signals(spark, {
        "recordings": rec,
        "level_windows": catalogue.levels_of(e),
        "channel_windows": catalogue.channel_windows_of(catalogue.channels_of(e).withColumn("event_type", _type_number())),
        "frame_samples": e.select("recording_id", F.col("event_id").cast("int").alias("idx"), F.col("ms").alias("time_ms"), time.alias("time"), _picture().alias("hash"), F.lit(3).alias("bucket")),
        "measured_segments": e.where(length.isNotNull()).select("recording_id", kind.alias("kind"), time.alias("start"), (time + length).alias("end"), length.alias("duration")),
        "spectral_windows": e.select("recording_id", time.alias("time"), F.col("value").alias("dominant_freq"), F.col("value").alias("concentration"), F.lit(1.0).alias("rms")),
    })


def _detectors() -> list:
    day = 86400.0
    return [
        d.Blackout(), d.Freeze(floor_db=60.0, bucket=WINDOW), d.Clipping(150.0, 1.0, 0.0, 3.0 * WINDOW), d.ChannelImbalance(40.0, 10.0, 12.0, 2 * day, 5 * day),
        d.ProgressionInterruption(day, 60.0, 400.0, 43200.0), d.Dropout(30.0, 20.0, WINDOW, 6 * WINDOW, 2 * WINDOW, 2.0 * WINDOW),
        d.SlideRollback(brief=20000.0), d.BriefSlide(most=4320.0), d.Feedback(7200.0, 20.0, 0.5, 80.0, 10800.0, 100.0),
    ]


def _result(spark: SparkSession, sf: str) -> analysis.Result:
    return analysis.analyze(signals(spark, sf), chosen=_detectors())


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 5) for c in columns})


def analysis_events(spark: SparkSession, sf: str) -> DataFrame:
    e = _rounded(_result(spark, sf).events, "start", "end")
    return e.select("recording_id", "start", "end", "type", "category", "severity", "confidence", "detector", "requires_human_review")


def analysis_limitations(spark: SparkSession, sf: str) -> DataFrame:
    return _result(spark, sf).limitations


def analysis_index(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.batch_index(_result(spark, sf)).drop("error")


def analysis_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = tl.summary(_result(spark, sf).events)
    return s.select("recording_id", "total_events", *[F.coalesce(F.col("by_category")[c], F.lit(0)).alias(c) for c in ("video", "audio", "presentation", "progress")])


def analysis_texts(spark: SparkSession, sf: str) -> DataFrame:
    """What every event says, in both languages; events are found once."""
    said = lambda lang: F.struct(F.lit(lang).alias("lang"), F.concat_ws("\n", "observations").alias("observations"), F.col("possible_interpretation").alias("interpretation"))
    e = tl.with_texts(_result(spark, sf).events.withColumn("en", said("en")), "ja")
    return e.select("recording_id", "type", F.round("start", 3).alias("start"), F.inline(F.array("en", said("ja"))))


def analysis_explained(spark: SparkSession, sf: str) -> DataFrame:
    """Every event in a few lines of plain text."""
    return tl.explained(_result(spark, sf).events, "type", F.round("start", 3).alias("start")).drop("id")


def analysis_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Whole Markdown reports, in both languages."""
    return documents.reports_in(_result(spark, sf), ("en", "ja")).select("recording_id", "lang", "markdown")


_JSON_EVENT = "type string, category string, severity string, confidence string, detector string, requires_human_review boolean, start double, end double, duration double, start_timestamp string, end_timestamp string, observations array<string>, possible_interpretation string, source_files array<string>"


def analysis_json(spark: SparkSession, sf: str) -> DataFrame:
    """The events of the JSON reports, read back in their order."""
    held = documents.reports(_result(spark, sf)).select("recording_id", F.from_json("json", f"events array<struct<{_JSON_EVENT.replace(' ', ':').replace(',:', ',')}>>").alias("report"))
    e = held.select("recording_id", F.posexplode("report.events").alias("pos", "e")).select("recording_id", "pos", "e.*")
    lines = lambda c: F.concat_ws("\n", c)
    return e.withColumns({"observations": lines("observations"), "source_files": lines("source_files")}).withColumnRenamed("possible_interpretation", "interpretation")


def analysis_reports(spark: SparkSession, sf: str) -> DataFrame:
    """What the reports of each recording hold, read back from their texts."""
    r = documents.reports(_result(spark, sf))
    of = lambda path: F.get_json_object("json", path)
    many = lambda text, sign: (F.size(F.split(text, sign)) - 1)
    return r.select(
        "recording_id", of("$.media.path").alias("path"), of("$.summary.total_events").cast("long").alias("total_events"), of("$.summary.by_severity.high").cast("long").alias("high"),
        many(F.col("json"), '"start_timestamp"').cast("long").alias("in_json"),
        many(F.col("markdown"), "\n### ").cast("long").alias("in_markdown"), many(F.col("html"), 'class="finding"').cast("long").alias("in_html"), F.coalesce(of("$.events[0].start_timestamp"), F.lit("")).alias("first"),
    )


def incident_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Level windows that lie in the clips of grave events."""
    s = signals(spark, sf)
    events = analysis.analyze(s, chosen=[d.Clipping(150.0, 1.0, 0.0, 3.0 * WINDOW), d.Dropout(30.0, 20.0, WINDOW, 6 * WINDOW, 2 * WINDOW, 2.0 * WINDOW)]).events
    return tl.clip_rows(s.level_windows, tl.evidence_plan(events, "high")).select("recording_id", "incident", "start", "rms_db")


def slide_states(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(signals(spark, sf).slide_states(), "start", "end").select("recording_id", "pos", "start", "end", "state_id", "sample_count")


# sources


def _probed(spark: SparkSession, sf: str) -> DataFrame:
    o = catalogue._read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))
    k = F.col("k")
    video = F.format_string('{"codec_type":"video","codec_name":"h264","width":%d,"height":%d,"avg_frame_rate":"%s","r_frame_rate":"25/1","pix_fmt":"%s"}', 320 * (k % 4 + 1), 180 * (k % 3 + 1), F.when(k % 6 == 0, "").when(k % 6 == 1, "0/0").otherwise("30000/1001"), F.when(k % 4 == 0, "yuv422p").otherwise("yuv420p"))
    audio = F.format_string('{"codec_type":"audio","channels":%d}', k % 3)
    json = F.format_string('{"format":{"duration":"%s","format_name":"mp4","bit_rate":"%d"},"streams":[%s]}', F.when(k % 8 == 0, "N/A").otherwise(F.concat((k % 1000).cast("string"), F.lit(".5"))), F.floor("p"), F.concat_ws(",", F.when(k % 5 != 1, video), F.when(k % 5 != 2, audio)))
    docs = o.select(k.cast("string").alias("recording_id"), F.concat(F.lit("/in/"), k.cast("string")).alias("path"), F.when(k % 5 == 0, "no document").otherwise(json).alias("json"))
    return probe.recordings(docs)


def probe_recordings(spark: SparkSession, sf: str) -> DataFrame:
    r = _probed(spark, sf)
    return r.select("recording_id", F.col("error").isNotNull().alias("failed"), "duration", F.coalesce("bitrate", F.lit(-1)).alias("bitrate"), "has_video", "has_audio", F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height"), "channels", F.round("frame_rate", 6).alias("frame_rate"), "resolution", F.round("aspect", 6).alias("aspect"), "pix_fmt")


def _log(spark: SparkSession, sf: str, *lines: Column) -> DataFrame:
    e = catalogue._events(spark, sf)
    text = e.select("recording_id", "event_id", F.posexplode(F.filter(F.array(*lines), lambda x: x.isNotNull())).alias("p", "line"))
    return text.select("recording_id", (F.col("event_id") * 10 + F.col("p")).alias("line_no"), "line")


def freeze_log(spark: SparkSession, sf: str) -> DataFrame:
    """Every freeze has a start; of recordings of even number a duration and no end, of others an end and no duration, but for some."""
    i, n = F.col("event_id"), _number()
    return logs.freeze_segments(_log(spark, sf, F.format_string("[freezedetect] lavfi.freezedetect.freeze_start: %d.25", i), F.when(n % 2 == 0, F.format_string("lavfi.freezedetect.freeze_duration: %d.5", F.length("event_type"))), F.when((n % 2 == 1) & (n % 5 != 0), F.format_string("lavfi.freezedetect.freeze_end: %d.75", i + 3))))


def silence_log(spark: SparkSession, sf: str) -> DataFrame:
    i, n = F.col("event_id"), _number()
    return logs.silence_segments(_log(spark, sf, F.format_string("[silencedetect] silence_start: %s%d.5", F.when(i % 3 == 0, "-").otherwise(""), i), F.when(n % 4 != 0, F.format_string("[silencedetect] silence_end: %d.5 | silence_duration: %d.0", i + 7, F.length("event_type")))))


def channel_log(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    w = logs.channel_windows(_log(spark, sf, F.format_string("frame:%d pts:%d pts_time:%d.25", i, i, i), F.format_string("lavfi.astats.2.RMS_level=-%d.5", F.length("event_type")), F.when(i % 2 == 0, F.lit("lavfi.astats.1.RMS_level=-inf")), F.lit("lavfi.astats.Overall.RMS_level=-20.0")))
    return w.select("recording_id", "idx", "start_ms", "start", "end", F.explode("channel_rms_db").alias("channel", "level"))


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue._read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("recording_id"), F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("content"))


def raw_frames(spark: SparkSession, sf: str) -> DataFrame:
    s = media.frame_samples(media.frame_pixels(_raw(spark, sf)))
    bits = F.array_join(F.transform("hash", lambda w: F.lpad(F.bin(w), 64, "0")), "")
    return s.select("recording_id", "idx", "time_ms", "time", F.md5(bits.cast("binary")).alias("hash_md5"), "bucket")


def still_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of frames that differ little from the one before."""
    frames = media.frame_pixels(_raw(spark, sf), grid=8)
    return media.measured_segments(media.still_frames(frames, -22.0), "freeze", 1.0)


def sample_levels(spark: SparkSession, sf: str) -> DataFrame:
    w = levels.block_levels(media.pcm_blocks(_raw(spark, sf), rate=100, block=1000), 0.5)
    return w.select("recording_id", "idx", "start_ms", "start", "end", *[F.round(c, 6).alias(c) for c in ("rms_db", "peak_db", "flat_factor")])


def channel_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Levels by day and channel; one that is silent all day has the logarithm of 0, as in SQL."""
    w = levels.channel_envelope(_relative(spark, sf).select("recording_id", _type_number().alias("channel"), (F.col("ms") / 1000).alias("time"), (F.col("value") / 500).alias("value")), 86400.0, silent=float("-inf"))
    return w.select("recording_id", "idx", "start", "end", F.explode("channel_rms_db").alias("channel", "level")).withColumn("level", F.round("level", 6))


def spectral_peaks(spark: SparkSession, sf: str) -> DataFrame:
    s = spectral.spectral_windows(media.pcm_blocks(_raw(spark, sf), rate=256, block=1000), 256, 1.0, 1.0, 20.0, 30.0)
    return s.select("recording_id", "time", *[F.round(c, 4).alias(c) for c in ("dominant_freq", "concentration", "rms")])


# comparison


def compare_exports(spark: SparkSession, sf: str) -> DataFrame:
    """Each order with the next one as its export; every third pair has metrics."""
    r = _probed(spark, sf).withColumn("k", _number())
    fields = F.struct("path", "resolution", "frame_rate", "codec_name", "pix_fmt", "bits_per_raw_sample", "color_space", "color_transfer", "bitrate", "duration")
    pairs = r.select(F.col("k").alias("pair_id"), fields.alias("source")).join(r.select((F.col("k") - 1).alias("pair_id"), fields.alias("export")), "pair_id")
    metrics = r.where("k % 3 = 0").select(F.col("k").alias("pair_id"), F.when(F.col("k") % 9 != 0, 0.9 + (F.col("k") % 10) / 100).alias("ssim_avg"), (F.lit(30.0) + F.col("k") % 10).alias("psnr_avg_db"), F.lit(25.0).alias("psnr_min_db"), F.lit("320x180").alias("resolution"))
    c = comparison.compare(pairs, metrics)
    return c.select("pair_id", "source_path", "export_path", F.array_join("changed_fields", ",").alias("changed"), "format_changed", "conclusion", F.array_join("reasoning", "\n").alias("reasoning"), F.array_join("limitations", "\n").alias("limitations"))


def compare_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Quality over the first seconds of pairs of pictures: an order's lines are frames, their prices pixels."""
    l = catalogue._read(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("pair_id"), (F.col("l_orderkey") / 50).cast("long").alias("pixel"), F.col("l_linenumber").alias("frame")).agg(F.max("l_quantity").alias("x"), F.max("l_tax").alias("t"))
    side = lambda c: l.select("pair_id", "frame", (F.col("frame") * 10.0).alias("time"), "pixel", c.alias("value"))
    pairs = comparison.pixel_pairs(side(F.col("x") * 5), side(F.col("x") * 5 * (1 - F.col("t"))), ["pair_id"], comparison.Comparison(45.0))
    return q.frame_quality(pairs, ["pair_id"]).select("pair_id", *[F.round(c, 5).alias(c) for c in ("psnr_avg_db", "psnr_min_db", "ssim_avg")])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        analysis_events, analysis_limitations, analysis_index, analysis_summary, analysis_texts, analysis_explained, analysis_markdown, analysis_json, analysis_reports, incident_windows, slide_states,
        probe_recordings, freeze_log, silence_log, channel_log, raw_frames, still_segments, sample_levels, channel_samples, spectral_peaks, compare_exports, compare_frames,
    )
}
