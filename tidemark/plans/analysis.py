"""Analysis of recordings: profiles of detectors over signals, and what they found or left out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import detectors as d
from .. import timeline as tl
from ..detectors.base import Signals

#: Profile -> detectors in the order in which they report. Fixed values.
PROFILES = {
    "technical": lambda: [d.Blackout(), d.Freeze(), d.Clipping(), d.ChannelImbalance()],
    "production": lambda: [d.Freeze(), d.ProgressionInterruption(), d.Dropout()],
    "presentation": lambda: [d.SlideRollback(), d.BriefSlide()],
    "post_production": lambda: [],
}


def build_detectors(profile: str = "full", feedback: bool = False) -> list[d.Detector]:
    """The profile's detectors; `full` has those of technical, production and presentation, each name once."""
    if profile == "full":
        every = [x for p in ("technical", "production", "presentation") for x in PROFILES[p]()]
        out = list({x.name: x for x in every}.values())
    elif profile in PROFILES:
        out = PROFILES[profile]()
    else:
        raise ValueError(f"Unknown profile {profile!r}. Choose from: full, {', '.join(PROFILES)}")
    return [*out, d.Feedback()] if feedback else out


@dataclass
class Result:
    """recordings, events (see tidemark.timeline) and limitations (recording_id, ord, limitation)."""

    recordings: DataFrame
    events: DataFrame
    limitations: DataFrame


def _ran(signals: Signals, detector: d.Detector) -> DataFrame:
    """Recordings that have the streams the detector can't do without."""
    r = signals.recordings
    r = r.where("has_video") if "video" in detector.requires else r
    return r.where("has_audio") if detector.requires == "audio" else r


def _limits(signals: Signals, detector: d.Detector, ordinal: int) -> list[DataFrame]:
    r, out = signals.recordings.where("has_video OR has_audio"), []
    line = lambda reason: F.concat(F.lit(f"Detector '{detector.name}' skipped: "), reason)
    no_video, no_audio = F.lit("input has no video stream."), F.lit("input has no audio stream.")
    if "video" in detector.requires:
        out.append(r.where("NOT has_video").select("recording_id", line(no_video).alias("limitation")))
    if detector.requires == "audio":
        out.append(r.where("NOT has_audio").select("recording_id", line(no_audio).alias("limitation")))
    if hasattr(detector, "skipped"):
        ran = _ran(signals, detector).where("has_video OR has_audio").select("recording_id")
        out.append(detector.skipped(signals).join(ran, "recording_id", "left_semi").select("recording_id", line(F.col("reason")).alias("limitation")))
    return [x.select("recording_id", F.lit(ordinal).alias("ord"), "limitation") for x in out]


def _together(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts, each part in tasks of its own.

    Spark lines up parts that lie by the same key, and a task then holds what every detector sorts and sums up
    for its recordings. Keys that are made anew are not lined up.
    """
    return reduce(DataFrame.unionByName, [p.withColumn("recording_id", F.concat("recording_id", F.lit(""))) for p in parts])


def analyze(signals: Signals, profile: str = "full", feedback: bool = False, chosen: list[d.Detector] | None = None) -> Result:
    """Runs the profile's detectors over all recordings at once.

    A recording's failure can't fail the others: parsers give an error in its row, and rows
    with neither stream are left out with a line of their own.
    """
    found = build_detectors(profile, feedback) if chosen is None else chosen
    spark, paths = signals.spark, signals.recordings.select("recording_id", "path")
    none = signals.recordings.where("NOT (has_video OR has_audio)")
    limits = [none.select("recording_id", F.lit(-1).alias("ord"), F.concat(F.lit("'"), F.coalesce("path", "recording_id"), F.lit("' could not be probed as a media file with video or audio streams; no detectors were run.")).alias("limitation"))]
    parts = []
    for i, detector in enumerate(found):
        limits += _limits(signals, detector, i)
        ran = _ran(signals, detector).where("has_video OR has_audio").select("recording_id")
        parts.append(tl.events(detector.find(signals).join(ran, "recording_id", "left_semi"), detector.name, i, paths))
    events = _together(parts) if parts else spark.createDataFrame([], tl._EVENT)
    return Result(signals.recordings, events, _together(limits))


def batch_index(result: Result, sources: DataFrame | None = None) -> DataFrame:
    """A row for each recording in input order: ord, recording_id, path, ok, error, duration, total, high, medium, low.

    sources: (ord, recording_id), where one recording may stand more than once; by default each recording by its id.
    """
    n = result.events.groupBy("recording_id").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")])
    r = result.recordings.select("recording_id", "path", F.col("error").isNull().alias("ok"), "error", "duration")
    d_ = r.join(n, "recording_id", "left")
    d_ = d_.withColumns({c: F.when(F.col("ok"), F.coalesce(c, F.lit(0))) for c in ("total", "high", "medium", "low")})
    return d_.orderBy("recording_id") if sources is None else sources.join(d_, "recording_id", "left").orderBy("ord")


def all_failed(index: DataFrame) -> bool:
    """Whether there are recordings and none of them could be analyzed; what a batch exits with."""
    r = index.agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("ok")).first()
    return r["n"] > 0 and r["ok"] == 0
