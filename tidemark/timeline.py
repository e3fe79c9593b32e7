"""The timeline: all findings of all recordings in one order, and what is asked of it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions.scalar import event_id
from .reporting.texts import told
from .schema import CATEGORIES, EVENT_CATEGORY, MEASUREMENTS_TYPE, SEVERITIES, severity_rank

#: Order of a recording's events; detectors' order decides between events at one time.
ORDER = ("start", "end", "detector_ord", "seq_in_detector")

_EVENT = f"recording_id string, id string, start double, end double, duration double, category string, type string, severity string, confidence string, observations array<string>, measurements {MEASUREMENTS_TYPE}, possible_interpretation string, requires_human_review boolean, detector string, source_files array<string>, evidence map<string,string>, variant string, facts map<string,double>, detector_ord int, seq_in_detector int"


def events(findings: DataFrame, detector: str, ordinal: int, paths: DataFrame) -> DataFrame:
    """Findings of one detector as events. An end before the start is an error of the detector and fails.

    The id depends on recording, detector, type and times alone. Texts are English; their
    numbers are formatted as Python does, by one Arrow pass over these few rows.
    """
    kind = F.create_map(*[x for k, v in EVENT_CATEGORY.items() for x in (F.lit(k), F.lit(v))])
    seq = F.row_number().over(Window.partitionBy("recording_id").orderBy("start", "end", "type")) - 1
    d = findings.join(paths.select("recording_id", "path"), "recording_id", "left")
    d = d.withColumn("end", F.when(F.col("end") >= F.col("start"), F.col("end")).otherwise(F.raise_error(F.lit("an event ends before it starts"))))
    d = d.withColumns({"id": event_id(F.col("recording_id"), F.lit(detector), F.col("type"), F.col("start"), F.col("end")), "category": kind[F.col("type")], "duration": F.col("end") - F.col("start"), "requires_human_review": F.lit(True), "detector": F.lit(detector), "source_files": F.when(F.col("path").isNull(), F.expr("cast(array() AS array<string>)")).otherwise(F.array("path")), "evidence": F.expr("cast(map() AS map<string,string>)"), "detector_ord": F.lit(ordinal), "seq_in_detector": seq})
    text = with_texts(d, "en")
    return text.select(*[c.split()[0] for c in _split(_EVENT)])


def _split(schema: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*out, cur.strip()]


def with_texts(df: DataFrame, language: str) -> DataFrame:
    """df with observations and possible_interpretation in the language, from variant, facts and measurements."""

    @F.pandas_udf("observations array<string>, interpretation string")
    def texts(variant: pd.Series, facts: pd.Series, levels: pd.Series) -> pd.DataFrame:
        rows = [told(v, dict(f or {}), dict(c) if c is not None else None, language) for v, f, c in zip(variant, facts, levels, strict=True)]
        return pd.DataFrame(rows, columns=["observations", "interpretation"])

    d = df.withColumn("__t", texts("variant", "facts", F.col("measurements.channel_rms_db")))
    return d.withColumns({"observations": F.col("__t.observations"), "possible_interpretation": F.col("__t.interpretation")}).drop("__t")


def ordered(timeline: DataFrame) -> DataFrame:
    """Events by recording, time, detector; nothing is merged: two detectors may report one moment."""
    return timeline.orderBy("recording_id", *ORDER)


def numbered(timeline: DataFrame, out: str = "incident") -> DataFrame:
    """Events with their place in their recording's timeline, from 1."""
    return timeline.withColumn(out, F.row_number().over(Window.partitionBy("recording_id").orderBy(*ORDER)))


def filtered(timeline: DataFrame, category: str | None = None, min_severity: str | None = None) -> DataFrame:
    d = timeline if category is None else timeline.where(F.col("category") == category)
    return d if min_severity is None else d.where(severity_rank(F.col("severity")) >= SEVERITIES.index(min_severity))


def summary(timeline: DataFrame, part: str = "recording_id") -> DataFrame:
    """(part, total_events, by_severity with all three, by_category with those there are). One aggregation; maps are made of its counts."""
    counts = [F.count_if(F.col("severity") == s).alias(f"__s_{s}") for s in SEVERITIES] + [F.count_if(F.col("category") == c).alias(f"__c_{c}") for c in CATEGORIES]
    d = timeline.groupBy(part).agg(F.count(F.lit(1)).alias("total_events"), *counts)
    sev = F.create_map(*[x for s in SEVERITIES for x in (F.lit(s), F.col(f"__s_{s}"))])
    cat = F.map_filter(F.create_map(*[x for c in CATEGORIES for x in (F.lit(c), F.col(f"__c_{c}"))]), lambda _, n: n > 0)
    return d.select(part, "total_events", sev.alias("by_severity"), cat.alias("by_category"))


def evidence_plan(timeline: DataFrame, min_severity: str = "medium", pad: float = 1.5) -> DataFrame:
    """Which moments and clip of each event at least that severe to keep as evidence.

    Numbers count the whole timeline, so the ones of milder events are left out. Stills: a
    second before the start (not before 0), at the start, a second after the end; the clip
    is padded on both sides and half a second long at least.
    """
    d = filtered(numbered(timeline), min_severity=min_severity)
    s, e = F.col("start"), F.col("end")
    return d.select("recording_id", "incident", "id", "type", "severity", F.greatest(s - 1, F.lit(0.0)).alias("before_at"), s.alias("event_at"), (e + 1).alias("after_at"), F.greatest(s - pad, F.lit(0.0)).alias("clip_start"), F.greatest(e - s + 2 * pad, F.lit(0.5)).alias("clip_length"))


def nearest_frames(plan: DataFrame, frames: DataFrame, at: str) -> DataFrame:
    """plan with the first frame at or after `at` (frame_idx, frame_time; null where none follows): an as-of join by one sort of both."""
    both = plan.select("recording_id", F.col(at).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast("int").alias("idx"), F.lit(None).cast("double").alias("time")).distinct()
    both = both.unionByName(frames.select("recording_id", F.col("time").alias("__t"), F.lit(1).alias("__side"), "idx", "time"))
    # running the other way, so that the frame is the last one seen: each row is looked at once
    w = Window.partitionBy("recording_id").orderBy(F.desc("__t"), F.desc("__side")).rowsBetween(Window.unboundedPreceding, 0)
    # of frames at one time the one of least idx
    both = both.groupBy("recording_id", "__t", "__side").agg(F.min("idx").alias("idx"), F.first("time").alias("time"))
    found = both.withColumns({"frame_idx": F.last("idx", ignorenulls=True).over(w), "frame_time": F.last("time", ignorenulls=True).over(w)}).where("__side = 0")
    return plan.join(found.select("recording_id", F.col("__t").alias(at), "frame_idx", "frame_time"), ["recording_id", at], "left")


def clip_rows(signal: DataFrame, plan: DataFrame, time: str = "start", width: float = 60.0) -> DataFrame:
    """Rows of a signal that lie in the clips of the plan, with their incident. They meet by recording and bucket of `width` seconds."""
    stop = F.col("clip_start") + F.col("clip_length")
    p = plan.select(F.col("recording_id").alias("__r"), "incident", "clip_start", "clip_length", F.explode(F.sequence(F.floor(F.col("clip_start") / width), F.floor(stop / width))).alias("__b"))
    inside = (F.col(time) >= F.col("clip_start")) & (F.col(time) <= stop)
    met = (F.col("recording_id") == F.col("__r")) & (F.floor(F.col(time) / width) == F.col("__b"))
    return signal.join(p, met & inside).drop("__r", "__b", "clip_start", "clip_length")


def explained(timeline: DataFrame, *keep: str | Column) -> DataFrame:
    """(recording_id, id, further columns of the events, explanation): each event in a few lines of plain text."""

    @F.pandas_udf("string")
    def text(kind: pd.Series, category: pd.Series, start: pd.Series, end: pd.Series, severity: pd.Series, confidence: pd.Series, observations: pd.Series, interpretation: pd.Series, review: pd.Series) -> pd.Series:
        out = []
        for k, c, s, e, sv, cf, obs, it, rv in zip(kind, category, start, end, severity, confidence, observations, interpretation, review, strict=True):
            head = f"Event: {k} ({c})\nTime: {s:.2f}s - {e:.2f}s ({e - s:.2f}s)\nSeverity: {sv}   Confidence: {cf}\n\nObserved:\n"
            tail = "Human verification required." if rv else "Informational entry; human verification not required."
            out.append(head + "".join(f"  - {o}\n" for o in obs) + f"\nPossible interpretation:\n  {it or '(none stated)'}\n\n{tail}\n")
        return pd.Series(out)

    return timeline.select("recording_id", "id", *keep, text("type", "category", "start", "end", "severity", "confidence", "observations", "possible_interpretation", "requires_human_review").alias("explanation"))


def rows(timeline: DataFrame) -> Iterator:
    """Events in order, one at a time."""
    return ordered(timeline).toLocalIterator()
