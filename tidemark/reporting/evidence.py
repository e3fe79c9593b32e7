"""Evidence folders: what backs each of the graver events."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import timeline as tl
from ..operators.clips import wav_clips
from ..sinks import write_files
from ..storage import written
from .documents import event_dict

#: Files of an incident by the name that reports give them. Fixed values.
STILLS = {"before_frame": ("before_at", "before.jpg"), "event_frame": ("event_at", "event.jpg"), "after_frame": ("after_at", "after.jpg")}

_MADE = "recording_id string, id string, evidence map<string,string>, files array<struct<path:string,content:binary>>"


def evidence_files(
    timeline: DataFrame,
    min_severity: str = "medium",
    still: Callable[[str, float], bytes] | None = None,
    clip: Callable[[str, float, float], bytes] | None = None,
    slugs: DataFrame | None = None,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """(recording_id, id, evidence, files) of the events at least that severe: labels to paths, and the files at these.

    Each gets <recording>/incident-NNNN, numbered over its recording's whole timeline, with metadata.json and explanation.txt. Where there are
    functions that take them from the media, stills (source, second) and a clip (source, start, length), these run in the tasks
    that hold the events; with blocks of samples, the clip's sound is cut from them as evidence.wav. Events
    without a source are left out. If anything of an event fails, its evidence says so, it has no files, and the others go on.
    """
    plan = tl.evidence_plan(timeline, min_severity)
    todo = plan.drop("type", "severity").join(timeline, ["recording_id", "id"]).join(tl.explained(timeline), ["recording_id", "id"]).where(F.size("source_files") > 0)
    todo = todo.withColumn("slug", F.col("recording_id")) if slugs is None else todo.join(slugs.select("recording_id", "slug"), "recording_id")
    sound = F.lit(None).cast("binary")
    if blocks is not None:
        todo = todo.join(wav_clips(blocks, plan).select("recording_id", "incident", F.col("content").alias("sound")), ["recording_id", "incident"], "left")
        sound = F.col("sound")
    todo = todo.select(F.struct(*timeline.columns).alias("event"), "slug", "incident", "explanation", "clip_start", "clip_length", *[at for at, _ in STILLS.values()], sound.alias("sound"))

    def run(parts):
        for part in parts:
            rows = []
            for row in part.to_dict("records"):
                e = dict(row["event"])
                try:
                    rows.append((e["recording_id"], e["id"], *_package(e, row, still, clip)))
                except Exception as problem:  # one event's media can't be read; the rest can
                    rows.append((e["recording_id"], e["id"], {"error": str(problem)}, []))
            yield pd.DataFrame(rows, columns=["recording_id", "id", "evidence", "files"])

    return todo.mapInPandas(run, _MADE)


def _package(e: dict, row: dict, still: Callable | None, clip: Callable | None) -> tuple[dict[str, str], list[dict]]:
    own, source, found = f"{row['slug']}/incident-{row['incident']:04d}", e["source_files"][0], []
    for label, (at, name) in STILLS.items() if still else ():
        found.append((label, name, still(source, row[at])))
    if clip:
        found.append(("clip", "evidence.mp4", clip(source, row["clip_start"], row["clip_length"])))
    if row["sound"] is not None:
        found.append(("sound", "evidence.wav", row["sound"]))
    found.append(("metadata", "metadata.json", json.dumps(event_dict(e), indent=2, ensure_ascii=False).encode()))
    found.append(("explanation", "explanation.txt", row["explanation"].encode()))
    return {label: f"{own}/{name}" for label, name, _ in found}, [{"path": f"{own}/{name}", "content": bytes(content)} for _, name, content in found]


def write_evidence(timeline: DataFrame, folder: str, min_severity: str = "medium", **sources) -> DataFrame:
    """timeline with `evidence` of the events at least that severe: labels and full paths of the files, which are written below folder by the tasks that hold the events.

    sources: still, clip, slugs and blocks of `evidence_files`. Others keep their evidence.
    """
    folder = folder if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", folder) else os.path.abspath(folder)
    made = written(evidence_files(timeline, min_severity, **sources))
    write_files(made.select(F.inline("files")), folder)
    full = F.transform_values("evidence", lambda k, v: F.when(k == "error", v).otherwise(F.concat(F.lit(f"{folder}/"), v)))
    full = made.select("recording_id", "id", full.alias("__evidence"))
    return timeline.join(full, ["recording_id", "id"], "left").withColumn("evidence", F.coalesce("__evidence", "evidence")).select(*timeline.columns)
