"""Signals as streams: the same measures over data that is still coming in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import level_db


def level_stream(samples: DataFrame, window: str = "500 milliseconds", late: str = "2 seconds") -> DataFrame:
    """Level windows of a stream (recording_id, ts, value), each given once the watermark has passed it; later samples are dropped."""
    d = samples.withWatermark("ts", late).groupBy("recording_id", F.window("ts", window))
    d = d.agg(F.avg(F.col("value") * F.col("value")).alias("ms"), F.max(F.abs("value")).alias("peak"), F.count("value").alias("n"))
    return d.select("recording_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), level_db(F.col("ms")).alias("rms_db"), level_db(F.col("peak") * F.col("peak")).alias("peak_db"), "n")


def active_sessions(levels: DataFrame, active: float, gap: str = "2 seconds", late: str = "2 seconds") -> DataFrame:
    """Sessions of rows (recording_id, ts, rms_db) above `active`, ended by a gap without one."""
    d = levels.where(F.col("rms_db") > active).withWatermark("ts", late)
    return d.groupBy("recording_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"), F.max("rms_db").alias("max_rms_db")).select("recording_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "max_rms_db")


_SEGMENT = "recording_id string, start double, end double, sample_count long"
_ANCHOR = "start double, n long, hash array<bigint>, bucket int"


def segment_stream(frames: DataFrame, threshold: int = 24) -> DataFrame:
    """Segments of a stream of frames (recording_id, time, hash, bucket), each given when the next one begins.

    Kept for each recording: the first frame of the open segment and a count. Frames of
    a batch are taken in the order of time; frames older than the open segment count as part of it.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(parts)).sort_values("time")
        start, n, words, bucket = state.get if state.exists else (None, 0, None, 0)
        rows = []
        for time, h, b in zip(got["time"], got["hash"], got["bucket"], strict=True):
            h = np.asarray(h, np.int64)
            near = n and int(np.bitwise_count((h ^ np.asarray(words, np.int64)).view(np.uint64)).sum()) + int(b ^ bucket).bit_count() <= threshold
            if n and not near:
                rows.append((key[0], start, float(time), n))
            if not near:
                start, n, words, bucket = float(time), 0, h, int(b)
            n += 1
        state.update((start, n, [int(x) for x in words], bucket))
        yield pd.DataFrame(rows, columns=["recording_id", "start", "end", "sample_count"])

    return frames.groupBy("recording_id").applyInPandasWithState(run, _SEGMENT, _ANCHOR, "append", "NoTimeout")
