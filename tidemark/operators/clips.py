"""Clips of captured samples as WAV files."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.media import with_first
from .groups import by_key

#: Samples of a range by which clips and blocks meet.
RANGE = 1 << 16


def wav(samples: np.ndarray, rate: int, channels: int = 1) -> bytes:
    """A WAV file of 16-bit samples."""
    data = samples.astype("<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16, b"data", len(data))
    return head + data


def _ranges(start, end):
    return F.explode(F.sequence(F.floor(start / RANGE), F.floor((end - 1) / RANGE)))


def wav_clips(blocks: DataFrame, plan: DataFrame) -> DataFrame:
    """(recording_id, incident, first, n, content): the samples of each clip of the plan, from clip_start on for clip_length seconds, as a WAV file.

    First and last sample are those at the floor of their times; what lies beyond the recording is left out, and a
    clip without samples has no row. Clips and blocks meet by ranges of samples, each pair once; only the
    cut samples are moved. A task puts one clip together, so a clip must fit its memory.
    """
    b = with_first(blocks).select(F.col("recording_id").alias("__r"), "sample_rate", "first", "samples").where(F.size("samples") > 0)
    b = b.withColumn("last", F.col("first") + F.size("samples"))
    rates = b.groupBy("__r").agg(F.max("sample_rate").alias("rate"))
    p = plan.select("recording_id", "incident", "clip_start", "clip_length").join(rates, F.col("recording_id") == F.col("__r")).drop("__r")
    p = p.withColumns({"begin": F.floor(F.greatest("clip_start", F.lit(0.0)) * F.col("rate")), "stop": F.floor((F.col("clip_start") + F.col("clip_length")) * F.col("rate"))}).where("stop > begin")
    p = p.withColumn("range", _ranges(F.col("begin"), F.col("stop")))
    met = b.withColumn("__range", _ranges(F.col("first"), F.col("last"))).join(p, (F.col("__r") == F.col("recording_id")) & (F.col("__range") == F.col("range")))
    start, end = F.greatest("first", "begin"), F.least("last", "stop")
    # of the ranges that both are in, the first
    met = met.where((start < end) & (F.floor(start / RANGE) == F.col("range")))
    cut = met.select("recording_id", "incident", "rate", start.alias("at"), F.slice("samples", (start - F.col("first") + 1).cast("int"), (end - start).cast("int")).alias("samples"))

    def put(key: tuple, part: pa.Table) -> pa.RecordBatch:
        x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in part.column("samples").chunks])
        values = [key[0], key[1], part.column("at")[0].as_py(), len(x), wav(x, part.column("rate")[0].as_py())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["recording_id", "incident", "first", "n", "content"])

    return by_key(cut, ["recording_id", "incident"], ["at"], put, "recording_id string, incident int, first long, n long, content binary")
