"""Silence at the precision of a sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.media import with_first
from .groups import slices
from .levels import SCALE


#: Blocks whose runs are found and handed on together.
BLOCKS = 64


def _runs(quiet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and end of every run of True."""
    edges = np.diff(np.concatenate([[0], quiet.view(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _found(batches: Iterator[pa.RecordBatch], loudest: int) -> Iterator[pa.RecordBatch]:
    """The rows of quiet_runs, those of BLOCKS blocks at once."""
    for b in slices(batches, BLOCKS):
        lists, own = b.column("samples"), []
        for i, first in enumerate(b.column("first").to_pylist()):
            x = lists[i].values.to_numpy(zero_copy_only=False)
            begin, end = _runs((x >= -loudest) & (x <= loudest))
            own.append((begin + first, end + first, (begin == 0) | (end == len(x))))
        which = pa.array(np.repeat(np.arange(len(own)), [len(o[0]) for o in own]))
        columns = [pa.array(np.concatenate([o[k] for o in own]), t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))]
        yield pa.RecordBatch.from_arrays([b.column("recording_id").take(which), b.column("sample_rate").take(which), *columns], ["recording_id", "sample_rate", "first", "end", "open"])


def quiet_runs(blocks: DataFrame, noise_db: float = -60.0) -> DataFrame:
    """(recording_id, sample_rate, first, end, open): runs of samples no louder than noise_db within each block; open ones touch an edge of it."""
    loudest = int(np.floor(10 ** (noise_db / 20) * SCALE))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _found(batches, loudest)

    d = with_first(blocks).select(F.col("recording_id").cast("string"), F.col("sample_rate").cast("int"), "first", "samples")
    return d.mapInArrow(find, "recording_id string, sample_rate int, first long, end long, open boolean")


def silence_segments(blocks: DataFrame, noise_db: float = -60.0, least: float = 0.5) -> DataFrame:
    """(recording_id, kind, start, end, duration) of stretches of `least` seconds or more whose samples are no louder than noise_db.

    Blocks are looked through apart, so a long recording is many tasks. A run inside a block is
    whole; one that touches an edge may go on in the next block: of those, two a block at most, the
    ones that end where another begins are put together, by a sort of these few numbers. The
    result does not depend on how samples are cut into blocks. Null samples don't occur in pcm_blocks;
    a recording without samples has no silence, and gaps between blocks end a stretch.
    """
    runs = quiet_runs(blocks, noise_db)
    order = Window.partitionBy("recording_id").orderBy("first")
    edge = runs.where("open").withColumn("new", (~F.col("first").eqNullSafe(F.lag("end").over(order))).cast("int"))
    edge = edge.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = edge.groupBy("recording_id", "run").agg(F.min("sample_rate").alias("sample_rate"), F.min("first").alias("first"), F.max("end").alias("end")).drop("run")
    d = runs.where("NOT open").drop("open").unionByName(whole)
    start, end = F.col("first") / F.col("sample_rate"), F.col("end") / F.col("sample_rate")
    long = d.where((F.col("end") - F.col("first")) >= least * F.col("sample_rate"))
    return long.select("recording_id", F.lit("silence").alias("kind"), start.alias("start"), end.alias("end"), ((F.col("end") - F.col("first")) / F.col("sample_rate")).alias("duration"))
