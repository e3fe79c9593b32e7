"""Level envelopes of samples in tumbling windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import SILENT_DB, level_db
from ..sources.media import with_first
from .groups import slices

#: Full scale of 16-bit samples, and the least size of one at its limit.
SCALE, LIMIT = 32768.0, 0.999

#: Blocks whose sums are handed on together.
BLOCKS = 256


def _windowed(samples: DataFrame, window: float) -> DataFrame:
    return samples.withColumn("idx", F.floor(F.col("time") / window).cast("int"))


def _envelope(sums: DataFrame, window: float, part: str) -> DataFrame:
    """Levels of windows with ms (mean square), peak, n and at_limit."""
    flat = F.try_divide(F.greatest(F.col("at_limit") - 1, F.lit(0)).cast("double"), F.col("n"))
    start = F.col("idx") * window
    return sums.select(part, "idx", F.round(start * 1000).cast("long").alias("start_ms"), start.alias("start"), (start + window).alias("end"), level_db(F.col("ms")).alias("rms_db"), level_db(F.col("peak") * F.col("peak")).alias("peak_db"), F.coalesce(flat * 10, F.lit(0.0)).alias("flat_factor"))


def level_envelope(samples: DataFrame, window: float = 0.5, part: str = "recording_id") -> DataFrame:
    """recording_id, idx, start_ms, start, end, rms_db, peak_db, flat_factor of (recording_id, time, value), value in -1 to 1.

    A window ends `window` after its start even where samples end before. flat_factor is ten
    times the share of samples at full scale beyond the first: an approximation of how long
    the wave stays at its limits, not the measure of any one tool.
    """
    w = _windowed(samples, window)
    d = w.groupBy(part, "idx").agg(F.avg(F.col("value") * F.col("value")).alias("ms"), F.max(F.abs("value")).alias("peak"), F.count("value").alias("n"), F.count_if(F.abs("value") >= LIMIT).alias("at_limit"))
    return _envelope(d, window, part)


def _partial_sums(blocks: DataFrame, window: float, channels: int) -> DataFrame:
    """(recording_id, idx, channel, squares, peak, n, at_limit): what each block adds to the windows that it reaches into.

    Squares are summed up as whole numbers, so the sums don't depend on how samples are cut into blocks.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, BLOCKS):
            out = []
            lists = b.column("samples")
            for i, (rec, rate, first) in enumerate(zip(*(b.column(c).to_pylist() for c in ("recording_id", "sample_rate", "first")), strict=True)):
                x = np.asarray(lists[i].values.to_numpy(zero_copy_only=False), np.int64)
                place = first + np.arange(len(x))
                for c in range(channels):
                    own = x[(c - first) % channels :: channels]
                    if not len(own):
                        continue
                    at = place[(c - first) % channels :: channels] // channels
                    idx = np.floor(at / rate / window).astype(np.int64)
                    begin = np.flatnonzero(np.diff(idx, prepend=idx[0] - 1))
                    size = np.abs(own)
                    out.append((rec, idx[begin], np.full(len(begin), c + 1), np.add.reduceat(own * own, begin), np.maximum.reduceat(size, begin), np.diff([*begin, len(own)]), np.add.reduceat((size >= LIMIT * SCALE).astype(np.int64), begin)))
            names = ["recording_id", "idx", "channel", "squares", "peak", "n", "at_limit"]
            who = pa.array([r[0] for r in out for _ in r[1]], pa.string())
            yield pa.RecordBatch.from_arrays([who, *(pa.array(np.concatenate([r[k] for r in out]) if out else [], pa.int64()) for k in range(1, 7))], names)

    d = with_first(blocks).select(F.col("recording_id").cast("string"), "sample_rate", "first", "samples")
    return d.mapInArrow(measure, "recording_id string, idx long, channel long, squares long, peak long, n long, at_limit long")


def block_levels(blocks: DataFrame, window: float = 0.5) -> DataFrame:
    """The rows of `level_envelope` for mono pcm_blocks, from sums of each block: a row a block and window is shuffled, none a sample."""
    d = _partial_sums(blocks, window, 1).groupBy("recording_id", F.col("idx").cast("int").alias("idx")).agg(F.sum("squares").alias("squares"), F.max("peak").alias("peak"), F.sum("n").alias("n"), F.sum("at_limit").alias("at_limit"))
    d = d.withColumns({"ms": F.col("squares") / (SCALE * SCALE) / F.col("n"), "peak": F.col("peak") / SCALE})
    return _envelope(d, window, "recording_id")


def _by_channel(levels: DataFrame, window: float, part: str, silent: float = SILENT_DB) -> DataFrame:
    """A map from channel to level for each window of (part, idx, channel, ms)."""
    w = levels.withColumn("db", level_db(F.col("ms"), silent))
    d = w.groupBy(part, "idx").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("channel").cast("int"), "db")))).alias("channel_rms_db"))
    start = F.col("idx") * window
    return d.select(part, "idx", F.round(start * 1000).cast("long").alias("start_ms"), start.alias("start"), (start + window).alias("end"), "channel_rms_db")


def block_channel_levels(blocks: DataFrame, channels: int, window: float = 0.5) -> DataFrame:
    """The rows of `channel_envelope` for pcm_blocks whose samples take turns by channel; sample_rate counts one channel."""
    d = _partial_sums(blocks, window, channels).groupBy("recording_id", F.col("idx").cast("int").alias("idx"), "channel").agg(F.sum("squares").alias("squares"), F.sum("n").alias("n"))
    return _by_channel(d.withColumn("ms", F.col("squares") / (SCALE * SCALE) / F.col("n")), window, "recording_id")


def channel_envelope(samples: DataFrame, window: float = 0.5, part: str = "recording_id", silent: float = SILENT_DB) -> DataFrame:
    """recording_id, idx, start_ms, start, end, channel_rms_db (channel from 1 -> level) of (recording_id, channel, time, value).

    Channels without samples in a window are absent from its map; `silent` is the level of one whose samples are all 0. Samples are summed up by
    channel first, so a window's map gathers one row a channel.
    """
    w = _windowed(samples, window).groupBy(part, "idx", "channel").agg(F.avg(F.col("value") * F.col("value")).alias("ms"))
    return _by_channel(w, window, part, silent)
