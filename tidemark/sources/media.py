"""Frames and samples from raw bytes, and measurements from them."""

from __future__ import annotations

import shutil
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import BUCKETS


#: Samples that are handed on at once, at about.
AT_ONCE = 1 << 20


class ToolMissing(RuntimeError):
    """A media tool that is asked for is not on this machine."""


def media_tool(name: str) -> str:
    """The place of a media tool; ToolMissing where there is none. Signal tables need no tool."""
    path = shutil.which(name)
    if path is None:
        raise ToolMissing(f"{name} is not installed")
    return path


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """(recording_id, content) of binary files; the id is the file's name without its ending."""
    d = spark.read.format("binaryFile").load(path)
    return d.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("recording_id"), "content")


def frame_pixels(raw: DataFrame, grid: int = 32, fps: float = 2.0, start: float = 0.0) -> DataFrame:
    """(recording_id, idx, time, pixels) of raw 8-bit gray frames; a frame that is cut short at the end is dropped."""
    n = F.floor(F.length("content") / (grid * grid)).cast("int")
    d = raw.withColumn("__n", n).where("__n > 0").withColumn("idx", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    cut = F.substring(F.col("content"), F.col("idx") * (grid * grid) + 1, F.lit(grid * grid))
    return d.select("recording_id", "idx", (F.lit(start) + F.col("idx") / fps).alias("time"), cut.alias("pixels"))


def sized_frames(raw: DataFrame, fps: float = 2.0, start: float = 0.0) -> DataFrame:
    """(recording_id, idx, time, width, height, pixels) of raw 8-bit gray frames (recording_id, width, height, content), each recording of its own size.

    A frame that is cut short at the end is dropped; a recording without a size has no frames.
    """
    area = F.col("width") * F.col("height")
    n = F.floor(F.length("content") / F.when(area > 0, area)).cast("int")
    d = raw.withColumn("__n", n).where("__n > 0").withColumn("idx", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    cut = F.substring(F.col("content"), F.col("idx") * area + 1, area)
    return d.select("recording_id", "idx", (F.lit(start) + F.col("idx") / fps).alias("time"), "width", "height", cut.alias("pixels"))


def _values(pixels: str) -> Column:
    """The bytes of a column as integers, by one Arrow pass."""

    @F.pandas_udf("array<int>")
    def numbers(parts: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else np.frombuffer(p, np.uint8).astype(np.int32) for p in parts])

    return numbers(pixels)


#: Frames whose pixels are looked at together.
FRAMES = 256


def _hashed(pixels: str) -> Column:
    """hash and bucket of a column of bytes, as `average_hash` and `brightness` of their values; numbers of pixels are not sent to the JVM."""

    @F.pandas_udf("hash array<bigint>, bucket int")
    def digest(parts: pd.Series) -> pd.DataFrame:
        hashes, buckets = [None] * len(parts), [None] * len(parts)
        for a in range(0, len(parts), FRAMES):
            own = parts.iloc[a : a + FRAMES].tolist()
            for n in {len(p) for p in own if p}:
                at = [i for i, p in enumerate(own) if p and len(p) == n]
                v = np.frombuffer(b"".join(own[i] for i in at), np.uint8).reshape(len(at), n)
                # sums of bytes are whole numbers, so the mean is the same in any order
                mean = v.sum(axis=1, dtype=np.int64) / n
                words = np.packbits(v[:, : n // 64 * 64] >= mean[:, None], axis=1).view(">i8").astype(np.int64)
                bucket = np.minimum(np.floor(mean / 256 * BUCKETS), BUCKETS - 1).astype(int)
                for k, i in enumerate(at):
                    hashes[a + i], buckets[a + i] = words[k], bucket[k]
        return pd.DataFrame({"hash": hashes, "bucket": pd.array(buckets, "Int32")})

    return digest(pixels)


def frame_samples(frames: DataFrame) -> DataFrame:
    """(recording_id, idx, time_ms, time, hash, bucket) of frame_pixels."""
    d = frames.withColumn("__h", _hashed("pixels"))
    return d.select("recording_id", "idx", F.round(F.col("time") * 1000).cast("long").alias("time_ms"), "time", F.col("__h.hash").alias("hash"), F.col("__h.bucket").alias("bucket"))


def pcm_blocks(raw: DataFrame, rate: int = 22050, block: int = 65536) -> DataFrame:
    """(recording_id, block, sample_rate, first, samples ARRAY<SMALLINT>) of little-endian 16-bit samples; an odd last byte is dropped.

    first is the place of a block's first sample. Files beyond 2 GB are read by `raw.read_raw`, which gives the same rows.
    """

    most = max(1, AT_ONCE // block) * block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, contents, parts, held = b.column("recording_id").cast(pa.string()), b.column("content"), [], 0
            for i in range(b.num_rows):
                if not contents[i].is_valid:
                    continue
                content = contents[i].as_buffer()
                x = np.frombuffer(content, "<i2", content.size // 2)
                for a in range(0, len(x), most):
                    parts.append((i, a, x[a : a + most]))
                    held += len(parts[-1][2])
                    if held >= AT_ONCE:
                        yield _blocks(names, parts, rate, block)
                        parts, held = [], 0
            if parts:
                yield _blocks(names, parts, rate, block)

    return raw.select("recording_id", "content").mapInArrow(run, "recording_id string, block int, sample_rate int, first bigint, samples array<smallint>")


def _blocks(names: pa.Array, parts: list[tuple[int, int, np.ndarray]], rate: int, block: int) -> pa.RecordBatch:
    """Rows of pcm_blocks of (row of the name, place of the first sample, samples), cut where a block ends."""
    starts = [np.arange(a, a + len(x), block) for _, a, x in parts]
    first = np.concatenate(starts)
    sizes = np.concatenate([np.minimum(s + block, a + len(x)) - s for s, (_, a, x) in zip(starts, parts, strict=True)])
    who = names.take(pa.array(np.repeat([i for i, _, _ in parts], [len(s) for s in starts])))
    samples = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate([x for _, _, x in parts]), pa.int16()))
    return pa.RecordBatch.from_arrays([who, pa.array(first // block, pa.int32()), pa.array(np.full(len(first), rate), pa.int32()), pa.array(first, pa.int64()), samples], ["recording_id", "block", "sample_rate", "first", "samples"])


def with_first(blocks: DataFrame) -> DataFrame:
    """blocks with `first`; where they have none, the lengths of the blocks before add up to it. Blocks without samples are left out."""
    blocks = blocks.where("samples IS NOT NULL")
    if "first" in blocks.columns:
        return blocks
    before = Window.partitionBy("recording_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # numbers alone are sorted, samples are joined to them
    places = blocks.select("recording_id", "block", F.size("samples").cast("long").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).drop("n")
    return blocks.join(places, ["recording_id", "block"])


def block_samples(blocks: DataFrame) -> DataFrame:
    """(recording_id, time, value in -1 to 1) of pcm_blocks: a row for each sample, for those who need single ones."""
    d = with_first(blocks).select("recording_id", "sample_rate", "first", F.posexplode("samples").alias("i", "s"))
    return d.select("recording_id", ((F.col("first") + F.col("i")) / F.col("sample_rate")).alias("time"), (F.col("s") / 32768.0).alias("value"))


def black_frames(frames: DataFrame, pixel: float = 0.10, share: float = 0.98) -> DataFrame:
    """(recording_id, idx, time, hit): whether `share` of a frame's pixels is darker than `pixel` of full scale."""
    v = _values("pixels")
    return frames.select("recording_id", "idx", "time", (F.size(F.filter(v, lambda x: x < pixel * 255)) >= share * F.size(v)).alias("hit"))


def still_frames(frames: DataFrame, noise_db: float = -60.0) -> DataFrame:
    """(recording_id, idx, time, hit): whether a frame's mean absolute difference from the one before is within the noise."""
    w = Window.partitionBy("recording_id").orderBy("idx")
    d = frames.withColumn("__before", F.lag("pixels").over(w))
    diff = F.aggregate(F.zip_with(_values("pixels"), _values("__before"), lambda a, b: F.abs(a - b)), F.lit(0), lambda s, x: s + x) / F.length("pixels")
    return d.select("recording_id", "idx", "time", F.coalesce(diff <= 255 * 10 ** (noise_db / 20), F.lit(False)).alias("hit"))


def measured_segments(hits: DataFrame, kind: str, least: float, step: float = 0.5) -> DataFrame:
    """(recording_id, kind, start, end, duration) of runs of frames with `hit`, of `least` seconds or more; a run ends a step after its last frame.

    This measures tables of frames the way the filters' parameters are described; it is no copy of any filter.
    """
    from ..operators.runs import label_runs

    runs = label_runs(hits, ["recording_id"], ["idx"], F.when(F.col("hit"), kind))
    d = runs.groupBy("recording_id", "run").agg(F.min("time").alias("start"), (F.max("time") + step).alias("end"))
    d = d.withColumns({"kind": F.lit(kind), "duration": F.col("end") - F.col("start")})
    return d.where(F.col("duration") >= least).select("recording_id", "kind", "start", "end", "duration")
