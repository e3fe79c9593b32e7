"""Frames of any size and rate: scaling by area, choice on a time grid, and comparison by local windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import over_frames

#: Side of a window of the local similarity, and how far apart windows are.
WINDOW, STEP = 8, 4


def overlaps(source: int, target: int) -> np.ndarray:
    """(target, source): how much of each source cell a target cell covers, in shares of 1 / target, so that a row sums to source."""
    i, j = np.arange(source), np.arange(target)[:, None]
    return np.clip(np.minimum((j + 1) * source, (i + 1) * target) - np.maximum(j * source, i * target), 0, None).astype(np.float64)


def area_scaled(frames: np.ndarray, width: int, height: int) -> np.ndarray:
    """Frames (n, h, w) of bytes at another size: the mean over the area that each new pixel covers, halves up.

    Sums are whole numbers below 2**53, so products of doubles are exact.
    """
    n, h, w = frames.shape
    if (h, w) == (height, width):
        return frames
    sums = overlaps(h, height) @ frames.astype(np.float64) @ overlaps(w, width).T
    return np.floor((2 * sums + h * w) / (2 * h * w)).astype(np.uint8)


def _groups(sizes: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Places of the rows of each combination of sizes."""
    if len(sizes[0]):
        _, kind = np.unique(np.stack(sizes), axis=1, return_inverse=True)
        for k in range(kind.max() + 1):
            yield np.flatnonzero(kind.ravel() == k)


def _frames(column: pa.Array, rows: np.ndarray, width: int, height: int) -> np.ndarray:
    return np.frombuffer(b"".join(column[i].as_py() for i in rows.tolist()), np.uint8).reshape(len(rows), height, width)


def _whole(pixels: str, width: str, height: str) -> Column:
    return (F.col(width) > 0) & (F.col(height) > 0) & (F.octet_length(pixels) == F.col(width) * F.col(height))


def scaled(frames: DataFrame, width: int, height: int) -> DataFrame:
    """frames (with width, height and pixels: 8-bit gray rows) at one size; other columns stay.

    Each new pixel is the mean over the area it covers, so any size goes to any other. Frames whose
    pixels are null or don't fit their size are left out. Rows stay where they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes] = [b""] * b.num_rows
            w, h = (b.column(c).to_numpy(zero_copy_only=False) for c in ("width", "height"))
            for rows in _groups([w, h]):
                new = area_scaled(_frames(b.column("pixels"), rows, int(w[rows[0]]), int(h[rows[0]])), width, height)
                for i, f in zip(rows.tolist(), new, strict=True):
                    out[i] = f.tobytes()
            size = {"width": pa.array([width] * b.num_rows, pa.int32()), "height": pa.array([height] * b.num_rows, pa.int32()), "pixels": pa.array(out, pa.binary())}
            yield pa.RecordBatch.from_arrays([size.get(n, c) for n, c in zip(b.schema.names, b.columns, strict=True)], b.schema.names)

    kept = frames.where(_whole("pixels", "width", "height")).withColumns({c: F.col(c).cast("int") for c in ("width", "height")})
    kinds = {"width": T.IntegerType(), "height": T.IntegerType(), "pixels": T.BinaryType()}
    return kept.mapInArrow(run, T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in kept.schema.fields]))


def at_rate(frames: DataFrame, fps: float, part: str = "recording_id") -> DataFrame:
    """frames (part, idx, time, ...) on the grid of times k / fps: idx is k, and its frame the last one whose nearest grid time it is.

    Grid times between the first and the last that no frame is nearest to repeat the frame before.
    Of equal times the larger idx counts. Frames before 0 and those without time are left out. Only
    the frame of each grid time is moved, and gaps are filled from numbers.
    """
    others = [c for c in frames.columns if c not in (part, "idx", "time")]
    d = frames.withColumn("__k", F.floor(F.col("time") * fps + 0.5).cast("long")).where("__k >= 0")
    best = d.groupBy(part, "__k").agg(F.max_by(F.struct(*others), F.struct("time", "idx")).alias("__f")) if others else d.select(part, "__k").distinct()
    after = F.lead("__k").over(Window.partitionBy(part).orderBy("__k"))
    last = F.coalesce(after - 1, F.col("__k"))
    spread = best.select(part, "__k", last.alias("__last")).withColumn("idx", F.explode(F.sequence("__k", "__last")))
    out = spread.join(best, [part, "__k"])
    return out.select(part, "idx", (F.col("idx") / fps).alias("time"), *[F.col(f"__f.{c}").alias(c) for c in others])


def _sums(frames: np.ndarray, size: tuple[int, int], step: int) -> np.ndarray:
    """Sums over all windows of size (height, width), `step` apart, from summed areas."""
    n, h, w = frames.shape
    area = np.zeros((n, h + 1, w + 1), np.int64)
    area[:, 1:, 1:] = frames.cumsum(axis=1, dtype=np.int64).cumsum(axis=2)
    y, x = np.arange(0, h - size[0] + 1, step), np.arange(0, w - size[1] + 1, step)
    top, low = area[:, y][:, :, x], area[:, y + size[0]][:, :, x]
    return area[:, y + size[0]][:, :, x + size[1]] - low - area[:, y][:, :, x + size[1]] + top


def similarity(a: np.ndarray, b: np.ndarray, window: int | None = WINDOW, step: int = STEP, peak: float = 255.0) -> np.ndarray:
    """Structural similarity of frames (n, h, w): the mean over windows; window None, or one larger than the frame: the frame is one window in that direction."""
    size = tuple(min(window or side, side) for side in a.shape[1:])
    n = size[0] * size[1]
    a, b = a.astype(np.int64), b.astype(np.int64)
    sa, sb, saa, sbb, sab = (_sums(x, size, step) for x in (a, b, a * a, b * b, a * b))
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    # whole numbers up to the last step: n * sum of products - product of sums is n * n times a (co)variance
    both, va, vb = n * sab - sa * sb, n * saa - sa * sa, n * sbb - sb * sb
    nn = float(n * n)
    s = ((2 * sa * sb / nn + c1) * (2 * both / nn + c2)) / (((sa * sa + sb * sb) / nn + c1) * ((va + vb) / nn + c2))
    return s.mean(axis=(1, 2))


def picture_metrics(pairs: DataFrame, key: list[str], window: int | None = WINDOW, step: int = STEP) -> DataFrame:
    """(key..., frame, width, height, mse, ssim, n) of pairs (key..., frame, a_width, a_height, a_pixels, b_width, ...).

    Frames of different size are compared at the smaller width and the smaller height, to which the larger are scaled by
    area. Pairs of which a frame is missing, or doesn't fit its size, are left out.
    """
    out = [*key, "frame"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            aw, ah, bw, bh = (b.column(c).to_numpy(zero_copy_only=False) for c in ("a_width", "a_height", "b_width", "b_height"))
            mse, ssim = np.zeros(b.num_rows), np.zeros(b.num_rows)
            for rows in _groups([aw, ah, bw, bh]):
                i = rows[0]
                w, h = int(min(aw[i], bw[i])), int(min(ah[i], bh[i]))
                x = area_scaled(_frames(b.column("a_pixels"), rows, int(aw[i]), int(ah[i])), w, h)
                y = area_scaled(_frames(b.column("b_pixels"), rows, int(bw[i]), int(bh[i])), w, h)
                mse[rows] = ((x.astype(np.int64) - y) ** 2).sum(axis=(1, 2)) / (w * h)
                ssim[rows] = similarity(x, y, window, step)
            w, h = np.minimum(aw, bw).astype(np.int32), np.minimum(ah, bh).astype(np.int32)
            values = [pa.array(w), pa.array(h), pa.array(mse), pa.array(ssim), pa.array(w.astype(np.int64) * h)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in out), *values], [*out, "width", "height", "mse", "ssim", "n"])

    kept = pairs.where(_whole("a_pixels", "a_width", "a_height") & _whole("b_pixels", "b_width", "b_height"))
    kept = kept.select(*out, *[F.col(f"{s}_{c}").cast("int").alias(f"{s}_{c}") for s in "ab" for c in ("width", "height")], "a_pixels", "b_pixels")
    more = [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("mse", "ssim")], T.StructField("n", T.LongType())]
    return kept.mapInArrow(run, T.StructType([*[kept.schema[c] for c in out], *more]))


def picture_quality(source: DataFrame, export: DataFrame, key: list[str], seconds: float | None = None, window: int | None = WINDOW, step: int = STEP) -> DataFrame:
    """(key..., resolution, psnr_avg_db, psnr_min_db, ssim_avg) of two tables of frames (key..., idx, time, width, height, pixels), of the first seconds if given.

    Frames of one idx are compared; resolution is the least one compared at. A key without common frames has no row.
    """
    of = lambda d, s: (d if seconds is None else d.where(F.col("time") < seconds)).select(*key, F.col("idx").alias("frame"), *[F.col(c).alias(f"{s}_{c}") for c in ("width", "height", "pixels")])
    m = picture_metrics(of(source, "a").join(of(export, "b"), [*key, "frame"]), key, window, step)
    least = m.groupBy(*key).agg(F.concat_ws("x", F.min("width"), F.min("height")).alias("resolution"))
    return least.join(over_frames(m, key), key)
