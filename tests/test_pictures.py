"""Scaling, choice and comparison of frames against plain loops over pixels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import pictures, quality

FRAME = "recording_id string, idx int, time double, width int, height int, pixels binary"


def plain_scaled(p, width, height):
    h, w = p.shape
    out = np.zeros((height, width), int)
    for y in range(height):
        for x in range(width):
            total = 0.0
            for i in range(h):
                for j in range(w):
                    dy = min((y + 1) * h / height, i + 1) - max(y * h / height, i)
                    dx = min((x + 1) * w / width, j + 1) - max(x * w / width, j)
                    total += max(0, dy) * max(0, dx) * int(p[i, j])
            out[y, x] = math.floor(total * width * height / (w * h) + 0.5 + 1e-9)
    return out


@pytest.mark.parametrize("h,w,height,width", [(4, 4, 4, 4), (5, 7, 3, 2), (3, 2, 5, 7), (16, 9, 4, 4), (1, 1, 3, 3), (2, 6, 3, 1)])
def test_scaled_by_area(h, w, height, width):
    p = np.random.default_rng(h * w).integers(0, 256, (3, h, w)).astype(np.uint8)
    got = pictures.area_scaled(p, width, height)
    assert [g.tolist() for g in got] == [plain_scaled(f, width, height).tolist() for f in p]


def test_scaled_frames_of_several_sizes(spark):
    rng = np.random.default_rng(1)
    rows = [(str(i % 3), i, i / 10, 2 + i % 4, 3 + i % 3, rng.integers(0, 256, (3 + i % 3) * (2 + i % 4)).astype(np.uint8).tobytes()) for i in range(40)]
    bad = [("bad", 0, 0.0, 2, 2, b"abc"), ("bad", 1, 0.0, 0, 0, b""), ("bad", 2, 0.0, None, 2, b"ab"), ("bad", 3, 0.0, 2, 2, None)]
    d = spark.createDataFrame(rows + bad, FRAME).withColumn("extra", F.lit("x"))
    got = {r.idx: r for r in pictures.scaled(d, 2, 2).collect()}
    assert sorted(got) == list(range(40))
    for rec, i, time, w, h, p in rows:
        r = got[i]
        assert (r.recording_id, r.time, r.width, r.height, r.extra) == (rec, time, 2, 2, "x")
        assert bytes(r.pixels) == bytes(plain_scaled(np.frombuffer(p, np.uint8).reshape(h, w), 2, 2).ravel().tolist())
    assert pictures.scaled(d.limit(0), 2, 2).count() == 0


def test_choice_on_a_time_grid(spark):
    times = [0.0, 0.1, 0.24, 0.26, 0.6, 0.6, 2.0, None, -3.0]
    d = spark.createDataFrame([("a", i, t, 1, 1, bytes([i])) for i, t in enumerate(times)] + [("b", 0, 1.0, 1, 1, b"z")], FRAME)
    got = pictures.at_rate(d, 2.0).orderBy("recording_id", "idx").collect()
    assert [(r.recording_id, r.idx, r.time, bytes(r.pixels)) for r in got] == [("a", 0, 0.0, b"\x02"), ("a", 1, 0.5, b"\x05"), ("a", 2, 1.0, b"\x05"), ("a", 3, 1.5, b"\x05"), ("a", 4, 2.0, b"\x06"), ("b", 2, 1.0, b"z")]
    steady = spark.createDataFrame([("a", i, i / 25, 1, 1, bytes([i])) for i in range(100)], FRAME)
    assert [r.idx for r in pictures.at_rate(steady, 2.0).orderBy("idx").collect()] == list(range(9))
    assert pictures.at_rate(steady.select("recording_id", "idx", "time"), 5.0).count() == 21


def plain_similarity(a, b, size, step):
    h, w = a.shape
    sy, sx = min(size or h, h), min(size or w, w)
    c1, c2, out = 6.5025, 58.5225, []
    for y in range(0, h - sy + 1, step):
        for x in range(0, w - sx + 1, step):
            p, q = a[y : y + sy, x : x + sx].astype(float), b[y : y + sy, x : x + sx].astype(float)
            cov = ((p - p.mean()) * (q - q.mean())).mean()
            out.append((2 * p.mean() * q.mean() + c1) * (2 * cov + c2) / ((p.mean() ** 2 + q.mean() ** 2 + c1) * (p.var() + q.var() + c2)))
    return np.mean(out)


@pytest.mark.parametrize("h,w,size,step", [(8, 8, 8, 4), (20, 13, 8, 4), (20, 13, 5, 1), (5, 30, 8, 4), (7, 9, None, 4), (1, 1, 8, 4)])
def test_similarity_equals_a_loop_over_windows(h, w, size, step):
    rng = np.random.default_rng(h + w)
    a = rng.integers(0, 256, (4, h, w)).astype(np.uint8)
    b = np.clip(a + rng.integers(-40, 40, a.shape), 0, 255).astype(np.uint8)
    b[3] = a[3]
    got = pictures.similarity(a, b, size, step)
    np.testing.assert_allclose(got, [plain_similarity(x, y, size, step) for x, y in zip(a, b, strict=True)], rtol=1e-12)
    assert got[3] == 1


def test_quality_of_different_sizes(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 256, (6, 24, 20)).astype(np.uint8)
    b = np.clip(pictures.area_scaled(a, 10, 26) + rng.integers(0, 30, (6, 26, 10)), 0, 255).astype(np.uint8)
    source = spark.createDataFrame([("k", i, i / 2, 20, 24, f.tobytes()) for i, f in enumerate(a)] + [("alone", 0, 0.0, 1, 1, b"a")], FRAME)
    export = spark.createDataFrame([("k", i, i / 2, 10, 26, f.tobytes()) for i, f in enumerate(b)] + [("k", 9, 4.5, 10, 26, b[0].tobytes())], FRAME)
    r = pictures.picture_quality(source, export, ["recording_id"], seconds=2.0).collect()
    x, y = (np.stack([plain_scaled(f, 10, 24) for f in side[:4]]) for side in (a, b))
    mse = ((x - y) ** 2).reshape(4, -1).mean(axis=1)
    assert len(r) == 1 and r[0].resolution == "10x24"
    assert r[0].psnr_avg_db == pytest.approx(10 * math.log10(255**2 / mse.mean())) and r[0].psnr_min_db == pytest.approx(10 * math.log10(255**2 / mse.max()))
    assert r[0].ssim_avg == pytest.approx(np.mean([plain_similarity(p, q, 8, 4) for p, q in zip(x, y, strict=True)]))


def test_one_window_equals_frame_quality(spark):
    """The named option for the whole frame gives what the aggregates over pixels give."""
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 256, (2, 3, 6, 5)).astype(np.uint8)
    of = lambda x: spark.createDataFrame([("k", i, 0.0, 5, 6, f.tobytes()) for i, f in enumerate(x)], FRAME)
    got = pictures.picture_quality(of(a), of(b), ["recording_id"], window=None).first()
    px = spark.createDataFrame([("k", f, float(p), float(q)) for f in range(3) for p, q in zip(a[f].ravel(), b[f].ravel(), strict=True)], "recording_id string, frame int, a double, b double")
    want = quality.frame_quality(px, ["recording_id"]).first()
    assert all(got[c] == pytest.approx(want[c]) for c in ("psnr_avg_db", "psnr_min_db", "ssim_avg"))
