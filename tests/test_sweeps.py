"""Sweeps and chunked folds against the plain thing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.fixtures import A, B, Build, picture
from tidemark.operators import overlap, segments, states

SPAN = "recording_id string, start double, end double"


def spans(rng, n, most, length):
    return [(rng.choice("ab"), float(s := rng.randrange(most)), float(s + rng.randrange(-1, length))) for _ in range(n)]


@pytest.mark.parametrize("width", [1.0, 7.0, 1e6])
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_overlap_equals_all_pairs(spark, seed, width):
    rng = random.Random(seed)
    left = spans(rng, 80, 100, 9) + [("a", 5.0, 5.0), ("c", 1.0, 2.0), ("a", None, 3.0)]
    right = [(*s, rng.random() < 0.4) for s in spans(rng, 60, 100, 30)] + [("b", 0.0, 3e7, seed == 1), ("a", 2.0, None, True)]
    got = overlap.overlap_any(spark.createDataFrame(left, SPAN), spark.createDataFrame(right, SPAN + ", flag boolean"), F.col("flag"), width).collect()
    want = [(p, s, e, s is not None and s < e and any(f and q == p and x is not None and y is not None and x < y and y > s and x < e for q, x, y, f in right)) for p, s, e in left]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_an_interval_of_many_ranges_is_one_row(spark):
    left = spark.createDataFrame([("a", 9.9e6, 9.9e6 + 1)], SPAN)
    right = spark.createDataFrame([("a", 0.0, 1e7)], SPAN)
    d = overlap.overlap_any(left, right, F.lit(True), 1.0)
    assert "Generate" not in d._jdf.queryExecution().executedPlan().toString() and d.first()["any"]


def compared(spark, build, threshold, seconds, step=None):
    f = build.signals(spark).frame_samples.repartition(3)
    key = lambda r: (r.recording_id, r.pos, r.start, r.end, r.sample_count, r.max_internal_distance, tuple(r.hash), r.bucket)
    want, got = states.anchor_segments(f, threshold, step), segments.chunked_segments(f, threshold, step, seconds)
    assert got.columns == want.columns
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


@pytest.mark.parametrize("seconds", [0.5, 1.5, 4.0, 1000.0])
def test_segments_of_random_frames(spark, seconds):
    rng = np.random.default_rng(int(seconds * 2))
    b = Build()
    # a slow drift, so that where a segment breaks depends on its anchor
    word, frames = rng.integers(-(2**62), 2**62, 16).tolist(), []
    for _ in range(90):
        i = int(rng.integers(16))
        word[i] ^= 1 << int(rng.integers(62))
        if rng.random() < 0.05:
            word = rng.integers(-(2**62), 2**62, 16).tolist()
        frames.append((list(word), int(rng.integers(4))))
    b.frames("drift", frames).frames("one", [A]).frames("turns", [A, B] * 9)
    compared(spark, b, 5, seconds)


def test_one_picture_over_many_chunks(spark):
    b = Build().frames("still", [A] * 150).frames("later", [B] + [A] * 120 + [picture(3)] * 40 + [A] * 3)
    compared(spark, b, 24, 2.0)
    compared(spark, b, 24, 3.0, 0.25)
    empty = b.signals(spark).frame_samples.limit(0)
    assert segments.chunked_segments(empty).count() == 0


def test_gaps_between_chunks(spark):
    b = Build().frames("r", [A, A, B])
    b.rows["frame_samples"] += [("r", 3, 500_000, 500.0, *B), ("r", 4, 900_000, 900.0, *A)]
    compared(spark, b, 24, 10.0)


def test_the_last_segment_ends_whole_milliseconds_after_its_frame(spark):
    rng, rows, want = random.Random(1), [], {}
    for k in range(40):
        ms = sorted(rng.sample(range(2_600_000_000), 5))
        rows += [(str(k), i, t / 1000, *A) for i, t in enumerate(ms)]
        want[str(k)] = ms[-1] / 1000 + (ms[1] - ms[0]) / 1000
    f = spark.createDataFrame(rows, "recording_id string, idx int, time double, hash array<bigint>, bucket int")
    for made in (states.anchor_segments(f), segments.chunked_segments(f, seconds=1e9)):
        assert {r.recording_id: r.end for r in made.collect()} == want


def test_frames_at_one_time_go_by_their_number(spark):
    rows = [("r", i, t, *p) for i, t, p in [(2, 1.0, A), (0, 0.0, A), (1, 1.0, B), (3, 2.0, A)]]
    f = spark.createDataFrame(rows, "recording_id string, idx int, time double, hash array<bigint>, bucket int").coalesce(1)
    assert [(r.start, r.end, r.sample_count) for r in states.anchor_segments(f).orderBy("pos").collect()] == [(0.0, 1.0, 1), (1.0, 1.0, 1), (1.0, 3.0, 2)]
    assert [r.distance > 0 for r in states.visual_activity(f).collect()] == [True, True, False]
