"""Codes by parts against plain loops over all entries."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [int(np.floor(1024 * float(np.float32(c)))) if abs(c) < 1e30 else int(np.float64(np.float32(c)) * 1024) for c in e], lab) for i, e, lab in rows if e is not None and all(c is not None and np.isfinite(c) for c in e)]
    lengths = [len(x) for _, x, _ in kept]
    dim = max(set(lengths), key=lambda d: (lengths.count(d), d)) if lengths else 0
    kept = [r for r in kept if len(r[1]) == dim]
    if not dim:
        return []
    bounds = np.cumsum([0] + [dim // parts + (p < dim % parts) for p in range(parts)])
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[x[bounds[p] : bounds[p + 1]] for _, x, _ in first] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, x, _ in kept:
                own.setdefault(nearest(p, x[bounds[p] : bounds[p + 1]])[1], []).append(x[bounds[p] : bounds[p + 1]])
            new = list(books[p])
            for k, xs in own.items():
                new[k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
            books[p] = new
    out, label = [], {}
    for i, x, lab in kept:
        got = [nearest(p, x[bounds[p] : bounds[p + 1]]) for p in range(parts)]
        error = sum(d for d, _ in got)
        out.append((i, lab, "".join(f"{k:02x}" for _, k in got), error))
        label[lab] = label.get(lab, 0) + error
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    fits = lambda v: v if v < 2**63 else None
    large = {lab for _, lab, _, e in out if e >= 2**63}
    return [(i, c, fits(e), None if lab in large else fits(label[lab]), sha) for i, lab, c, e in out]


def key(r):
    return tuple((v is None, v if v is not None else 0) for v in r)


def check(spark, rows, df=None, **kw):
    got = codes.vector_codes(df if df is not None else spark.createDataFrame(rows, SCHEMA), **kw).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows, **kw), key=key)


def some(n, dim, seed=4, size=0.25):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(size=dim) * size).astype(np.float32).tolist(), None if i % 7 == 0 else i % 3) for i in range(n)]


def test_equals_loops(spark):
    rows = some(300, 16)
    rows += [(i, rows[9][1], 1) for i in range(300, 420)]
    rows += [(500, None, 0), (501, [None] * 16, 0), (502, [float("nan")] * 16, 0), (503, [float("inf")] * 16, 0), (504, [1.0], 0), (None, [0.1] * 16, None), (3, rows[11][1], 0), (-5, [0.5] * 16, 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("code", F.lit(1)).withColumn("part", F.lit(2)).repartition(6)
    check(spark, rows, df)


@pytest.mark.parametrize("n,dim,entries", [(3, 8, 256), (60, 7, 8), (40, 3, 5), (50, 64, 70), (1, 4, 1), (0, 4, 256)])
def test_odd_shapes(spark, n, dim, entries):
    check(spark, some(n, dim, seed=n), entries=entries)


@pytest.mark.parametrize("size", [40.0, 1e6, 3e37])
def test_large_numbers(spark, size):
    rows = [(i, [max(-3e38, min(3e38, v)) for v in e], lab) for i, e, lab in some(40, 8, seed=5, size=size)]
    check(spark, rows, entries=6)


def test_no_vectors(spark):
    check(spark, [(1, None, 0), (2, [], 0)])


@pytest.mark.parametrize("kind", [np.int32, np.int64, object])
@pytest.mark.parametrize("m,dim", [(1, 3), (64, 2), (65, 4), (200, 1), (256, 12)])
def test_masks_find_the_nearest(kind, m, dim):
    rng = np.random.default_rng(m)
    entries, q = rng.integers(-9, 9, (m, dim)), np.concatenate([rng.integers(-12, 12, (300, dim)), np.full((1, dim), 3000)])
    d = ((q[:, None] - entries[None]) ** 2).sum(axis=2)
    at, best = codes.Slices(codes._as(entries, kind)).nearest(codes._as(q, kind))
    assert (at == d.argmin(axis=1)).all() and (best.astype(np.int64) == d.min(axis=1)).all()


def test_masks_hold_exactly_the_cube():
    rng = np.random.default_rng(0)
    entries, q = rng.integers(-9, 9, (130, 3)), rng.integers(-12, 12, (50, 3))
    masks = codes.Slices(entries).within(q, np.full(50, 4))
    for i in range(50):
        got = {e for e in range(130) if int(masks[i, e // 64]) >> (e % 64) & 1}
        assert got == set(np.flatnonzero((np.abs(entries - q[i]) <= 4).all(axis=1)).tolist())
