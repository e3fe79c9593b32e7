"""Whitening against a full eigendecomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=4):
    """{vec_id: [(deviation, whitened of each component)]}, explained, from whole numbers."""
    kept = [(i, np.array([int(np.floor(256 * float(np.float32(c)))) for c in e], object)) for i, e, _ in rows if e is not None and all(c is not None and np.isfinite(c) for c in e)]
    dims = [len(x) for _, x in kept]
    common = max(set(dims), key=lambda d: (dims.count(d), d)) if dims else 0
    kept = [(i, x) for i, x in kept if len(x) == common]
    fit = np.array(sorted({tuple(x) for _, x in kept}), object).reshape(-1, common)
    n, s = len(fit), fit.sum(axis=0) if len(fit) else 0
    centred = ((n * fit - s) / max(1, n)).astype(float)
    e, v = np.linalg.eigh(centred.T @ centred / max(1, n))
    e, v = e[::-1], v[:, ::-1]
    live = [j for j in range(min(k, common)) if e[j] > 1e-12 * max(e[0], 1e-300)]
    out = [(i, int(((n * x - s) ** 2).sum()), ((n * x - s) / n).astype(float) @ v[:, live] / np.sqrt(e[live])) for i, x in kept]
    return n, out, e[live] / e.sum() if live else []


def check(got, rows, k=4):
    n, want, explained = plain(rows, k)
    assert len(got) == len(want) * len(explained)
    by = {}
    for r in got:
        by.setdefault((r.vec_id is None, r.vec_id or 0, r.deviation), []).append(r)
    table = {}
    for i, deviation, w in want:
        table.setdefault((i is None, i or 0, deviation if deviation < 2**63 else None), []).append(w)
    assert by.keys() == table.keys()
    sign = {}
    for key, ws in table.items():
        for c in range(len(explained)):
            mine = sorted(r.whitened for r in by[key] if r.component == c + 1)
            assert len(mine) == len(ws)
            a, b = sum(mine), sum(float(w[c]) for w in ws)
            if abs(b) > 1e-3 and c not in sign:
                sign[c] = np.sign(a) * np.sign(b)
            assert a == pytest.approx(b * sign.get(c, 1), abs=1e-7)
    for r in got:
        assert r.n == n and r.identity_error <= 1e-6 and r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)


def test_equals_eigenvectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    scale = 1.3 ** -np.arange(12)
    rows = [(i, (rng.normal(size=12) * scale + 0.2).astype(np.float32).tolist(), 0) for i in range(300)]
    rows += [(i, rows[5][1], 1) for i in range(300, 450)]  # a hot vector counts once in the fit
    rows += [(500, None, 0), (501, [None] * 12, 0), (502, [float("nan")] * 12, 0), (503, [float("inf")] * 12, 0), (504, [1.0, 2.0], 0), (None, [-0.0] * 12, None), (7, rows[8][1], 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("component", F.lit("x")).withColumn("__v", F.lit(1)).repartition(5)
    check(whitening.whiten(df).collect(), rows)
    assert [r.n for r in whitening.whiten(df, components=2).select("n").distinct().collect()] == [301]


def test_early_end_finds_the_same(spark, monkeypatch):
    monkeypatch.setattr(whitening, "LOOK", 1)
    rng = np.random.default_rng(2)
    scale = 2.0 ** -np.arange(48)
    rows = [(i, (20 * rng.normal(size=48) * scale).astype(np.float32).tolist(), 0) for i in range(200)]
    check(whitening.whiten(spark.createDataFrame(rows, SCHEMA), components=2).collect(), rows, 2)


def test_equal_eigenvalues(spark):
    """A cross of +-a on each axis: all eigenvalues are equal, so any basis is right; whitened must still be white."""
    rows = [(2 * i + s, [float((1 - 2 * s) * (i == j)) for j in range(6)], 0) for i in range(6) for s in (0, 1)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 48 and all(r.identity_error < 1e-9 and r.explained == pytest.approx(1 / 6) for r in got)


@pytest.mark.parametrize("rows,count", [([], 0), ([(1, [0.5, 0.25], 0)], 0), ([(1, [0.5, 0.25], 0), (2, [0.5, 0.25], 0)], 0), ([(1, [0.0, 1.0], 0), (2, [0.5, 1.0], 0), (3, [0.7, 1.0], 0)], 3), ([(1, [], 0)], 0), ([(1, None, 0)], 0)])
def test_few_and_flat(spark, rows, count):
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == count and all(r.component == 1 for r in got)


def test_large_entries(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) * 1e6).astype(np.float32).tolist(), 0) for i in range(40)]
    check(whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect(), rows)
    rows[3] = (3, [3e38, 1.0, 2.0, 3.0], 0)
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.vec_id for r in got} == set(range(40)) and all(r.deviation is None for r in got)
