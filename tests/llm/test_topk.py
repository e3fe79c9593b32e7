"""Top-k search against the full product."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every, k):
    v = [(i, np.floor(1024 * np.array(e, np.float32).astype(float)).astype(int)) for i, e, _ in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for q, a in v:
        if q % every == 0:
            best = sorted((-int(a @ b), i) for i, b in v if i != q and len(a) == len(b))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [16, 4096])
def test_results_equal_the_full_product(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "PART", 8)
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=12) / 4).astype(np.float32).tolist(), 0) for i in range(300)]
    rows += [(i, rows[7][1], 1) for i in range(300, 420)]  # many of one vector
    rows += [(1000, None, 0), (1001, [0.1, None] * 6, 0), (1002, [float("nan")] * 12, 0), (1003, [float("inf")] * 12, 0), (1004, [1.0, 2.0], 0), (1010, [0.5, 0.25], 0), (None, [0.1] * 12, 0), (1020, [0.0] * 12, 0)]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == plain(rows, 10, 10)


def test_few_empty_and_extra_columns(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).count() == 0
    d = spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 1), (2, [-1.0], 1)], SCHEMA).withColumn("rank", F.lit(5)).withColumn("id", F.lit(5))
    assert sorted(map(tuple, topk.top_k(d, F.col("vec_id") == 0).collect())) == [(0, 1, 1, 1024 * 2048), (0, 2, 2, -1024 * 1024)]
    twice = d.union(d)
    assert topk.top_k(twice, F.col("vec_id") == 0).count() == 4


@pytest.mark.parametrize("block", [16, 4096])
@pytest.mark.parametrize("size", [1e3, 1e6, 1e15, 3e38])
def test_large_components_take_part(spark, monkeypatch, block, size):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=64) / 4).astype(np.float32).tolist(), 0) for i in range(60)]
    rows += [(i, (rng.uniform(-1, 1, size=64) * size).astype(np.float32).tolist(), 0) for i in range(60, 90)]
    rows += [(i, rows[61][1], 0) for i in range(90, 94)] + [(95, [float("inf")] + [0.0] * 63, 0)]
    v = {i: [int(np.floor(1024 * np.float64(np.float32(x)))) for x in e] for i, e, _ in rows if i != 95}
    want = []
    for q in range(0, 95, 10):
        best = sorted((-sum(a * b for a, b in zip(v[q], w, strict=True)), i) for i, w in v.items() if i != q)[:10]
        want += [(q, n + 1, i, -s if -(2**63) <= -s < 2**63 else None) for n, (s, i) in enumerate(best)]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == want
    assert (size > 1e3) == any(r.score is None for r in got)


def test_components_beyond_the_products_of_doubles(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, -1.0]), (2, [1e300, 2.0]), (3, [-1e300, 0.0]), (4, [0.0, 3.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 2, None), (2, 1, None), (3, 4, 3 * 1024 * 1024), (4, 3, None)]
