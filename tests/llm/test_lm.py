"""Language-model scores against plain counts and chances, text by text."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lm

SCHEMA = "doc_id long, text string"


def tokens(text):
    return [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + ["\x00end"]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def counted(texts, order):
    c = [Counter() for _ in range(order)]
    for t in texts:
        padded = ["\x00start"] * (order - 1) + t
        for i in range(order - 1, len(padded)):
            for k in range(order):
                c[k][tuple(padded[i - k : i + 1])] += 1
    return c


def chances(text, c, order, docs, weights):
    """For each token (unigram chance, [(estimate, bucket)]), and the mixed chance."""
    n, v = sum(c[0].values()), len(c[0])
    padded, out = ["\x00start"] * (order - 1) + text, []
    for i in range(order - 1, len(padded)):
        p = one = (c[0][(padded[i],)] + 0.5) / (n + 0.5 * (v + 1))
        parts = []
        for k in range(1, order):
            before = tuple(padded[i - k : i])
            seen = docs if set(before) == {"\x00start"} else c[k - 1][before]
            ml = c[k][tuple(padded[i - k : i + 1])] / seen if seen else 0.0
            b = seen.bit_length()
            parts.append((ml, b))
            p = weights[k - 1][b] * ml + (1 - weights[k - 1][b]) * p
        out.append((one, parts, p))
    return out


def plain(rows, order, deleted):
    texts = [(i, tokens(t)) for i, t in rows]
    learn = [t for i, t in texts if not held(i)]
    kept = [t for i, t in texts if not held(i) and i not in deleted]
    weights = np.full((order, 64), 0.5)
    weights[:, 0] = 0
    gone = [t for i, t in texts if i in deleted and not held(i)]
    likely = None
    c = counted(kept, order)
    for _ in range(lm.ROUNDS if gone else 0):
        reached, used, log, n = np.zeros((order, 64)), np.zeros((order, 64)), 0.0, 0
        for t in gone:
            for one, parts, p in chances(t, c, order, len(kept), weights):
                log, n, steps, left = log + math.log(p), n + 1, [one], 1.0
                for k, (ml, b) in enumerate(parts):
                    steps.append(weights[k][b] * ml + (1 - weights[k][b]) * steps[-1])
                for k in reversed(range(len(parts))):
                    ml, b = parts[k]
                    g = left * weights[k][b] * ml / steps[k + 1]
                    reached[k][b] += left
                    used[k][b] += g
                    left -= g
        weights = np.where(reached > 0, np.minimum(lm.MOST, used / np.maximum(reached, 1e-300)), weights)
        weights[:, 0] = 0
        if likely is not None and log / n - likely < lm.GAIN:
            break
        likely = log / n
    c = counted(learn, order)
    n, v, out = sum(c[0].values()), len(c[0]), []
    for i, t in texts:
        got = chances(t, c, order, len(learn), weights)
        out.append((i, held(i), len(t), sum(c[0][(w,)] > 0 for w in t), n, sum(math.log10(o) for o, _, _ in got), sum(math.log10(p) for _, _, p in got)))
    return out


def check(spark, rows, order=3, df=None):
    df = df if df is not None else spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame(sorted({(i,) for i, _ in rows if i is not None}), "doc_id long") if any(i is not None for i, _ in rows) else None
    deleted = {r.doc_id for r in marks.where(lm.spread(F.lit("deleted"), F.col("doc_id")) % lm.DELETED == 0).collect()} if marks else set()
    got = sorted(map(tuple, lm.score_documents(df, order).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))
    want = sorted(plain(rows, order, deleted), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-6, atol=1e-9)
    return got


def texts_of(n, seed=1):
    rng, words = random.Random(seed), ["the", "The", "cat", "dog", "sat", "on", "mat", "ran", "fast", "ÄB", "x y"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))) for i in range(n)]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_equals_plain_counts(spark, order):
    got = check(spark, texts_of(200), order)
    assert sum(r[1] for r in got) > 20


def test_small_chunks_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 64)
    monkeypatch.setattr(lm, "RANGE", 256)
    rows = texts_of(150, 2) + [(3, "the the the"), (3, "the the the"), (None, "the cat"), (None, None), (4, None), (5, ""), (6, " \t\n\x0b\x0c\r "), (900, "the cat sat on the mat " * 300), (901, "x" * 100_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"held": F.lit("?"), "deleted": F.lit(1), "chunk": F.lit(2), "token": F.lit(3)}).repartition(7)
    check(spark, rows, 3, df)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(0, "a b"), (1, "a b c")], [(i, "a b") for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]])
def test_few_rows(spark, rows):
    check(spark, rows)


def test_chances_sum_to_one(spark):
    """Over all known words, the end and one unknown word."""
    c = counted([tokens("a b a c"), tokens("b a"), tokens("a b b")], 3)
    weights = np.full((3, 64), 0.7)
    weights[:, 0] = 0
    for before in (["a", "b"], ["b"], [], ["zz", "a"]):
        total = sum(chances([*before, w], c, 3, 3, weights)[-1][2] for w in ["a", "b", "c", "\x00end", "unknown"])
        assert total == pytest.approx(1)


def test_packed_numbers():
    rng = np.random.default_rng(0)
    for top in (1, 200, 70_000, 2**40, 2**63):
        a = rng.integers(0, top, 1000, dtype=np.uint64)
        assert (lm.restored(lm.squeezed(a)) == a).all()
        assert (lm._restored_sorted(lm._squeezed_sorted(np.sort(a))) == np.sort(a)).all()
    assert len(lm.restored(lm.squeezed(np.zeros(0, np.uint64)))) == 0
