"""Quality classifier: accuracy on held-out rows, what it may see, and its solver."""

import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import nbsvm
from tidemark.llm.common import table
from tidemark.llm.queries import op7_quality
from tidemark.llm.shingles import Hasher

FOLDER = "/root/testdata/sf0.01"
here = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@here
def test_held_out_accuracy(spark):
    got = op7_quality(spark, FOLDER).join(table(spark, FOLDER, "labels"), "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    out = got[got["held_out"]]
    assert ((out["score"] >= 0.3) == out["predicted"]).all() and out["score"].between(0, 1).all()
    assert (out["predicted"] == out["quality"]).mean() > 0.95


@here
def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    a = nbsvm.train(docs, labels)
    b = nbsvm.train(docs.withColumn("lang", F.lit("x")), labels.withColumn("quality", F.when(nbsvm.held_out(), 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert np.array_equal(a.weights, b.weights) and a.shift == b.shift


def test_indicators_are_those_of_the_text_alone():
    texts = ["", "abc", "the the the cat", "xyz é", "a" * 3_000_000]
    together = list(nbsvm.indicators(pa.array(texts), Hasher()))
    alone = [next(nbsvm.indicators(pa.array([t]), Hasher())) for t in texts]
    assert all(np.array_equal(x, y) for x, y in zip(together, alone, strict=True))
    assert len(together[0]) == 0 and {nbsvm.RUNS, nbsvm.RUNS + 1} <= set(together[2].tolist()) and nbsvm.RUNS not in together[1]


def test_descent_reaches_the_optimum_of_its_loss():
    rng = np.random.default_rng(7)
    rows = [np.unique(rng.integers(0, 40, 8)).astype(np.uint16) for _ in range(80)]
    y = np.array([int(3 in r or 5 in r) for r in rows])
    r = nbsvm.log_count_ratios(rows, y)
    w, b = nbsvm.dual_coordinate_descent(rows, y, r, epochs=400)
    x = np.zeros((80, 41))
    for i, f in enumerate(rows):
        x[i, f] = r[f] / np.sqrt((r[f] ** 2).sum())
    x[:, 40] = 1
    cost = 0.5 / np.array([(y == 0).mean(), (y == 1).mean()])[y]
    s = np.where(y > 0, 1.0, -1.0)

    def gradient(v):
        slack = np.maximum(0, 1 - s * (x @ v))
        return v - 2 * (cost * slack * s) @ x

    v = np.append(np.divide(w[:40], r[:40], out=np.zeros(40), where=r[:40] != 0), b)
    assert np.abs(gradient(v)).max() < 1e-3


def test_one_class_no_rows_nulls_and_extra_columns(spark):
    docs = spark.createDataFrame([(i, None if i == 3 else "" if i == 4 else f"text {i}", 0.5) for i in range(10)], "doc_id long, text string, score double")
    for labels in ([], [(i, 1) for i in range(10)], [(i, None) for i in range(10)], [(None, 1)], [(i, i % 2) for i in range(10)] * 2):
        m = nbsvm.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        got = nbsvm.with_score(docs, m).collect()
        assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    assert nbsvm.with_score(docs.limit(0), m).count() == 0


# the whole score once more, text by text, with sets and dictionaries


def plain_found(text):
    data, m = (text or "").encode(), 0xFFFFFFFF
    a, b = 2654435761, 2246822519

    def bucket(x):
        return (((x ^ (x >> 13)) * a & m) >> 9) % nbsvm.RUNS

    out = set(data)
    two = [(x * a + y * b) & m for x, y in zip(data, data[1:])]
    out |= {bucket(x) for x in two}
    out |= {bucket((((x ^ (x >> 15)) * a & m) + z * b) & m) for x, z in zip(two, data[2:])}
    words, longest, run = [w.lower() for w in "".join(c if c not in "\x0b\x0c" else " " for c in (text or "")).split()], 0, 0
    for x, y in zip(words, words[1:]):
        run = run + 1 if x == y else 0
        longest = max(longest, run)
    return out | {nbsvm.RUNS + n for n in range(min(longest, 8))}


def plain_ratios(sets, labels):
    count = [{}, {}]
    for s, y in zip(sets, labels, strict=True):
        for f in s:
            count[y][f] = count[y].get(f, 1) + 1
    total = [sum(c.values()) + nbsvm.BUCKETS - len(c) for c in count]
    return lambda f: np.log((count[1].get(f, 1) / total[1]) / (count[0].get(f, 1) / total[0]))


def plain_weights(sets, labels, ratio):
    good = sum(labels) / len(labels)
    slack = [1 / (nbsvm.COST / max(1e-9, good if y else 1 - good)) for y in labels]
    rows = []
    for s in sets:
        length = max(1e-9, sum(ratio(f) ** 2 for f in s) ** 0.5)
        rows.append({f: ratio(f) / length for f in s})
    w, b, alpha, order = {}, 0.0, [0.0] * len(rows), np.random.default_rng(5)
    for _ in range(nbsvm.EPOCHS):
        for i in order.permutation(len(rows)).tolist():
            y = 1 if labels[i] else -1
            gradient = y * (sum(w.get(f, 0.0) * v for f, v in rows[i].items()) + b) - 1 + alpha[i] * slack[i]
            after = max(0.0, alpha[i] - gradient / (2 + slack[i]))
            for f, v in rows[i].items():
                w[f] = w.get(f, 0.0) + (after - alpha[i]) * y * v
            b, alpha[i] = b + (after - alpha[i]) * y, after
    return w, b


def plain_margin(s, w, b, ratio):
    length = max(1e-9, sum(ratio(f) ** 2 for f in s) ** 0.5)
    return sum(w.get(f, 0.0) * ratio(f) for f in s) / length + b


def test_scores_equal_a_plain_version(spark):
    rng = np.random.default_rng(12)
    good, bad = ["river", "stone", "walked", "slowly", "Evening", "light"], ["buy", "now", "click", "CLICK", "win", "$$$", "river"]
    rows = [(i, " ".join(rng.choice(good if i % 3 else bad) for _ in range(int(rng.integers(1, 12)))), int(i % 3 > 0) if i % 17 else 1) for i in range(90)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5, rows[5][1]), (None, "no id"), (200, None), (201, ""), (202, "win win win win")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    got = {(r.doc_id, r.text): r.score for r in nbsvm.with_score(docs, nbsvm.train(docs, labels)).collect()}
    learn = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    sets, ys = [plain_found(t) for t, _ in learn], [y for _, y in learn]
    margins = [0.0] * len(sets)
    for k in range(nbsvm.FOLDS):
        own = [i for i in range(len(sets)) if i % nbsvm.FOLDS != k]
        ratio = plain_ratios([sets[i] for i in own], [ys[i] for i in own])
        w, b = plain_weights([sets[i] for i in own], [ys[i] for i in own], ratio)
        for i in range(k, len(sets), nbsvm.FOLDS):
            margins[i] = plain_margin(sets[i], w, b, ratio)
    # the logistic curve: the least of its penalised loss, by a search that halves its steps
    n1 = sum(ys)
    target = [(n1 + 1) / (n1 + 2) if y else 1 / (len(ys) - n1 + 2) for y in ys]

    def loss(p):
        z = np.clip(p[0] * np.array(margins) + p[1], -30, 30)
        return float((np.log1p(np.exp(z)) - np.array(target) * z).sum() + 5e-4 * ((p[0] - 1) ** 2 + p[1] ** 2))

    p, step = [1.0, 0.0], 1.0
    while step > 1e-9:
        moves = [[p[0] + a * step, p[1] + c * step] for a in (-1, 0, 1) for c in (-1, 0, 1)]
        best = min(moves, key=loss)
        p, step = (best, step) if loss(best) < loss(p) else (p, step / 2)
    ratio = plain_ratios(sets, ys)
    w, b = plain_weights(sets, ys, ratio)
    for (_, text), score in got.items():
        want = 1 / (1 + np.exp(-(max(0.0, p[0]) * plain_margin(plain_found(text), w, b, ratio) + p[1])))
        assert score == pytest.approx(want, abs=2e-4)
