"""Mixing against a plain statement of its rules."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing

DOCS = "doc_id long, text string, source string, lang string, n_chars long"


def plain_targets(sizes, weights=(5, 2, 1), epochs=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while True:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > epochs * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = epochs * sizes[s]
            left -= target[s]
        free -= over


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def documents(n=300):
    rows = []
    for i in range(n):
        source = [None, "a", "b", "c", "huge", "é"][i % 6] if i % 3 else "huge"
        rows.append((i, None if i % 37 == 0 else "" if i % 41 == 0 else "w" + " w\t" * (i * 7 % 50) + "\x0b", source, "en", 1))
    return rows


def check(rows, got):
    size, by = {r[0]: len(words(r[1])) for r in rows}, {}
    for r in rows:
        by[r[2]] = by.get(r[2], 0) + size[r[0]]
    target = plain_targets(by)
    source = {r[0]: r[2] for r in rows}
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == by[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) < 1
    # within a source the rest goes to documents in the order of their keys, without gaps
    for s in by:
        own = sorted((hashlib.md5(f"17:{r.doc_id}:{r.size}".encode()).hexdigest()[:15], r.doc_id, r.taken, r.size) for r in got if source[r.doc_id] == s)
        whole = int(int(target[s] + 1e-9) // by[s]) if by[s] else 0
        more = [t - whole * z for _, _, t, z in own if z]
        full = [m == z for m, (_, _, _, z) in zip(more, [o for o in own if o[3]])]
        assert full == sorted(full, reverse=True)


def test_plan_equals_the_rules(spark):
    rows = documents()
    d = spark.createDataFrame(rows, DOCS)
    got = mixing.plan_mix(d).collect()
    assert len(got) == len(rows)
    check(rows, got)
    assert sorted(got) == sorted(mixing.plan_mix(d.repartition(7)).collect())


@pytest.mark.parametrize("sizes", [{"a": 1, "b": 1000, "c": 5}, {"a": 10}, {None: 3, "z": 100}, {"a": 0, "b": 0}, {"a": 7, "b": 7, "c": 7, "d": 1, "e": 100000}])
def test_targets(spark, sizes):
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = plain_targets(sizes)
    assert {r.source: r.target for r in got} == {k: pytest.approx(v) for k, v in want.items()}


def test_mixed_documents_follow_the_plan(spark):
    rows = documents(120)
    d = spark.createDataFrame(rows, DOCS)
    want = {r.doc_id: r.taken for r in mixing.plan_mix(d).collect()}
    got = {}
    for r in mixing.mixed(d).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words(r.text))
    assert got == {k: v for k, v in want.items() if v}
    assert mixing.mixed(d).columns == d.columns


def test_empty_repeated_and_null_rows(spark):
    assert mixing.plan_mix(spark.createDataFrame([], DOCS)).count() == 0 and mixing.mixed(spark.createDataFrame([], DOCS)).count() == 0
    d = spark.createDataFrame([(None, "a b", None, None, None)] * 3 + [(1, "a b c", "s", None, None)] * 4, DOCS)
    assert mixing.plan_mix(d).agg(F.sum("taken")).first()[0] == pytest.approx(18, abs=2)
    big = spark.createDataFrame([(1, "w " * 200_000, "s", "en", 1)], DOCS).withColumn("size", F.lit(9)).withColumn("key", F.lit(1))
    assert mixing.plan_mix(big).first().taken == 200_000


@pytest.mark.parametrize("texts", [[f"w{i} b c d e f g" for i in range(30)], ["a b c d e f g"] * 30, ["a b c d e f g"] * 15 + ["b b c d e f g"] * 15])
@pytest.mark.parametrize("doc_id", [None, 4])
def test_cuts_among_rows_without_an_id_or_of_one_id_keep_the_budget(spark, doc_id, texts):
    rows = [(doc_id, t, s, None, None) for s in ("p", "q", "r", None) for t in texts]
    d = spark.createDataFrame(rows, DOCS)
    want, got = {}, {}
    for r in mixing.plan_mix(d).collect():
        want[r.source] = want.get(r.source, 0) + r.taken
    for r in mixing.mixed(d).collect():
        got[r.source] = got.get(r.source, 0) + len(words(r.text))
    assert got == want and any(n % 7 for n in want.values())
