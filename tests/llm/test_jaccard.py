"""Near duplicates against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, jaccard
from tidemark.llm import components as components_module
from tidemark.llm.components import components
from tidemark.llm import shingles as shingling
from tidemark.llm.shingles import Hasher, texts

DOCS = "doc_id long, text string"


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def shingles(text):
    w = plain_words(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    new = lambda n: rnd.choices(vocabulary, k=n)
    out = [None, "", " \t", "a b", "A B", "a  b\n", "x x x x x", "x x x x x x x", "a b c d e", "one two three four", "É é", "é é"]
    for size in (20, 60, 90, 150, 400, 1500):
        for group in (1, 2, 5, 30):
            base = new(size)
            for _ in range(group):
                w = list(base)
                for _ in range(rnd.choice([0, 1, 1, 2, 3, size // 30, size // 20])):
                    w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
                out.append(" ".join(w if rnd.random() < 0.8 else w[: int(len(w) * 0.85)]))
    passage, base = new(50), new(140)
    out += [" ".join(new(rnd.randint(5, 12)) + passage + new(rnd.randint(0, 150))) for _ in range(60)]
    # a large group in which some are alike and others not
    for _ in range(120):
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(140)] = rnd.choice(vocabulary)
        out.append(" ".join(w))
    out += [out[20]] * 40
    rnd.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("frequent", "block", "together", "places"), [(64, 256, 6, 24), (4, 16, 6, 24), (3, 8, 2, 14)])
def test_components_equal_all_pairs(spark, monkeypatch, frequent, block, together, places):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "TOGETHER", together)
    monkeypatch.setattr(jaccard, "MOST_BITS", places)  # 14: all tokens pass for frequent ones
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rows = corpus(frequent)
    d = spark.createDataFrame(rows, DOCS).repartition(5)
    assert sorted(map(tuple, jaccard.near_duplicates(d).collect())) == brute(rows)


def test_one_of_each_keeps_the_least_of_every_group(spark):
    rows = corpus(12)
    d = spark.createDataFrame([(i, t, 7) for i, t in rows], DOCS + ", key int")
    got = jaccard.one_of_each(d)
    assert got.columns == d.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted({c for _, _, c in brute(rows)})
    again = jaccard.one_of_each(d.union(d))
    assert sorted(r.doc_id for r in again.collect()) == sorted({c for _, _, c in brute(rows)})


def test_one_of_each_judges_rows_that_repeat_an_id_or_have_none_by_their_text(spark):
    a, b, c, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abce")
    rows = [(2, a), (5, a + " z"), (5, b), (6, b), (7, c), (7, c), (7, e), (None, e), (None, b + " y"), (None, "q " + c[:50]), (None, "q " + c[:50]), (8, None), (8, None), (None, ""), (None, "")]
    got = jaccard.one_of_each(spark.createDataFrame(rows, DOCS)).collect()
    want = [(2, a), (5, b), (7, c), (7, e), (None, "q " + c[:50]), (8, None), (None, ""), (None, "")]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_nulls_long_texts_and_empty(spark):
    long = "word " * 100_000
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (4, long), (5, long + "x"), (6, None)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(None, 2, 3), (3, 2, 3), (4, 1, 4), (5, 2, 5), (6, 0, 6)}
    assert jaccard.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert jaccard.one_of_each(spark.createDataFrame([], DOCS)).count() == 0


def test_hashes_are_those_of_the_words():
    rnd = random.Random(13)
    lines = ["".join(rnd.choices(["a", "B", "b", " ", "\t", "é", "É", "word", " "], k=rnd.randint(0, 30))) for _ in range(400)] + [None]
    h = Hasher()
    got = [s for _, data, offsets in texts(pa.array(lines)) for s in h.shingles(data, offsets)]
    seen = {}
    for line, s in zip(lines, got, strict=True):
        want = shingles(line)
        assert len(s) == len(want) and (np.diff(s.astype(float)) >= 0).all()
        if len(want) == 1:
            assert seen.setdefault(next(iter(want)), s[0]) == s[0]
    assert len(set(seen.values())) == len(seen)


def complement(n):
    """The Thue-Morse word of n letters and the one with its letters exchanged, which sums of powers can't tell apart."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [16, 256, 1024, 4096])
def test_words_made_to_collide_are_told_apart(spark, n):
    a, b = complement(n)
    got = jaccard.near_duplicates(spark.createDataFrame([(1, a), (2, b), (3, a.upper())], DOCS)).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 1}


def test_slices_part_no_word_and_long_texts_hash_as_short_ones(monkeypatch):
    text = ("é word  other\n" * 40 + "x" * 300 + " ") * 5
    data = np.frombuffer(text.encode(), np.uint8)
    whole = Hasher().words(data, np.array([0, len(data)]))[0]
    monkeypatch.setattr(shingling, "CHUNK", 64)
    assert b"".join(data[a:b].tobytes() for a, b in shingling.slices(data, 64)) == text.encode()
    assert np.array_equal(Hasher().words(data, np.array([0, len(data)]))[0], whole)


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_prefixes_of_sets_alike_share_a_key(percent):
    rng = np.random.default_rng(percent)
    universe = rng.permutation(np.unique(rng.integers(0, 2**63, 7000).astype(np.uint64) * np.uint64(2)))
    for bitmap in (0, 0xAA, 0xFF):  # no frequent tokens, half of them, all
        p = jaccard._Prefixes(percent, np.full(1 << 13, 255, np.uint8), np.full(1 << 13, bitmap, np.uint8))
        for n in (1, 2, 3, 4, 5, 6, 9, 30, 200, 1000, 3000):
            for _ in range(6):
                s = np.sort(rng.choice(universe[:n], n, replace=False))
                extra = int(n * (100 - percent) / percent)
                t = np.sort(np.concatenate([s, rng.choice(universe[n:], extra, replace=False)]))  # just alike
                if len(s) == len(t):
                    continue
                (a, b), (c, d) = p.of(s), p.of(t)
                assert len(np.intersect1d(a, c)) or len(np.intersect1d(b, d))
                assert len(b) <= 8 * n + 8


def test_connected_components_of_chains_stars_and_cycles(spark):
    rnd = random.Random(14)
    edges = [(i, i + 1) for i in range(100, 300)] + [(1000, i) for i in range(1001, 1100)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [(5, 5)]
    edges += [(rnd.randint(5000, 5400), rnd.randint(5000, 5400)) for _ in range(180)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("per_task,held", [(7, 1_000_000), (40, 16), (1_000, 1_000_000)])
def test_components_over_partitions_of_any_size(spark, monkeypatch, per_task, held):
    monkeypatch.setattr(components_module, "HELD", held)
    r = random.Random(per_task)
    edges = [(r.randrange(-90, 90), r.randrange(-90, 90)) for _ in range(70)] + [(1000 + i, 1001 + i) for i in range(60)] + [(3000, 3000 + i) for i in range(50)]
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in label:
        for u, v in edges:
            if u != v:
                label[u] = label[v] = min(label[u], label[v])
    got = components(spark.createDataFrame(edges, "u long, v long").repartition(4), per_task).collect()
    assert len(got) == len(label) and {x.node: x.component for x in got} == label


def test_of_rows_alike_in_id_and_text_the_first_by_its_other_columns_stays(spark):
    rows = [(1, "a b c d e f", s) for s in ("web", "books", None, "news")] + [(2, "other words than those", "web")] * 3 + [(None, "a b c d e f", "x")]
    for parts in (1, 4):
        got = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)).collect()
        assert sorted(map(tuple, got), key=str) == [(1, "a b c d e f", "books"), (2, "other words than those", "web")]


def test_documents_whose_short_hash_is_one_stay_apart(spark, monkeypatch):
    """Rows are told apart by a digest of 256 bits; a hash of 64 bits only says which of them to look at."""
    real = F.xxhash64
    monkeypatch.setattr(jaccard.F, "xxhash64", lambda *c: F.lit(7).cast("long") if len(c) == 1 else real(*c))
    rows = [(1, "a b c d e f"), (2, "u v w x y z"), (3, "a b c d e f"), (4, "quite another text than all these")]
    got = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 4]
