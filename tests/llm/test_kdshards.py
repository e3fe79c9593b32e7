"""K-d shards: balance, gapless slots, and the splits against a plain tree."""

import random
import zlib

import pytest

from tidemark.llm import kdshards

DOCS = "doc_id long, text string, lang string, source string, shard int"


def shards(spark, rows, n):
    return kdshards.shard_documents(spark.createDataFrame(rows, DOCS), n).collect()


def documents(n, seed=8):
    rnd = random.Random(seed)
    return [(i, "x" * rnd.choice([0, 5, 40, rnd.randint(0, 400)]), rnd.choice(["en", "fr", None]), "hot" if rnd.random() < 0.4 else f"s{rnd.randint(0, 9)}", 0) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_bytes_are_near_equal_and_slots_gapless(spark, n):
    rows = documents(3000)
    got = shards(spark, rows, n)
    load, slots = {}, {}
    for r in got:
        text = rows[r.doc_id][1]
        assert r.size == len(text) + 16 and r.text_crc32 == zlib.crc32(text.encode())
        load[r.shard] = load.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(load) == list(range(n))
    mean = sum(load.values()) / n
    # single texts weigh up to 416 of a mean of some 8,000 and more; equal ones stay together
    assert all(abs(x - mean) <= 0.05 * mean + 60 for x in load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_every_cut_is_at_the_weighted_median_of_the_widest_dimension(spark):
    rng = random.Random(9)
    data = [(i, rng.randint(0, 1000), rng.randint(0, 40), rng.randint(1, 9), i * 7919 % 100003) for i in range(2000)]
    d = spark.createDataFrame(data, "id long, a long, b long, size long, __tie long")
    got = {r.id: r.shard for r in kdshards.kd_shards(d, ["a", "b"], 8).collect()}
    extent = [max(x[k] for x in data) - min(x[k] for x in data) for k in (1, 2)]

    def check(part, first, leaves):
        if leaves == 1:
            assert {got[x[0]] for x in part} == {first}
            return
        spread = [(max(x[k] for x in part) - min(x[k] for x in part)) / extent[k - 1] for k in (1, 2)]
        k = 1 + spread.index(max(spread))
        left = [x for x in part if got[x[0]] < first + leaves // 2]
        right = [x for x in part if got[x[0]] >= first + leaves // 2]
        # in the order of the dimension, then of the hash, all of the left stands before the right
        assert max((x[k], x[4]) for x in left) < min((x[k], x[4]) for x in right)
        want = sum(x[3] for x in part) * (leaves // 2) / leaves
        assert abs(sum(x[3] for x in left) - want) <= 9 + kdshards.TOLERANCE * sum(x[3] for x in data) / 8
        check(left, first, leaves // 2)
        check(right, first + leaves // 2, leaves - leaves // 2)

    check(data, 0, 8)


def test_hot_values_ties_nulls_and_empty(spark):
    same = [(i, "same text", "en", "hot", 0) for i in range(800)]
    load = {}
    for r in shards(spark, same, 8):
        load[r.shard] = load.get(r.shard, 0) + 1
    assert len(load) == 8 and max(load.values()) <= 1.1 * min(load.values()) + 2
    odd = [(None, None, None, None, None)] * 3 + [(1, "é" * 100_000, "en", "a", 1)]
    got = shards(spark, odd, 4)
    assert len(got) == 4 and max(r.size for r in got) == 200_016
    assert not shards(spark, [], 40)
    assert kdshards.shard_documents(spark.createDataFrame(same, DOCS), 8).orderBy("doc_id").collect() == kdshards.shard_documents(spark.createDataFrame(same, DOCS).repartition(5), 8).orderBy("doc_id").collect()


def test_equal_texts_stay_together_and_bytes_come_near(spark):
    rnd = random.Random(4)
    rows, n = [], 0
    for g in range(400):
        text = f"{g} " + "y" * int(rnd.paretovariate(1.1) * 60)
        for _ in range(rnd.choice([1, 1, 1, 2, 3, 8])):
            rows.append((n, text[:6000], rnd.choice(["en", "fr", None]), rnd.choice("abcd"), 0))
            n += 1
    rows += [(n + i, None, "en", rnd.choice("ab"), 0) for i in range(20)] + [(n + 20 + i, "hot text " * 4, rnd.choice(["en", None]), rnd.choice("ab"), 0) for i in range(n // 2)]
    got = shards(spark, rows, 10)
    load, of, weight = {}, {}, {}
    for r in got:
        text = rows[r.doc_id][1]
        load[r.shard] = load.get(r.shard, 0) + r.size
        of.setdefault(text, set()).add(r.shard)
        weight[text] = weight.get(text, 0) + r.size
    leaf = sum(load.values()) / 10
    assert all(len(s) == 1 for t, s in of.items() if weight[t] <= kdshards.WHOLE * leaf)
    assert sum(len(s) > 1 for s in of.values()) <= sum(w > kdshards.WHOLE * leaf for w in weight.values())
    assert all(abs(x - leaf) <= 0.05 * leaf for x in load.values())
