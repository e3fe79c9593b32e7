"""Near-duplicate join by the Jaccard similarity of word shingles, with token-combination prefixes."""

from __future__ import annotations

import bisect
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_size, stable
from .components import components, forest
from .shingles import Hasher, mix, set_key, texts

#: A shingle in at least this many texts is frequent (255 at most).
FREQUENT = 64
#: Places of the bitmaps of repeated and of frequent shingles, as powers of two: 16 MB each, growing with
#: the number of tasks that read, from 1,024 on, to 128 MB each. Where they fill up, rare shingles pass for frequent
#: ones and single ones for repeated ones; that costs work and changes no result.
LEAST_BITS, MOST_BITS = 27, 30
#: Tokens of a set's prefix that share a part, on average; only within parts are frequent ones combined.
TOGETHER = 6
#: Sets of a block that is compared in one task, and their tokens.
BLOCK, BLOCK_TOKENS = 256, 4_000_000
#: Sets of a wide cluster that are in all of its blocks.
PIVOTS = 16
#: Tokens counted or indexed before a task hands on what it holds.
HELD = 1_000_000


class _Prefixes:
    """Which tokens of a set go into the index.

    All sets order their tokens alike: those of one document alone first, then rare ones, then
    frequent ones, by hash within each class. Two sets of similarity t share at least l tokens
    among the first n - ceil(t n) + l of each. Rare tokens are indexed singly. Frequent ones are dealt by
    a hash into m parts and indexed in pairs of one part: of l = m + 1 shared tokens either one is rare or two
    frequent ones share a part. m grows with the size, so that a long prefix has no more pairs a token than a short one.
    Both sets must deal alike, so sizes form classes of ratio t, and a set is
    indexed for its own class and for the one below; two sets alike are at most a class apart. A token of one document is shared with none, so it
    takes its place and is not indexed.
    """

    def __init__(self, percent: int, repeated: np.ndarray, frequent: np.ndarray) -> None:
        self.percent, self.repeated, self.frequent = percent, repeated, frequent
        self.shift = np.uint64(64 - (len(repeated) * 8 - 1).bit_length())
        self.bounds = [1]  # least size of each class
        while self.bounds[-1] < 1 << 40:
            self.bounds.append(self.bounds[-1] * 100 // percent + 1)

    def _least_shared(self, n: int) -> int:
        return -(-self.percent * n // 100)

    def parts(self, kind: int) -> int:
        """Parts for the sets of a size class; 0 where one shared token is all that can be counted on."""
        low, high = self.bounds[kind], self.bounds[kind + 1]
        return min(max(1, (high - self._least_shared(high)) // TOGETHER), self._least_shared(low) - 1)

    def _marked(self, s: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
        at = s >> self.shift
        return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0

    def of(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rare tokens, keys of frequent tokens) to index for the sorted set s."""
        n = len(s)
        again = s[self._marked(s, self.repeated)]
        own = bisect.bisect_right(self.bounds, n) - 1
        alone, kinds = n - len(again), [k for k in (own, own - 1) if k >= 0]
        lengths = [n - self._least_shared(n) + 1 + self.parts(k) - alone for k in kinds]
        if max(lengths) <= 0:
            return again[:0], again[:0]
        common = self._marked(again, self.frequent)
        rare, often = again[~common], again[common]
        keys = [again[:0]]
        for kind, length in zip(kinds, lengths, strict=True):
            if length > len(rare):
                keys.append(_combined(often[: length - len(rare)], self.parts(kind), kind))
        return rare[: max(lengths)], np.concatenate(keys)


def _combined(tokens: np.ndarray, parts: int, kind: int) -> np.ndarray:
    """Keys of the pairs of tokens within each part; of single ones where there are no parts."""
    tag = np.uint64(kind * 0x9E3779B97F4A7C15 % 2**64)
    if not parts:
        return mix(tokens + tag)
    part = mix(tokens) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    part, first = part[order], tokens[order] * np.uint64(3) + tag
    second, at, lag, keys = mix(tokens[order]), np.arange(len(tokens)), 1, [tokens[:0]]
    while len(at := at[at + lag < len(part)]) and len(at := at[part[at] == part[at + lag]]):
        keys.append(mix(first[at] + second[at + lag]))
        lag += 1
    return np.concatenate(keys)


def _dealt(kind: str, bits: int, keys: list[np.ndarray], *others: list[np.ndarray]) -> pa.RecordBatch | None:
    """Rows (kind, range, blobs) of the arrays given, dealt by the leading bits of the keys; of a key 32 bits follow."""
    key = np.concatenate(keys)
    order = np.argsort(key)
    key, rest = key[order], [np.concatenate(o)[order] for o in others]
    where = (key >> np.uint64(64 - bits)).astype(np.int64)
    at = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, [len(key)]])
    short = ((key << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
    rows = [(kind, int(where[a]), *[x[a:b].tobytes() for x in (short, *rest)]) for a, b in zip(at[:-1], at[1:], strict=True) if b > a]
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[2:]]], ["kind", "range", "keys", *[f"b{i}" for i in range(len(others))]])


def _counted(bits: int, held: list[np.ndarray]) -> pa.RecordBatch:
    """Rows (range, keys, n) of the different tokens given: the keys' 32 bits after the range; those held
    several times stand last, and n has their numbers (255 at most)."""
    key, n = np.unique(np.concatenate(held), return_counts=True)
    where = (key >> np.uint64(64 - bits)).astype(np.int64)
    order = np.lexsort((n > 1, where))
    key, n, where = key[order], np.minimum(n[order], 255).astype(np.uint8), where[order]
    short = ((key << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
    at = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, [len(key)]])
    rows = [(int(where[a]), short[a:b].tobytes(), n[a:b][n[a:b] > 1].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["range", "keys", "n"])


def _joined(blobs: pd.Series, dtype: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, dtype) for b in blobs])


def _bitmaps(packed: list[tuple[bytes, bytes] | None], places: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bitmaps of `_statistics`, of 2**places bits each; ranges that hold nothing are zero."""
    out = np.zeros((2, len(packed), (1 << (places - 3)) // len(packed)), np.uint8)
    for at, both in enumerate(packed):
        for own, blob in zip(out, both or (), strict=False):
            own[at] = np.frombuffer(pa.decompress(blob, own.shape[1], "zstd"), np.uint8)
    return out[0].reshape(-1), out[1].reshape(-1)


def _statistics(rows: DataFrame, width: int, bits: int, places: int, salt: bytes) -> list[tuple[bytes, bytes] | None]:
    """Bitmaps of the repeated and of the frequent shingles by their leading bits, counted over all documents.

    A pair of compressed parts for each range: most places are empty, so the driver and the broadcast hold a
    small part of the bitmaps' size. Only tasks unpack them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, n = Hasher(width, salt), [], 0
        for b in batches:
            for _, data, offsets in texts(b.column("text")):
                for s in hasher.shingles(data, offsets):
                    held.append(s)
                    n += len(s)
                if n >= HELD:
                    yield _counted(bits, held)
                    held, n = [], 0
        if n:
            yield _counted(bits, held)

    def total(part: pd.DataFrame) -> pd.DataFrame:
        keys = _joined(part["keys"], np.uint32)
        n = np.concatenate([np.concatenate([np.ones(len(k) // 4 - len(c), np.uint8), np.frombuffer(c, np.uint8)]) for k, c in zip(part["keys"], part["n"], strict=True)])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        at = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        n = np.add.reduceat(n.astype(np.int64), at)
        where = (keys[at] >> np.uint32(32 - (places - bits))).astype(np.int64)
        out = [int(part["range"].iloc[0])]
        for least in (2, FREQUENT):
            marks = np.zeros(1 << (places - bits), bool)
            marks[where[n >= least]] = True
            out.append(pa.compress(np.packbits(marks), "zstd", asbytes=True))
        return pd.DataFrame([out], columns=["range", "repeated", "frequent"])

    counted = rows.select("text").mapInArrow(count, "range int, keys binary, n binary").groupBy("range").applyInPandas(total, "range int, repeated binary, frequent binary")
    out: list[tuple[bytes, bytes] | None] = [None] * (1 << bits)
    for r in stable(counted).toLocalIterator():
        out[r["range"]] = bytes(r["repeated"]), bytes(r["frequent"])
    return out


def _index(rows: DataFrame, width: int, bits: int, places: int, percent: int, salt: bytes, statistics: Broadcast) -> DataFrame:
    """The index, as blobs by kind (rare, common) and range of the key: tokens, set keys, set sizes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen, prefixes = Hasher(width, salt), set(), _Prefixes(percent, *_bitmaps(statistics.value, places))
        held: dict[str, list] = {"rare": [[], [], []], "common": [[], [], []]}
        n = dict.fromkeys(held, 0)
        for b in batches:
            for _, data, offsets in texts(b.column("text")):
                for s in hasher.shingles(data, offsets):
                    key = set_key(s)
                    if not key or key in seen:  # copies within a task are indexed once
                        continue
                    seen.add(key)
                    for kind, tokens in zip(held, prefixes.of(s), strict=True):
                        if len(tokens):
                            for x, y in zip(held[kind], (tokens, np.full(len(tokens), key, np.int64), np.full(len(tokens), len(s), np.uint32)), strict=True):
                                x.append(y)
                            n[kind] += len(tokens)
                for kind in held:
                    if n[kind] >= HELD // 2:
                        yield _dealt(kind, bits, *held[kind])
                        held[kind], n[kind] = [[], [], []], 0
        for kind in held:
            if n[kind]:
                yield _dealt(kind, bits, *held[kind])

    return rows.select("text").mapInArrow(emit, "kind string, range int, keys binary, b0 binary, b1 binary")


def _candidates(index: DataFrame, percent: int) -> DataFrame:
    """(kind, u, v): pairs of sets that share a rare key and may be alike by size; for frequent
    keys, no pairs but the edges of a spanning forest of the sets that share any of them."""

    def pairs(part: pd.DataFrame) -> pd.DataFrame:
        token, key, size = _joined(part["keys"], np.uint32), _joined(part["b0"], np.int64), _joined(part["b1"], np.uint32).astype(np.int64)
        order = np.lexsort((key, token))
        token, key, size = token[order], key[order], size[order]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (key[1:] != key[:-1])])
        token, key, size = token[new], key[new], size[new]
        kind = part["kind"].iloc[0]
        if kind == "common":
            first = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1])
            root = np.repeat(key[first], np.diff(np.concatenate([first, [len(token)]])))
            u, v = forest(root[root != key], key[root != key])
            return pd.DataFrame({"kind": kind, "u": u, "v": v})
        us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        at, lag = np.arange(len(token)), 1
        while len(at := at[at + lag < len(token)]) and len(at := at[token[at] == token[at + lag]]):
            fit = np.minimum(size[at], size[at + lag]) * 100 >= np.maximum(size[at], size[at + lag]) * percent
            us.append(key[at[fit]])
            vs.append(key[at[fit] + lag])
            lag += 1
            if lag % 16 == 0:
                us, vs = ([x] for x in _distinct(np.concatenate(us), np.concatenate(vs)))
        u, v = _distinct(np.concatenate(us), np.concatenate(vs))
        return pd.DataFrame({"kind": kind, "u": u, "v": v})

    return index.groupBy("kind", "range").applyInPandas(pairs, "kind string, u long, v long").distinct()


def _distinct(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    return u[new], v[new]


#: Tells the nodes of one kind of cluster from those of the other.
_TAG = 0x5DEECE66D1234567


def _alike(size_a: np.ndarray, size_b: np.ndarray, shared: np.ndarray, percent: int) -> np.ndarray:
    return shared * 100 >= (size_a + size_b - shared) * percent


def _sets(rows: DataFrame, width: int, salt: bytes, wanted: np.ndarray, hashes: int) -> DataFrame:
    """(doc_id, row if there is one, key, n) of every document, and the set itself, once a task, where its key is in the filter `wanted`."""
    names = [c for c in rows.columns if c != "text"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = Hasher(width, salt), set()
        for b in batches:
            for at, data, offsets in texts(b.column("text")):
                sets = list(hasher.shingles(data, offsets))
                keys, sizes, blobs = [set_key(s) for s in sets], [len(s) for s in sets], []
                for key, s, may in zip(keys, sets, _in_filter(wanted, np.array(keys, np.int64), hashes), strict=True):
                    take = may and key and key not in seen
                    blobs.append(s.tobytes() if take else None)
                    if take:
                        seen.add(key)
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(at, len(keys)) for c in names], pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], [*names, "key", "n", "tokens"])

    return rows.mapInArrow(emit, "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in names) + "key long, n long, tokens binary")


def _place(keys: np.ndarray, i: int, bits: int) -> np.ndarray:
    """The i-th of the bits that stand for each key."""
    return mix(keys.view(np.uint64) ^ np.uint64((i + 1) * 0x632BE59BD9B4E019 % 2**64)) & np.uint64(bits - 1)


def _in_filter(bits: np.ndarray, keys: np.ndarray, hashes: int) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for i in range(hashes):
        at = _place(keys, i, len(bits) * 8)
        out &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return out


def _key_filter(keys: DataFrame, largest: int = 1 << 27, hashes: int = 3) -> np.ndarray:
    """A Bloom filter of the column `key`, of 2**27 bits at most: it says yes to all of them and to few others."""
    bits = 1 << 16
    while bits < min(largest, 12 * keys.count()):
        bits *= 2

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for i in range(hashes):
                at = _place(b["key"].to_numpy(np.int64), i, bits)
                np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        step = 1 << 13
        parts = [(i, own[i : i + step].tobytes()) for i in range(0, len(own), step) if own[i : i + step].any()]
        yield pd.DataFrame(parts, columns=["at", "part"]).astype({"at": "int64"})

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        both = np.bitwise_or.reduce([np.frombuffer(p, np.uint8) for p in part["part"]])
        return pd.DataFrame({"at": [part["at"].iloc[0]], "part": [both.tobytes()]})

    out = np.zeros(bits // 8, np.uint8)
    for r in keys.mapInPandas(fill, "at long, part binary").groupBy("at").applyInPandas(merge, "at long, part binary").toLocalIterator():
        out[r["at"] : r["at"] + len(r["part"])] = np.frombuffer(r["part"], np.uint8)
    return out


def _verified_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that are alike; each carries its two sets to one task."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("tu").to_pylist(), b.column("tv").to_pylist(), strict=True):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                keep.append(bool(_alike(len(s), len(t), int((t[at] == s).sum()), percent)))
            yield pa.RecordBatch.from_arrays([b.column("u").filter(pa.array(keep, pa.bool_())), b.column("v").filter(pa.array(keep, pa.bool_()))], ["u", "v"])

    left = pairs.join(sets.select(F.col("key").alias("u"), F.col("tokens").alias("tu")), "u")
    both = left.join(sets.select(F.col("key").alias("v"), F.col("tokens").alias("tv")), "v")
    return both.select("u", "v", "tu", "tv").mapInArrow(check, "u long, v long")


def _clusters(found: DataFrame) -> DataFrame:
    """(kind, node, component, size): clusters of sets joined by candidate pairs, and by frequent keys, each kind on its own."""
    tag = F.when(F.col("kind") == "common", F.lit(_TAG)).otherwise(F.lit(0))
    joined = components(found.select(F.col("u").bitwiseXOR(tag).alias("u"), F.col("v").bitwiseXOR(tag).alias("v")))
    nodes = found.select("kind", F.explode(F.array("u", "v")).alias("node")).distinct()
    placed = stable(nodes.join(joined.withColumnRenamed("node", "tagged"), F.col("node").bitwiseXOR(tag) == F.col("tagged")).drop("tagged"))
    sizes = stable(placed.groupBy("kind", "component").agg(F.count(F.lit(1)).alias("size")))
    return stable(placed.join(sizes, ["kind", "component"]))


def _dealt_out(name: str, count: Column) -> Column:
    """Which of `count` blocks the set called `name` is in."""
    return F.pmod(F.xxhash64(name), F.greatest(F.lit(1), count)).cast("int")


def _met(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) that join, in every meeting, all sets that are alike and not of one component.

    placed: (kind, component, x, y, key, joined): a meeting is named by the first four; joined
    is what the set is known to be joined to. A task holds the sets of one meeting and gives a forest of the links it finds.
    """

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("key")  # a pivot may be in a block of its own too
        key, joined = part["key"].to_numpy(np.int64), part["joined"].to_numpy(np.int64)
        sets_ = [np.frombuffer(t, np.uint64) for t in part["tokens"]]
        size = np.array([len(s) for s in sets_], np.int64)
        token, place = np.concatenate(sets_), np.repeat(np.arange(len(sets_)), size)
        _, token, count = np.unique(token, return_inverse=True, return_counts=True)
        rank = np.full(len(count), -1)
        rank[count > 1] = np.arange((count > 1).sum())
        column = rank[token]
        order = np.argsort(column, kind="stable")
        order = order[np.searchsorted(column[order], 0) :]
        column, place = column[order], place[order]
        shared = np.zeros((len(sets_), len(sets_)), np.float32)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            a, b = np.searchsorted(column, [at, at + 4096])
            has = np.zeros((len(sets_), 4096), np.float32)
            has[place[a:b], column[a:b] - at] = 1
            shared += has @ has.T
        i, j = np.nonzero(np.triu(_alike(size[:, None], size[None, :], shared.astype(np.int64), percent), 1))
        i, j = i[joined[i] != joined[j]], j[joined[i] != joined[j]]
        u, v = forest(key[i], key[j]) if len(i) else (key[:0], key[:0])
        return pd.DataFrame({"u": u, "v": v})

    met = placed.join(sets.select("key", "tokens"), "key")
    return met.groupBy("kind", "component", "x", "y").applyInPandas(meet, "u long, v long")


def _blocks(members: DataFrame) -> DataFrame:
    """(kind, component, x, y, key, joined): each cluster as one block, or several with the same few pivots in all."""
    placed = members.withColumn("x", F.explode(F.when(F.pmod(F.xxhash64("node", F.lit(2)), F.col("size")) < PIVOTS, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(_dealt_out("node", F.col("blocks"))))))
    return placed.select("kind", "component", "x", F.lit(0).alias("y"), F.col("node").alias("key"), F.col("node").alias("joined"))


def _rest(members: DataFrame, joined: DataFrame) -> DataFrame:
    """(kind, component, x, y, key, joined) of clusters of several blocks whose sets are not all joined by now.

    All but the sets of a cluster's largest component meet one another and that component, in
    blocks; two sets of one component never need to.
    """
    wide = members.where("blocks > 1").join(joined.withColumnRenamed("component", "joined"), "node", "left").withColumn("joined", F.coalesce("joined", "node"))
    wide = stable(wide)
    counts = stable(wide.groupBy("kind", "component", "joined").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("tokens")))
    main = counts.groupBy("kind", "component").agg(F.max_by("joined", F.struct("n", "joined")).alias("main"), F.count(F.lit(1)).alias("components"), F.sum("n").alias("all"), F.sum("tokens").alias("all_tokens"), F.max(F.struct("n", "joined", "tokens")).alias("m"))
    main = main.where("components > 1").select("kind", "component", "main", _block_count(F.col("m.n"), F.col("m.tokens")).alias("main_blocks"), _block_count(F.col("all") - F.col("m.n"), F.col("all_tokens") - F.col("m.tokens")).alias("rest_blocks"))
    d = wide.drop("blocks").join(main, ["kind", "component"])
    own = _dealt_out("node", F.when(F.col("joined") == F.col("main"), F.col("main_blocks")).otherwise(F.col("rest_blocks")))
    d = d.withColumns({"own": own, "is_main": F.col("joined") == F.col("main")})
    # x is a block of the rest; y one of the main component (below 0) or a later one of the rest
    rest = F.sequence(F.lit(0), F.col("rest_blocks") - 1)
    as_rest = F.concat(F.transform(F.sequence(F.lit(1), F.col("main_blocks")), lambda y: F.struct(F.col("own").alias("x"), (-y).alias("y"))), F.transform(rest, lambda o: F.struct(F.least(o, F.col("own")).alias("x"), F.greatest(o, F.col("own")).alias("y"))))
    as_main = F.transform(rest, lambda x: F.struct(x.alias("x"), (-F.col("own") - 1).alias("y")))
    return d.withColumn("at", F.explode(F.when(F.col("is_main"), as_main).otherwise(as_rest))).select("kind", "component", "at.x", "at.y", F.col("node").alias("key"), "joined")


def _block_count(sets: Column, tokens: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(sets / BLOCK), F.ceil(tokens / BLOCK_TOKENS)).cast("int")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs.

    Words are runs without white space (space, ASCII 9 to 13), A-Z in lower case. A document's
    set holds its distinct runs of `width` words, or its whole sequence where it has fewer.
    Documents link when 100 * shared >= percent * united; component_id is the least doc_id that
    links reach. Null or empty texts and those without words have no shingles and stand alone.
    Repeated rows count each and share a component. An empty table gives no rows.

    Documents with the same set are one node. Nodes that share a rare shingle of their prefixes
    make candidate pairs; those that share a pair of frequent ones make clusters. Clusters of up to a block
    are compared in one task; pairs whose cluster is wider one by one; wider clusters of frequent
    pairs in blocks that have a few sets in common, and then once more in blocks, but only what
    these have not joined. What links is told by the whole sets. The driver holds two bitmaps and a filter of bounded size.
    """
    out = _grouped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), width, percent)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _grouped(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, row if there is one, key, n, component_id) of (doc_id, row if there is one, text).

    component_id is the least doc_id of the component; with rows the least struct of id (null
    last) and row. Documents without shingles have key 0 and none.
    """
    named_rows, rows, salt = rows, rows.select("doc_id", "text"), os.urandom(16)
    # ranges of the keys: 4 for each task that reads, so that each holds a few million tokens
    tasks = rows.rdd.getNumPartitions()
    bits = min(20, max(8, (4 * tasks - 1).bit_length()))
    places = min(MOST_BITS, max(LEAST_BITS, 17 + (tasks - 1).bit_length()))
    statistics = rows.sparkSession.sparkContext.broadcast(_statistics(rows, width, bits, places, salt))
    found = stable(_candidates(_index(rows, width, bits, places, percent, salt, statistics), percent))
    statistics.destroy()  # found is written, so no task will ask for these again
    members = _clusters(found)
    all_rows = stable(_sets(named_rows, width, salt, _key_filter(members.select(F.col("node").alias("key")).distinct()), 3))
    sets = all_rows.where("tokens IS NOT NULL").groupBy("key").agg(F.first("tokens").alias("tokens"))
    sizes = all_rows.where("tokens IS NOT NULL").groupBy(F.col("key").alias("node")).agg(F.first("n").alias("n"))
    members = members.join(sizes, "node")
    tokens = members.groupBy("kind", "component").agg(F.sum("n").alias("tokens"))
    members = stable(members.join(tokens, ["kind", "component"]).withColumn("blocks", _block_count(F.col("size"), F.col("tokens"))))
    one_by_one = (F.col("kind") == "rare") & (F.col("blocks") > 1)
    links = _met(_blocks(members.where(~one_by_one)), sets, percent)
    wide = members.where(one_by_one).select(F.col("node").alias("u"))
    pairs = found.where("kind = 'rare'").join(wide, "u", "left_semi").select("u", "v")
    joined = components(links.union(_verified_pairs(pairs, sets, percent)))
    frequent = members.where("kind = 'common'")
    if frequent.where("blocks > 1").limit(1).count():
        more = _met(_rest(frequent, joined), sets, percent)
        joined = components(joined.select(F.col("component").alias("u"), F.col("node").alias("v")).union(more))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row") if "row" in all_rows.columns else F.col("doc_id")
    least = all_rows.where("key <> 0").groupBy("key").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("rows"))
    # written before they meet again, so that a join on a large component is a plain one, which AQE can split
    named = stable(least.join(joined.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key")))
    ids = stable(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("sets")))
    count = named.agg(F.count(F.lit(1)), F.sum("rows")).first()
    of_key = by_size(named.select("key", "rows", "component"), ids, "component", "sets", count[0]).select("key", "rows", "component_id")
    narrow, of_key = all_rows.drop("tokens"), stable(of_key)
    empty = narrow.where("key = 0").withColumn("component_id", F.lit(None).cast(of_key.schema["component_id"].dataType))
    return by_size(narrow.where("key <> 0"), of_key, "key", "rows", count[1] or 0).unionByName(empty)


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near duplicates: of each component one row stays, the one of the least id (null: last), then of the least SHA-256 of id and text.

    Rows are told apart by that digest, so rows that repeat an id and those
    without one are judged each by their own text; of rows alike in both, the one whose other columns come first as JSON stays. Rows without
    words stand alone; of those alike in id and text one stays, and all that have no id. Most rows
    are told from the removed ones by a filter and stay where they lie; only those it is unsure of
    are joined by their digest.
    """
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    named = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), F.when(text.isNotNull(), F.concat(F.lit("="), text)))
    row = F.unhex(F.sha2(named.cast("binary"), 256))
    found = _grouped(docs.select(doc_id.alias("doc_id"), row.alias("row"), text.alias("text")), width, percent)
    found = found.where("key <> 0 OR doc_id IS NOT NULL").select("row", F.coalesce("component_id.row", "row").alias("least"))
    rows = stable(found.groupBy("row").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("n")))
    odd = rows.where("row <> least OR n > 1").select("row", "least", "n")
    wanted = _key_filter(odd.select(F.xxhash64("row").alias("key")))

    @F.pandas_udf("boolean")
    def unsure(keys: pd.Series) -> pd.Series:
        return pd.Series(_in_filter(wanted, keys.to_numpy(np.int64), 3))

    marked = docs.withColumn("__row", row).withColumn("__unsure", unsure(F.xxhash64("__row")))
    sure = marked.where("NOT __unsure").drop("__unsure", "__row")
    rest = marked.where("__unsure").drop("__unsure").join(odd.withColumnsRenamed({"row": "__key", "least": "__least", "n": "__n"}), F.col("__row") == F.col("__key"), "left")
    rest = rest.where(F.col("__key").isNull() | (F.col("__key") == F.col("__least"))).drop("__key", "__least")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    others = F.struct(F.lit(0).alias("__no"), *[F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)])
    again = rest.where("__n > 1").groupBy("__row").agg(F.min_by(whole, F.to_json(others)).alias("__kept"))
    return sure.union(rest.where("__n IS NULL OR __n = 1").drop("__n", "__row")).union(again.select("__kept.*"))
