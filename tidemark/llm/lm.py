"""Language-model scores by deleted interpolation: n-gram estimates mixed by context frequency, weights learned on deleted counts."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, spread, stable
from .shingles import Hasher, give_back, mix, texts

#: Tokens in a chunk of documents, and keys in a range of n-grams: what a task holds of either. A longer document is a chunk.
CHUNK, RANGE = 1 << 20, 1 << 20
#: Keys of n-grams above words keep log2(tokens) + SPARE bits, so that one in 2**SPARE / order of them shares its name with another.
SPARE = 22
#: One in so many learning documents is deleted from the counts that weights are learned on.
DELETED = 16
#: Buckets of context frequency: 0, then 1, 2-3, 4-7 and so on.
BUCKETS = 64
#: Rounds of expectation-maximisation at most, and the gain in log likelihood a token that ends them.
ROUNDS, GAIN = 20, 1e-5
#: Weights stay below this, so that every text has a chance.
MOST = 0.9999

#: Hashes that stand for the start and the end of a text among those of words.
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
_PLACES = mix(np.arange(1, 17, dtype=np.uint64)) | np.uint64(1)


def squeezed(a: np.ndarray) -> bytes:
    """Whole numbers, 0 or more, packed: the narrowest kind, byte by byte of significance, compressed."""
    a = a.astype(np.min_scalar_type(int(a.max(initial=0))))
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return bytes([a.itemsize]) + len(a).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def restored(data: bytes) -> np.ndarray:
    size, n = data[0], int.from_bytes(data[1:9], "little")
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(data[9:], decompressed_size=size * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(f"<u{size}").ravel()


def _squeezed_sorted(keys: np.ndarray) -> bytes:
    return squeezed(np.diff(keys, prepend=np.uint64(0)))


def _restored_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(restored(data), dtype=np.uint64)


@dataclass
class _Chunk:
    """Documents whose tokens are numbered within the chunk."""

    ids: list = field(default_factory=list)
    held: list[bool] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    tokens: int = 0

    def add(self, doc_id: int | None, held: bool, words: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.held.append(held)
        self.lengths.append(len(words) + 1)
        self.words += [words, np.array([END])]
        self.tokens += len(words) + 1

    def row(self, name: int, deleted: bool) -> dict:
        vocab, token = np.unique(np.concatenate(self.words), return_inverse=True)
        learned = sum(n for n, h in zip(self.lengths, self.held, strict=True) if not h)
        ids = pa.array(self.ids, pa.int64())
        return {
            "chunk": name, "deleted": deleted, "docs": sum(not h for h in self.held), "learned": learned,
            "ids": squeezed(ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)), "no_id": squeezed(ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)),
            "held": squeezed(np.array(self.held, np.uint8)), "lengths": squeezed(np.array(self.lengths, np.uint64)),
            "vocab": _squeezed_sorted(vocab), "token": squeezed(token.astype(np.uint64)),
        }


_CHUNKS = "chunk long, deleted boolean, docs long, learned long, ids binary, no_id binary, held binary, lengths binary, vocab binary, token binary"


def _batch(rows: list[dict], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in schema], [n for n, _ in schema])


_CHUNK_TYPES = [("chunk", pa.int64()), ("deleted", pa.bool_()), ("docs", pa.int64()), ("learned", pa.int64()), *[(n, pa.binary()) for n in "ids no_id held lengths vocab token".split()]]


def _chunks(docs: DataFrame, key: bytes) -> DataFrame:
    """Chunks of (doc_id, held, deleted, text), written once, bucketed by chunk so that they stay where they are when they
    meet their counts; deleted documents have chunks of their own."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, open_chunks, made = Hasher(1, key), {False: _Chunk(), True: _Chunk()}, 0
        task = TaskContext.get().partitionId() << 32
        for b in batches:
            ids, held, deleted = (b.column(c).to_pylist() for c in ("doc_id", "held", "deleted"))
            for row, data, offsets in texts(b.column("text")):
                word, at = hasher.words(data, offsets)
                for i in range(len(offsets) - 1):
                    own = open_chunks[deleted[row + i]]
                    own.add(ids[row + i], held[row + i], word[at[i] : at[i + 1]])
                    if own.tokens >= CHUNK:
                        yield _batch([own.row(task + made, deleted[row + i])], _CHUNK_TYPES)
                        open_chunks[deleted[row + i]], made = _Chunk(), made + 1
        for kind, own in open_chunks.items():
            if own.tokens:
                yield _batch([own.row(task + made, kind)], _CHUNK_TYPES)
                made += 1
        give_back()

    spark, name = docs.sparkSession, f"tidemark_lm_{uuid.uuid4().hex}"
    written = docs.mapInArrow(gather, _CHUNKS).write.option("path", f"{shared_folder(spark)}/{name}").option("compression", "none")
    written.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk").saveAsTable(name)
    return spark.table(name)


@dataclass
class _Grams:
    """The n-grams of a chunk: for each order the sorted different keys, and which of them ends at each token."""

    lengths: np.ndarray
    held: np.ndarray
    keys: list[np.ndarray]
    at: list[np.ndarray]

    @classmethod
    def of(cls, row, order: int, drop: int) -> _Grams:
        """Of a chunk's row; before its first token a text has START tokens. Keys of more than a word lose their `drop` low bits."""
        vocab, token, lengths = _restored_sorted(row["vocab"]), restored(row["token"]).astype(np.int64), restored(row["lengths"]).astype(np.int64)
        word, total = vocab[token], vocab[token] * _PLACES[0]
        keys, at = [vocab], [token]
        place = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        for k in range(1, order):
            before = np.full(len(token), START)
            before[k:] = word[:-k] if k < len(word) else word[:0]
            before[place < k] = START
            total += before * _PLACES[k]
            u, inverse = np.unique(mix(total + np.uint64(k)) >> np.uint64(drop), return_inverse=True)
            keys.append(u)
            at.append(inverse)
        return cls(lengths, restored(row["held"]).astype(bool), keys, at)


def _slices(keys: np.ndarray, bits: int, width: int) -> list[int]:
    """Bounds of the ranges of sorted keys of `width` bits by their `bits` leading ones."""
    return [0, *np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(width - bits)).tolist(), len(keys)]


_COUNTED = "part long, chunk long, deleted boolean, total binary, kept binary, known long, known_kept long"


def _counts(chunks: DataFrame, order: int, bits: int, drop: int) -> DataFrame:
    """For every chunk and range of keys: counts of its keys over all learning documents (total) and, for chunks of deleted ones, without these (kept).

    A chunk sends each of its keys once, with its own counts, so a frequent n-gram comes once a
    chunk; a range adds up what all chunks send and answers each of them. known: different words of
    the range in learning documents, with and without the deleted ones; on one row of each range.
    """

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        row, out = rows.iloc[0], {c: [] for c in ("part", "chunk", "deleted", "keys", "counts")}
        grams = _Grams.of(row, order, drop)
        learns = np.repeat(~grams.held, grams.lengths)
        for k, (keys, at) in enumerate(zip(grams.keys, grams.at, strict=True)):
            count = np.bincount(at, weights=learns, minlength=len(keys)).astype(np.uint64)
            cut = _slices(keys, bits, 64 - drop if k else 64)
            for r, (a, z) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if z > a:
                    for name, v in zip(out, ((k << bits) + r, row["chunk"], row["deleted"], _squeezed_sorted(keys[a:z]), squeezed(count[a:z])), strict=True):
                        out[name].append(v)
        del grams, learns
        give_back()
        return pd.DataFrame(out)

    def add(group: pd.DataFrame) -> pd.DataFrame:
        keys = [_restored_sorted(k) for k in group["keys"]]
        ends = np.cumsum([0, *map(len, keys)])
        keys, at = np.unique(np.concatenate(keys), return_inverse=True)
        counts = [restored(c) for c in group["counts"]]
        total = np.zeros((2, len(keys)), np.uint64)
        for deleted, c, a, z in zip(group["deleted"], counts, ends[:-1], ends[1:], strict=True):
            total[int(deleted), at[a:z]] += c  # keys of one chunk differ from each other
        kept, gone = total
        known, known_kept = (((kept + gone) > 0).sum(), (kept > 0).sum()) if group["part"].iloc[0] >> bits == 0 else (0, 0)
        out = group[["part", "chunk", "deleted"]].copy()
        places = list(zip(group["deleted"], ends[:-1], ends[1:], strict=True))
        out["total"] = [squeezed((kept + gone)[at[a:z]]) for _, a, z in places]
        out["kept"] = [squeezed(kept[at[a:z]]) if deleted else None for deleted, a, z in places]
        first = np.arange(len(out)) == 0
        out["known"], out["known_kept"] = np.where(first, known, 0), np.where(first, known_kept, 0)
        del keys, at, counts, total, kept, gone
        give_back()
        return out

    asked = chunks.groupBy("chunk").applyInPandas(ask, "part long, chunk long, deleted boolean, keys binary, counts binary")
    return stable(asked.groupBy("part").applyInPandas(add, _COUNTED))


@dataclass
class Totals:
    """Learning documents, their tokens and different tokens."""

    docs: int
    tokens: int
    known: int


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(BUCKETS - 1, np.frexp(context.astype(np.float64))[1])


def _estimates(grams: _Grams, counts: list[np.ndarray], totals: Totals) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(unigram estimate, for each order from 2 the maximum-likelihood estimate and its context's bucket) of every token."""
    first = np.cumsum(grams.lengths) - grams.lengths
    one = (counts[0][grams.at[0]] + 0.5) / (totals.tokens + 0.5 * (totals.known + 1))
    ml, bucket, context = [], [], counts[0][grams.at[0]]
    for k in range(1, len(counts)):
        # how often the tokens before this one stood before any: their own count, or all texts where none is before
        context = np.concatenate([[0], context[:-1]])
        context[first] = totals.docs
        own = counts[k][grams.at[k]]
        ml.append(own / np.maximum(context, 1))
        bucket.append(_bucket(context))
        context = own
    return one, ml, bucket


def _answers(got: pd.DataFrame, grams: _Grams, bits: int, name: str) -> list[np.ndarray]:
    """For each order, the answered counts by key."""
    got = got.sort_values("part")
    out = []
    for k in range(len(grams.keys)):
        parts = [restored(c).astype(np.float64) for c in got.loc[got["part"] // (1 << bits) == k, name]]
        out.append(np.concatenate(parts) if parts else np.zeros(0))
    return out


def mixed(one: np.ndarray, ml: list[np.ndarray], bucket: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """The chance of each token: from the unigram up, each order's estimate joins in with its bucket's weight."""
    p = one
    for k, (m, b) in enumerate(zip(ml, bucket, strict=True)):
        w = weights[k, b]
        p = w * m + (1 - w) * p
    return p


def expected(one: np.ndarray, ml: list[np.ndarray], bucket: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(times a bucket's weight was asked for, times it gave the token, log likelihood) as expected under weights."""
    reached, used = np.zeros(weights.shape), np.zeros(weights.shape)
    steps = [one]
    for k in range(len(ml)):
        w = weights[k, bucket[k]]
        steps.append(w * ml[k] + (1 - w) * steps[-1])
    left = np.ones(len(one))
    for k in reversed(range(len(ml))):
        gave = left * weights[k, bucket[k]] * ml[k] / steps[k + 1]
        reached[k] += np.bincount(bucket[k], weights=left, minlength=BUCKETS)
        used[k] += np.bincount(bucket[k], weights=gave, minlength=BUCKETS)
        left = left - gave
    return reached, used, float(np.log(steps[-1]).sum())


def _learned(chunks: DataFrame, counts: DataFrame, order: int, bits: int, drop: int, totals: Totals) -> np.ndarray:
    """Weights by order and bucket, from the deleted documents' tokens against the counts without these documents."""
    weights = np.full((max(0, order - 1), BUCKETS), 0.5)
    weights[:, 0] = 0
    if order < 2:
        return weights

    def tokens(key, rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        grams = _Grams.of(rows.iloc[0], order, drop)
        one, ml, bucket = _estimates(grams, _answers(got, grams, bits, "kept"), totals)
        return pd.DataFrame({"values": [np.stack([one, *ml]).astype(np.float32).tobytes()], "buckets": [np.stack(bucket).astype(np.uint8).tobytes()]})

    pairs = chunks.where("deleted").groupBy("chunk").cogroup(counts.where("deleted").select("part", "chunk", "kept").groupBy("chunk"))
    records = stable(pairs.applyInPandas(tokens, "values binary, buckets binary"))
    likely = None
    for _ in range(ROUNDS):

        def expect(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            reached, used, log, n = np.zeros(weights.shape), np.zeros(weights.shape), 0.0, 0
            for b in batches:
                for values, buckets in zip(b.column("values"), b.column("buckets"), strict=True):
                    v = np.frombuffer(values.as_buffer(), np.float32).reshape(order, -1).astype(np.float64)
                    r, u, more = expected(v[0], list(v[1:]), list(np.frombuffer(buckets.as_buffer(), np.uint8).reshape(order - 1, -1)), weights)
                    reached, used, log, n = reached + r, used + u, log + more, n + v.shape[1]
            total = np.concatenate([reached.ravel(), used.ravel(), [log, n]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

        got = {r["i"]: r["v"] for r in records.mapInArrow(expect, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
        total = np.array([got.get(i, 0.0) for i in range(2 * weights.size + 2)])
        if not total[-1]:
            break  # nothing was deleted: all weights stay at a half
        reached, used = total[: weights.size].reshape(weights.shape), total[weights.size : -2].reshape(weights.shape)
        weights = np.where(reached > 0, np.minimum(MOST, used / np.maximum(reached, 1e-300)), weights)
        weights[:, 0] = 0
        if likely is not None and total[-2] / total[-1] - likely < GAIN:
            break
        likely = total[-2] / total[-1]
    return weights


def held_out(doc_id: str = "doc_id") -> Column:
    """True for documents that no model may learn from: crc32 of doc_id as text, mod 5, is 1; null ids are none of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Tokens are runs without white space (space, ASCII 9 to 13), A-Z in lower case, then one end. base_score
    is the log10 chance under unigrams, each count raised by a half, all unknown words being one word more. score is that under
    n-grams up to `order`: from the unigram up, the maximum-likelihood estimate of each order joins in with a weight that
    depends on how often its context was seen. The weights are those that make a deleted sixteenth
    of the learning documents likeliest (counts without it), found by expectation-maximisation; the
    counts then cover all learning documents.

    Null texts count as empty: an end alone. Repeated rows count each; a row whose id is null learns and is scored. Without
    learning documents every chance is that of an unknown word. An empty table gives no rows. Words and n-grams are told apart by 64
    bits under a random key.
    """
    if not 1 <= order <= len(_PLACES):
        raise ValueError("order must be 1 to 16")
    key = os.urandom(16)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    d = d.withColumns({"held": held_out(), "deleted": spread(F.lit("deleted"), F.col("doc_id")) % DELETED == 0})
    chunks = _chunks(d.withColumn("deleted", F.col("deleted") & ~F.col("held") & F.col("doc_id").isNotNull()), key)
    sums = {r["deleted"]: r for r in chunks.groupBy("deleted").agg(F.sum("docs").alias("docs"), F.sum("learned").alias("learned")).collect()}
    n_docs, n_tokens = (sum(r[c] for r in sums.values()) for c in ("docs", "learned"))
    gone = sums[True] if True in sums else {"docs": 0, "learned": 0}
    # so many ranges that one holds about RANGE keys: no more keys than tokens come from all chunks for an order
    bits = max(2, (n_tokens * 5 // 4 // RANGE).bit_length())
    drop = max(0, 64 - SPARE - max(bits, n_tokens.bit_length()))
    counts = _counts(chunks, order, bits, drop)
    known = counts.agg(F.sum("known"), F.sum("known_kept")).first()
    totals = Totals(n_docs, n_tokens, known[0] or 0)
    weights = _learned(chunks, counts, order, bits, drop, Totals(n_docs - gone["docs"], n_tokens - gone["learned"], known[1] or 0))

    def score(key, rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]
        grams = _Grams.of(row, order, drop)
        count = _answers(got, grams, bits, "total")
        one, ml, bucket = _estimates(grams, count, totals)
        first = np.cumsum(grams.lengths) - grams.lengths
        no_id = restored(row["no_id"]).astype(bool)
        each = lambda v: np.add.reduceat(v, first)
        out = pd.DataFrame({
            "doc_id": pd.array(restored(row["ids"]).astype(np.uint64).view(np.int64), "Int64"), "held_out": grams.held, "n_tokens": grams.lengths,
            "n_known": each((count[0][grams.at[0]] > 0).astype(np.int64)), "train_tokens": totals.tokens,
            "base_score": each(np.log10(one)), "score": each(np.log10(mixed(one, ml, bucket, weights))),
        })
        out.loc[no_id, "doc_id"] = pd.NA
        del grams, count, one, ml, bucket
        give_back()
        return out

    return chunks.groupBy("chunk").cogroup(counts.select("part", "chunk", "total").groupBy("chunk")).applyInPandas(score, _SCORES)
