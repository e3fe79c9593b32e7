"""Harmonic packing of tokenized documents into sequences of a fixed capacity."""

from __future__ import annotations

import os
import sys
import types
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stable
from .shingles import CHUNK, LOWER, hash_runs, slices, texts, word_bounds

#: Pieces up to this many tokens are not cut further: a class for each length.
TAIL = 64
#: Words whose ids a worker remembers, until it starts anew.
REMEMBERED = 1_000_000

def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n tokens: whole sequences, then ever smaller unit shares of one.

    A share floor(capacity / k) fills a sequence in k copies but for k - 1 tokens at most. The
    rest after the largest share that fits is less than a k-th of it, so a few pieces are enough.
    """
    out = [capacity] * (n // capacity)
    n %= capacity
    while n > TAIL:
        k = capacity // n
        k += capacity // k > n
        out.append(capacity // k)
        n -= out[-1]
    return out + [n] * (n > 0)


# classes of bytes: white space, letters, punctuation, anything else
_LETTER, _MARK, _OTHER = 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[list(b"!#$%&()*+,-./:;=?@")] = _MARK

#: Texts by which a tokenizer shows whether the ids of parts add up to those of whole texts.
_PROBES = ["Alpha beta, gamma.\n\tdelta's  (x) ABC! 1,2 a-b", "One two\r\n\r\n three;four :five...", " Leading and trailing ", "É日本, <s> x<y </s> e\u0301 \u0301f ﬁx", "word " * 40, "CamelCase UPPER lower, MiXed."]


def _parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every part: words, but ASCII letters and the ASCII punctuation after them are two."""
    start, end = word_bounds(data, offsets)
    kind = _CLASS[data]
    seen = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
    letters, others = seen(kind == _LETTER), seen(kind == _OTHER)
    back = np.zeros(len(data), bool)
    back[1:] = (kind[1:] == _LETTER) & (kind[:-1] == _MARK)
    back = seen(back)
    n = letters[end] - letters[start]
    # letters, then marks: nothing else, and no letter after a mark
    split = (n > 0) & (n < end - start) & (others[end] == others[start]) & (back[end] == back[start]) & (kind[start] == _LETTER)
    place = np.arange(len(start)) + np.cumsum(split) - split
    a, b = np.empty(len(start) + int(split.sum()), np.int64), np.empty(len(start) + int(split.sum()), np.int64)
    a[place], b[place] = start, np.where(split, start + n, end)
    a[place[split] + 1], b[place[split] + 1] = (start + n)[split], end[split]
    return a, b


class _Words:
    """Ids of parts of words, each looked up by 128 bits under keys of this process, so that no text can be
    made to take another part's ids; a part that is new is encoded.

    Parts add up to whole texts if the tokenizer drops white space, lets no token span it and
    parts letters from punctuation. Whether it does, and whether it ignores case, it shows on
    probes; another one encodes whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keys = Tokenizer.from_file(path), (os.urandom(16), os.urandom(16))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # case counts in special tokens, which all hold a `<`
        special = all("<" in t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        one = lambda t: self.encode([t])[0].tolist()
        self.folds = special and all(one(w.upper()) == one(w) for p in _PROBES for w in p.split() if w.isascii() and "<" not in w)
        self.model_alone = self.folds and all([t.id for t in self.tokenizer.model.tokenize(w.lower())] == one(w) for p in _PROBES for w in p.split() if w.isascii() and w.isalpha())
        self.by_parts = True
        self._forget()
        for p in _PROBES:
            data = np.frombuffer(p.encode(), np.uint8)
            own = [data[a:b].tobytes().decode() for a, b in zip(*_parts(data, np.array([0, len(data)])), strict=True)]
            self.by_parts &= one(p) == [i for part in self.encode(own) for i in part.tolist()]

    def _forget(self) -> None:
        """Names in order, and for each the place of its ids in `flat`: some 30 bytes a word."""
        self.known, self.check, self.start, self.count = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.uint16)
        self.flat, self.used = np.zeros(1 << 18, np.uint16 if len(self.ends) <= 1 << 16 else np.uint32), 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, parts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(parts)
        plain, rest, tokenize = [], [], self.tokenizer.model.tokenize
        for i, p in enumerate(parts):
            if p.isascii() and p.isalpha() and self.model_alone:
                out[i] = np.array([t.id for t in tokenize(p.lower())], np.uint32)
            elif unicodedata.normalize("NFC", p).isalpha() and unicodedata.normalize("NFC", p.lower()).isalpha():
                plain.append(i)
            else:
                rest.append(i)
        if plain:
            ids = self.encode([" ".join(parts[i] for i in plain)])[0]
            at = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
            if len(at) - 1 == len(plain):  # a part has an end at least, so each has one
                for i, a, b in zip(plain, at[:-1], at[1:], strict=True):
                    out[i] = ids[a:b]
            else:
                rest += plain
        for i, ids in zip(rest, self.encode([parts[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _learn(self, names: np.ndarray, check: np.ndarray, parts: list[str]) -> None:
        """Adds parts under their names, which are in order and new."""
        found = self._encoded(parts)
        count = np.array([len(f) for f in found], np.int64)
        if count.max() >= 1 << 16:
            self.count = self.count.astype(np.uint32)
        total = int(count.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = np.concatenate(found)
        at = np.searchsorted(self.known, names)
        self.start = np.insert(self.start, at, self.used + np.cumsum(count) - count)
        self.count, self.check, self.known = np.insert(self.count, at, count), np.insert(self.check, at, check), np.insert(self.known, at, names)
        self.used += total

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        """The ids of each text of the buffer, little-endian; a long text is encoded in slices."""
        if not self.by_parts:
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                yield self._whole(data[a:b])
        elif len(data) > 2 * CHUNK and len(offsets) == 2:
            yield b"".join([next(self._by_parts(data[a:b], np.array([0, b - a]))) for a, b in slices(data)])
        else:
            yield from self._by_parts(data, offsets)

    def _whole(self, data: np.ndarray) -> bytes:
        return self.encode([data.tobytes().decode("utf-8", "replace")])[0].astype("<u4").tobytes()

    def _by_parts(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        a, b = _parts(data, offsets)
        same = data
        if self.folds:
            same = LOWER[data]
            # case counts beside a `<`
            tags = np.concatenate([[0], np.cumsum(data == 60, dtype=np.int32)])
            for i in np.flatnonzero(tags[b] > tags[a]).tolist():
                same[a[i] : b[i]] = data[a[i] : b[i]]
        name, check = (hash_runs(same, a, b, k) for k in self.keys)
        kinds, example, which = np.unique(name, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.known, kinds)
        new = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] != kinds) if len(self.known) else np.arange(len(kinds))
        if len(new):
            raw, one = data.tobytes(), example[new]
            self._learn(kinds[new], check[one], [raw[i:j].decode("utf-8", "replace") for i, j in zip(a[one].tolist(), b[one].tolist(), strict=True)])
        slots = np.searchsorted(self.known, kinds)[which]
        if (self.check[slots] != check).any():  # parts that share a name; two of a million do so with a chance of 3e-8
            for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                yield self._whole(data[x:y])
            return
        count = self.count[slots].astype(np.int64)
        done = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(self.start[slots] - done[:-1], count) + np.arange(done[-1])].astype("<u4").tobytes()
        edges = (4 * done[np.searchsorted(a, offsets)]).tolist()
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            yield ids[x:y]


def _words(path: str) -> _Words:
    """This worker's memory of words, which outlives the task."""
    kept = sys.modules.setdefault("_tidemark_words", types.ModuleType("_tidemark_words"))
    if getattr(kept, "path", None) != path:
        kept.path, kept.words = path, _Words(path)
    return kept.words


def encode_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: doc_id, start, length, ids_crc32, doc_tokens, and
    task and nth, which number the pieces of one length within a task of this stage.

    Null texts are empty; every document ends with end_id, so each has a piece. Whole texts are
    encoded, however long. with_ids adds the ids themselves.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, nth long" + ", ids array<int>" * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, nth, task = _words(tokenizer), defaultdict(int), TaskContext.get().partitionId()
        for b in batches:
            docs = b.column(0).to_pylist()
            for at, data, offsets in texts(b.column(1)):
                rows: list[tuple] = []
                for doc, ids in zip(docs[at : at + len(offsets) - 1], words.ids(data, offsets), strict=True):
                    ids, start = ids + end, 0
                    for length in cut(len(ids) // 4, capacity):
                        part = ids[4 * start : 4 * (start + length)]
                        rows.append((doc, start, length, zlib.crc32(part), len(ids) // 4, task, nth[length], *[np.frombuffer(part, "<u4").astype(np.int32)] * with_ids))
                        nth[length] += 1
                        start += length
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth"] + ["ids"] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def first_fit(totals: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Places for the pieces that fill no sequence of their class: (length, rank, sequence, offset), and the sequences used.

    A class leaves fewer than k pieces, so all of them are a few thousand, however many documents there are.
    """
    room: list[int] = []
    out, start = [], 0
    for length in sorted(totals, reverse=True):
        k, start = capacity // length, 0
        for rank in range(totals[length] // k * k, totals[length]):
            while start < len(room) and room[start] < length:
                start += 1
            if start == len(room):
                room.append(capacity)
            out.append((length, rank, start, capacity - room[start]))
            room[start] -= length
    return out, len(room)


def place(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces with sequence_id and offset: k = capacity // length pieces of a length to a sequence.

    The pieces must be numbered by task and nth (see encode_pieces) and reread alike. Counts by
    task and length give each task the rank of its first piece of each length, and with it all
    places: tasks fill sequences without waiting for one another, and one sequence of
    a length at most stays short in the whole. These few leftovers are placed first fit by
    decreasing length.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    base, first = [0] * (capacity + 1), 0
    for length in sorted(totals, reverse=True):
        base[length], first = first, first + totals[length] // (capacity // length)
    left, _ = first_fit(totals, capacity)
    rest = spark.createDataFrame([(length, rank, first + seq, at) for length, rank, seq, at in left], "length long, __rank long, __seq long, __at long")
    k = F.expr(f"{capacity} div length")
    ranked = pieces.join(starts, ["length", "task"]).withColumn("__rank", F.col("__before") + F.col("nth"))
    placed = ranked.join(F.broadcast(rest), ["length", "__rank"], "left")
    full = F.element_at(F.array(*[F.lit(b).cast("long") for b in base]), (F.col("length") + 1).cast("int"))
    placed = placed.withColumn("sequence_id", F.coalesce("__seq", full + F.expr(f"__rank div ({capacity} div length)")))
    placed = placed.withColumn("offset", F.coalesce("__at", F.pmod(F.col("__rank"), k) * F.col("length")))
    return placed.drop("__before", "__rank", "__seq", "__at", "task", "nth")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = stable(encode_pieces(docs, tokenizer, capacity, end_id, with_ids=with_ids))
    out = place(pieces, capacity)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)


def sequences(packed: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, input_ids, n): the ids of each sequence in order, padded to the capacity unless n is a power of two."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    out = parts.select("sequence_id", ids.alias("ids")).withColumn("n", F.size("ids"))
    pad = F.when(F.bit_count("n") == 1, 0).otherwise(F.lit(capacity) - F.col("n"))
    return out.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), pad.cast("int"))).alias("input_ids"), "n")
