"""Packing: exact ids, each once, gapless sequences, little padding."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_jaccard import complement
from tidemark.llm import packing

pytest.importorskip("public_tokenizers")
from tidemark.llm.queries import word_tokenizer  # noqa: E402

DOCS = "doc_id long, text string"
ALPHABET = ["a", "Word", "É", "é", "É", "́", " ", "\n", "\t", "  ", "\u0085", "\x1c", "Σ", "σ", "1", "'s", "'", "!", ",", "...", "<|endoftext|>", "<|ENDOFTEXT|>", "İ", "ﬁ", "日本", "가", "ᄀ", "क़", "ß", "…", "-", "|"]


def encoder():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_tokenizer())


def test_pieces_are_the_tokenizers_ids_and_fill_sequences(spark):
    rnd, t = random.Random(5), encoder()
    texts = [None, "", "word " * 30_000] + ["".join(rnd.choices(ALPHABET, k=rnd.randint(0, 12))) for _ in range(300)] + [" ".join(rnd.choices(["alpha", "Beta,", "gamma.", "délta;", "x"], k=rnd.randint(1, 900))) for _ in range(200)]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3), word_tokenizer(), with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert len(by_doc) == len(texts)
    for i, text in enumerate(texts):
        parts = sorted(by_doc[i], key=lambda r: r.start)
        ids = [x for r in parts for x in r.ids]
        assert ids == [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert [r.start for r in parts] == np.cumsum([0, *[r.length for r in parts]])[:-1].tolist() and all(r.doc_tokens == len(ids) for r in parts)
    for parts in by_seq.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == np.cumsum([0, *[r.length for r in parts]])[:-1].tolist() and sum(r.length for r in parts) <= 2048
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert sum(r.length for r in got) > 0.97 * 2048 * (len(by_seq) - 1)


def test_words_made_to_collide_get_their_own_ids():
    t, words = encoder(), [w for n in (1024, 4096) for w in complement(n)]
    w = packing._Words(word_tokenizer())
    assert w.by_parts and w.folds
    for text in [*words, " ".join(words), "x" * 70_000 + " y"]:
        data = np.frombuffer(text.encode(), np.uint8)
        assert np.frombuffer(next(w.ids(data, np.array([0, len(data)]))), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_a_tokenizer_that_keeps_white_space_encodes_whole_texts(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.BPE({chr(i): i for i in range(32, 127)} | {"ab": 200, " ab": 201}, [("a", "b"), (" ", "ab")]))
    t.pre_tokenizer = pre_tokenizers.Split("|", "removed")
    t.save(str(tmp_path / "t.json"))
    w = packing._Words(str(tmp_path / "t.json"))
    assert not w.by_parts
    data = np.frombuffer(b"ab ab", np.uint8)
    assert np.frombuffer(next(w.ids(data, np.array([0, 5]))), "<u4").tolist() == t.encode("ab ab").ids == [200, 201]


def test_cut_covers_every_length():
    for n in [*range(6000), 10**6 + 1]:
        parts = packing.cut(n, 2048)
        assert sum(parts) == n and all(0 < p <= 2048 for p in parts) and len(parts) <= n // 2048 + 6


def test_first_fit_places_all_leftovers():
    totals = {1: 5000, 2: 1023, 64: 31, 512: 7, 1024: 1, 2048: 9, 682: 2}
    placed, used = packing.first_fit(totals, 2048)
    assert len(placed) == sum(n % (2048 // k) for k, n in totals.items())
    load = {}
    for length, _, seq, at in placed:
        assert at == load.get(seq, 0)
        load[seq] = at + length
    assert max(load.values()) <= 2048 and len(load) == used


def test_empty_repeated_rows_and_sequences(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), word_tokenizer()).count() == 0
    d = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (None, None)], DOCS).withColumn("length", F.lit(1))
    p = packing.pack(d, word_tokenizer(), with_ids=True)
    assert p.count() == 3 and p.select("sequence_id", "offset").distinct().count() == 3
    s = packing.sequences(p).collect()
    assert sum(r.n for r in s) == 9 and all(len(r.input_ids) == 2048 or r.n.bit_count() == 1 for r in s)
