"""Every stage of the pipeline against a plain version, and the entry points."""

import os
import re
import shutil

import pytest

import corpus_pipeline as cp
from tidemark.llm import nbsvm
from tidemark.llm.common import table
from tests.llm.test_jaccard import brute
from tests.llm.test_mixing import plain_targets, words
from tests.llm.test_secrets import base

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after each stage, each stage fed with the rows of the one before."""
    docs = table(spark, FOLDER, "documents").persist()
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(stage(spark, out[-1], FOLDER).persist())
    return [d.collect() for d in out]


def test_quality_drops_what_the_model_rejects(spark, stages):
    docs = table(spark, FOLDER, "documents")
    model = nbsvm.train(docs, table(spark, FOLDER, "labels"))
    want = {r.doc_id for r in nbsvm.with_score(docs, model).collect() if r.score >= 0.3}
    assert {r.doc_id for r in stages[1]} == want and 0 < len(want) < len(stages[0])


def test_one_document_of_each_group_stays(stages):
    want = {c for _, _, c in brute([(r.doc_id, r.text) for r in stages[1]])}
    assert sorted(r.doc_id for r in stages[2]) == sorted(want) and len(want) < len(stages[1])


def test_secrets_are_gone_and_the_rest_is_as_it_was(stages):
    before = {r.doc_id: r.text for r in stages[2]}
    assert len(stages[3]) == len(before)
    for r in stages[3]:
        spans = base(before[r.doc_id])
        assert not base(r.text) and r.n_chars == len(r.text)
        if not spans and "[secret]" not in r.text:
            assert r.text == before[r.doc_id]
        for piece in re.split(r"\[secret\]", r.text):
            assert piece in before[r.doc_id]


def test_mix_reaches_each_sources_target(stages):
    size, got = {}, {}
    for r in stages[3]:
        size[r.source] = size.get(r.source, 0) + len(words(r.text))
    for r in stages[4]:
        got[r.source] = got.get(r.source, 0) + len(words(r.text))
    for s, t in plain_targets(size).items():
        assert abs(got.get(s, 0) - t) < 1


def test_packing_holds_every_token_once(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(cp.word_tokenizer())
    want = {}
    for r in stages[4]:
        want.setdefault(r.doc_id, []).append([*t.encode(r.text, add_special_tokens=False).ids, 1])
    tokens = {}
    for r in stages[5]:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens == {k: sum(map(len, v)) for k, v in want.items()}
    load = {}
    for r in stages[5]:
        load[r.sequence_id] = load.get(r.sequence_id, 0) + r.length
    assert max(load.values()) <= 2048


def test_run_gives_the_last_stages_rows(spark, stages, tmp_path):
    # a piece's place depends on which task read its document; all else does not
    pieces = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    folder = str(tmp_path / "run")
    first = pieces(cp.run(spark, FOLDER, folder).collect())
    shutil.rmtree(f"{folder}/4-pack")
    kept = {k: os.path.getmtime(f"{folder}/{k}/_SUCCESS") for k in os.listdir(folder)}
    assert pieces(cp.run(spark, FOLDER, folder).collect()) == first == pieces(stages[5])
    assert len(kept) == 4 and all(os.path.getmtime(f"{folder}/{k}/_SUCCESS") == t for k, t in kept.items())
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "secret_scan", "mix", "pack"]
    for before, after in zip(stages[:4], stages[1:5], strict=True):
        assert before[0].__fields__ == after[0].__fields__
