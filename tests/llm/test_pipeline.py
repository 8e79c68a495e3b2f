"""The pipeline against brute-force versions of its stages on the small tables."""

import re

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from hazardgrid.llm import personal

SF = "/root/testdata/sf0.001"


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for name, work in corpus_pipeline.STAGES:
        after = corpus_pipeline.stage(work(spark, docs, SF), "test-" + name)
        if name != "sentencepiece":
            assert after.columns == columns
        out.append((name, {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in after.collect()}))
        docs = after
    return {name: (before, after) for name, before, after in out}


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    near = lambda a, b: len(a & b) / len(a | b)
    sets = {k: shingles(r.text) for k, r in before.items()}
    for k in before.keys() - after.keys():
        assert max(near(sets[k], sets[j]) for j in before if j < k) > 0.7
    kept = sorted(after)
    close = [(a, b) for i, a in enumerate(kept) for b in kept[i + 1:] if near(sets[a], sets[b]) > 0.88]
    assert not close


def test_leaks_and_personal_data(spark, stages):
    before, after = stages["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert before.keys() - after.keys() == {k for k, r in before.items() if any(i in r.text for i in items)}
    before, after = stages["personal_data"]
    assert all(after[k].text == personal.masked(r.text) and after[k].n_chars == len(after[k].text) for k, r in before.items())
    assert not any(re.search(r"[\w.]@\w+\.\w", r.text) for r in after.values())


def test_tokens(stages):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    before, after = stages["sentencepiece"]
    assert before.keys() == after.keys()
    assert all(after[k].ids == lib.encode(r.text, add_eos=True) and after[k].decoded == lib.decode(after[k].ids) for k, r in before.items())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, "x", 1), (1, "", "x", None), (1, "", None, None), (2, "a b", "y", 9)], "doc_id long, text string, id string, n_chars long")
    for name, work in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(work(spark, docs, SF), "test-odd")
        empty = work(spark, spark.createDataFrame([], "doc_id long, text string, id string, n_chars long"), SF)
        assert empty.count() == 0
    assert docs.count() >= 2
