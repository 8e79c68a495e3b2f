import random
from pathlib import Path

import numpy as np
import pytest

from hazardgrid.llm import queries, toxicity
from hazardgrid.llm.common import crc_mod5
from hazardgrid.session import work_folder

BAD = ["rotten", "filthy", "gredlax", "gredmor"]


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(rng.randrange(5, 60))]
        toxic = i % 5 == 1
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), 1))
        if i % 3:
            labels.append((i, int(toxic)))
    rows += [(n, None, 1), (n + 1, "", 1), (None, "you filthy thing", 1), (n + 2, "You FILTHY, filthy!", 1), (n + 2, "You FILTHY, filthy!", 1), (n + 3, "gredzzz " + "x" * 20000, 1)]
    labels += [(None, 1), (1, None), (1, 0), (1, 1)]
    return rows, labels


def test_scores_separate_held_out_rows(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), 0).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    held = [i for i in range(400) if crc_mod5(i) == 0]
    assert np.mean([(by[i].score >= 0.5) == (i % 5 == 1) for i in held]) > 0.98
    assert by[None].score >= 0.5 and by[402].score >= 0.5 and by[400].score == by[401].score < 0.5
    assert all(crc_mod5(e.doc_id) != 0 for r in got for e in r.evidence)
    left = {r.doc_id for r in toxicity.drop_toxic(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert 400 in left and 402 not in left and None not in left


def test_neighbours_are_exact():
    rng = np.random.default_rng(1)
    rows = []
    for i in range(700):
        at = sorted(rng.choice(40, rng.integers(1, 6), replace=False).tolist())
        rows.append((tuple(at), tuple(rng.integers(1, 5, len(at)).tolist()), int(rng.integers(0, 3)), int(rng.integers(0, 3)), i))
    index = toxicity.Index(rows, rng.uniform(1, 5, 40), {0: 1.0, 1: 1.0})
    dense = np.zeros((700, 40))
    place = {int(d): p for p, d in enumerate(index.ids)}
    for r in rows:
        dense[place[r[4]], list(r[0])] = index.weigh(r[0], r[1])
    for r in rows[:100]:
        q = np.zeros(40)
        q[list(r[0])] = index.weigh(r[0], r[1])
        who, score = index.nearest(r[0], r[1], 10)
        assert np.allclose(np.sort(dense @ q)[::-1][:10], score)
        assert np.allclose((dense @ q)[who], score)


@pytest.mark.parametrize("n", [0, 3])
def test_few_or_no_rows(spark, n):
    docs = spark.createDataFrame([(i, "a b") for i in range(n)], "doc_id long, text string")
    assert toxicity.score_documents(docs, spark.createDataFrame([], "doc_id long, toxic int")).count() == n


def test_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op1_toxicity(spark, sf).collect() if r.held_out and r.doc_id in toxic]
    assert np.mean([r.predicted == toxic[r.doc_id] for r in rows]) > 0.9


def test_one_vector_per_example(spark, monkeypatch):
    """An id with many texts is one example."""
    sizes = []
    plain = toxicity.Index.__init__
    monkeypatch.setattr(toxicity.Index, "__init__", lambda self, rows, *more: sizes.append(sum(r[2] + r[3] for r in rows)) or plain(self, rows, *more))
    rows, labels = corpus()
    rows += [(1, f"filthy rotten {'filthy ' * i}", 1) for i in range(500)]
    examples = {k for k, t in labels if k is not None and t is not None}
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    assert toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), None).count() == len(rows)
    assert sizes == [len(examples)]


@pytest.mark.parametrize("toxic", [0, 1])
def test_labels_of_one_class_tell_nothing(spark, toxic):
    docs = spark.createDataFrame([(1, "filthy a"), (2, "b"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, toxic), (2, toxic)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_documents(docs, labels, None).collect()} == {0.0}
    assert toxicity.drop_toxic(docs, labels).count() == 3


def test_every_word_of_an_example_finds_neighbours(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    by = {r.doc_id: r for r in toxicity.score_documents(docs, labels, None).collect()}
    assert all(by[i].evidence for i in range(400))


def test_examples_stay_arrays_on_the_driver(spark, monkeypatch):
    """No Python object for a posting: the lists of all examples are views of the arrays that came from Spark."""
    seen = []
    plain = toxicity.Index.__init__
    monkeypatch.setattr(toxicity.Index, "__init__", lambda self, rows, *more: seen.extend(rows) or plain(self, rows, *more))
    rows, labels = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), None).count()
    assert len(seen) > 1 and all(isinstance(r[k], np.ndarray) and r[k].base is not None for r in seen for k in (0, 1))


def test_index_of_views_and_of_tuples():
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(300, rng.integers(0, 60), False)).astype(np.int32), i % 3, (i + 1) % 2, i) for i in range(400)]
    rows = [(at, rng.integers(1, 9, len(at)).astype(np.int32), x, y, i) for at, x, y, i in rows]
    idf = rng.uniform(1, 5, 300)
    a, b = (toxicity.Index(r, idf, {0: 1.0, 1: 2.0}) for r in (rows, [(tuple(r[0].tolist()), tuple(r[1].tolist()), *r[2:]) for r in rows]))
    assert all(np.array_equal(getattr(a, k), getattr(b, k)) for k in ("ids", "val", "inside", "edge", "block", "top", "entries", "full", "toxic"))
    for r in rows[:20]:
        assert not len(r[0]) or a.nearest(r[0], r[1])[0][0] in range(len(a.ids))


def test_dropping_leaves_only_the_ids_that_go(spark):
    """The vectors of all texts are not kept beside the later stages' tables."""
    folder = Path(work_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    rows, labels = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    left = toxicity.drop_toxic(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {"-".join(p.name.split("-")[:2]) for p in set(folder.iterdir()) - before if p.name.startswith("toxicity-")} == {"toxicity-gone"}
    assert 0 < left.count() < len(rows)
