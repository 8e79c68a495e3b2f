import hashlib
import random

import pyarrow.parquet as pq
import pytest

from hazardgrid.llm import queries, substrings

SF = "/root/testdata/sf0.001"


def brute(rows, window=20):
    key = lambda k: substrings._LAST if k is None else k
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (k, _), ws in zip(rows, words):
        for p in range(len(ws) - window + 1):
            w = tuple(ws[p:p + window])
            first[w] = min(first.get(w, (key(k), p)), (key(k), p))
    out = []
    for (k, _), ws in zip(rows, words):
        gone = {p + j for p in range(len(ws) - window + 1) if first[tuple(ws[p:p + window])] < (key(k), p) for j in range(window)}
        out.append((k, len(ws), len(gone), b" ".join(w for i, w in enumerate(ws) if i not in gone).decode()))
    return sorted(out, key=str)


def found(spark, rows, **kw):
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, id int, kept string")
    return sorted((tuple(r) for r in substrings.remove_repeats(df, **kw).collect()), key=str)


def made(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(vocab) for _ in range(rng.randrange(15, 90))] for _ in range(6)]
    rows = []
    for k in range(80):
        ws = [rng.choice(vocab) for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):
            at, p = rng.randrange(len(ws) + 1), rng.choice(passages)
            a = rng.randrange(len(p))
            ws[at:at] = p[a:a + rng.randrange(10, 80)]
        rows.append((k, "  ".join(ws) if k % 2 else "\n".join(ws)))
    return rows + [(200, None), (201, ""), (202, rows[3][1]), (None, rows[4][1]), (None, rows[5][1] + " more"), (203, "a " * 100), (203, "a " * 100), (204, "a " * 30 + "b"),
                   (205, rows[7][1]), (205, rows[8][1]), (-4, rows[9][1]), (206, "x" * 50000)]


@pytest.mark.parametrize("kw", [{}, {"base": 5}, {"window": 12, "base": 3}])
def test_against_brute_force(spark, kw):
    rows = made()
    assert found(spark, rows, **kw) == brute(rows, kw.get("window", 20))


def test_copies_over_several_batches(spark, monkeypatch):
    from hazardgrid.llm import common
    monkeypatch.setattr(common, "TEXTS_PER_BATCH", 3)
    rows = made(2)
    assert found(spark, rows) == brute(rows)


def test_query_on_the_small_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.op8_substrings(spark, SF).collect()), key=str)
    assert got == [(k, n, g, hashlib.sha256(t.encode()).hexdigest()) for k, n, g, t in brute(rows)]


def test_empty_table(spark):
    assert found(spark, []) == [] and substrings.lengths(20, 5) == [5, 10, 20] and substrings.lengths(20, 10) == [10, 20]


def test_texts_without_id_whose_short_hashes_agree(spark):
    """These two have the same xxhash64 modulo 2**31 - 1."""
    shared, other = " ".join(f"p{i}" for i in range(25)), " ".join(f"q{i}" for i in range(30))
    rows = [(1, shared), (None, f"a195013 {shared}"), (None, f"b15112 {other}"), (2, other + " end")]
    assert found(spark, rows[:3]) == brute(rows[:3])
    assert found(spark, rows) == brute(rows)
