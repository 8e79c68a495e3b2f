import random

import pytest

from hazardgrid.llm import decontam, queries

RNG = random.Random(4)
VOCAB = ["the", "of", "and"] * 60 + [f"v{i}" for i in range(2000)]


def prose(n):
    return [RNG.choice(VOCAB) for _ in range(n)]


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_lcs():
    for _ in range(200):
        a, b = ([RNG.choice("abcd") for _ in range(RNG.randrange(0, 90))] for _ in range(2))
        assert decontam.lcs(a, b) == brute_lcs(a, b)


@pytest.fixture(scope="module")
def tables(spark):
    items = [(i, " ".join(prose(RNG.randrange(15, 60))) + ".") for i in range(30)]
    rows, want = [], set()
    for k in range(300):
        ws = prose(RNG.randrange(20, 400))
        if k % 6 == 0:
            i = k // 6 % 30
            part = items[i][1].split()
            if k % 4 == 0:                                 # paraphrase: a fifth of the words replaced
                part = [RNG.choice(VOCAB) if j % 5 == 2 else w for j, w in enumerate(part)]
            at = RNG.randrange(len(ws))
            ws[at:at] = part
            want.add((k, i))
        rows.append((k, " ".join(ws), 1))
    rows += [(1000, None, 1), (1001, "", 1), (None, items[0][1], 1), (1002, items[3][1].upper(), 1), (1002, items[3][1].upper(), 1), (1003, " ".join(prose(30000) + items[5][1].split()), 1)]
    want |= {(None, 0), (1002, 3), (1003, 5)}
    return spark.createDataFrame(rows, "doc_id long, text string, item_id int"), spark.createDataFrame(items + [(None, "x y z"), (77, None), (78, "")], "item_id long, text string"), want


def test_copies_and_paraphrases_are_found_and_others_not(tables):
    docs, items, want = tables
    got = decontam.leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len([r for r in got if r.doc_id == 1002]) == 2


def test_several_rounds_give_the_same(tables, monkeypatch):
    docs, items, want = tables
    monkeypatch.setattr(decontam, "ITEMS_PER_ROUND", 20)
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()} == want


def test_empty_tables(spark, tables):
    docs, items, _ = tables
    assert decontam.leaks(docs.limit(0), items).count() == 0 and decontam.leaks(docs, items.limit(0)).count() == 0
    assert decontam.drop_leaks(docs, items.limit(0)).count() == docs.count()


def test_recall_on_the_small_tables(spark):
    """Against brute force: every document with a benchmark text inside."""
    sf = "/root/testdata/sf0.01"
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    got = {(r.doc_id, r.item_id) for r in queries.op2_decontamination(spark, sf).collect()}
    assert want <= got and len(got) <= len(want) + 5
