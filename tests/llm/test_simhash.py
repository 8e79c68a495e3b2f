import random

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from hazardgrid.llm import simhash
from hazardgrid.session import stage


def brute_fp(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, most=4):
    fps = [brute_fp(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    low = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}
    return sorted((rows[i][0], fps[i], low[root[i]]) for i in range(len(rows)))


def found(spark, rows, schema="doc_id long, text string"):
    out = simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    return sorted((r.doc_id, r.fp[0] & (1 << 64) - 1, r.component_id) for r in out)


def texts(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(150)]
        for _ in range(5):
            w = list(base)
            w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(" ".join(w))
    rows += ["", None, "one", "One\ttwo", "ONE two", "a b c d", "a b c d", "é " * 5000]
    return list(enumerate(rows))


def test_fingerprints_and_components_match_brute_force(spark):
    rows = texts()
    assert found(spark, rows) == brute_components(rows)


def test_large_keys_are_cut_into_chunks(spark, monkeypatch):
    rows = texts(5)
    monkeypatch.setattr(simhash, "PACK_MEMBERS", 4)
    monkeypatch.setattr(simhash, "PACK_ROWS", 10)
    assert found(spark, rows) == brute_components(rows)


def test_empty_table_nulls_and_clashing_columns(spark):
    assert found(spark, []) == []
    df = spark.createDataFrame([(1, "a b", 5, 6), (None, "a b", 1, 2), (None, "zz", 1, 2)],
                               "doc_id long, text string, id long, fp long")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {(1, 1), (None, 1), (None, None)}


def test_masks_cover_every_close_pair():
    masks = simhash.block_masks(7, 4)
    rng = np.random.default_rng(1)
    for _ in range(2000):
        flip = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(m & flip == 0 for m in masks)


def test_keep_first_keeps_one_of_each_group(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    near = list(base)
    near[40] = "other"
    rows = [(3, " ".join(base)), (1, " ".join(near)), (7, " ".join(base)), (7, " ".join(base)), (9, "alone in here"), (None, "x y"), (None, "x y")]
    left = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or -1) for r in left.collect()) == [-1, 1, 9]


def pairs_at(similar, other, n=25, seed=8):
    """Pairs of texts: per pair ``(shared, own)`` of one-shingle words, so that Jaccard is shared / (shared + 2 own)."""
    rng = random.Random(seed)
    rows = []
    for k in range(2 * n):
        shared, own = similar if k < n else other
        a, b = ([f"p{k}s{i}" for i in range(shared)] + [f"p{k}{side}{i}" for i in range(own)] for side in "ab")
        rng.shuffle(a)
        rng.shuffle(b)
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    return rows


@pytest.mark.parametrize("pack", [2_000_000, 300])
def test_keep_first_keeps_to_the_threshold(spark, monkeypatch, pack):
    """All pairs of exactly 0.8 lose one text, none just below does."""
    monkeypatch.setattr(simhash, "PACK_SHINGLES", pack)
    rows = pairs_at((240, 30), (238, 31))
    left = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), shingle=1).collect()}
    assert left == set(range(0, 50, 2)) | set(range(50, 100))


def test_keep_first_against_all_pairs(spark, monkeypatch):
    """Chains of growing distance, also where keys are cut into chunks."""
    monkeypatch.setattr(simhash, "PACK_SHINGLES", 900)
    rng = random.Random(4)
    rows = []
    for g in range(6):
        words = [f"g{g}w{i}" for i in range(150)]
        for _ in range(12):
            for _ in range(rng.randrange(0, 6)):
                words[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows) * 7 % 73, " ".join(words)))
    rows.append((1000, rows[0][1]))
    sets = {k: {tuple(t.split()[i:i + 5]) for i in range(146)} for k, t in rows}
    root = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if root[a] != root[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    left = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == set(root.values()) and 6 < len(left) < len(rows)


def test_only_sets_that_share_a_key_are_moved(spark, monkeypatch):
    plans, real = {}, simhash.stage

    def watch(df, name, **k):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, name, **k)

    monkeypatch.setattr(simhash, "stage", watch)
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text + " end"), (3, None), (4, "")] + [(i, " ".join(f"x{i}.{k}" for k in range(30))) for i in range(10, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_first(df).collect()) == [1, 3, *range(10, 40)]
    assert plans["near-stars"].count("getbit") >= 2


def test_links_do_not_depend_on_where_the_shingles_come_from(spark):
    """All rows may stand in for the distinct sets, so that these are not moved to be told apart."""
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join([*base[:-1], "x"]), " ".join(base), "a b c d e f g", "a b c d e f g", "q r s t u v", ""]
    rows = simhash.shingle_sets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = stage(rows, "test-sets")
    sets = rows.dropDuplicates(["digest"])
    sets = stage(sets, "test-sets")
    a, b = ({(r.u, r.v) for r in simhash.alike_links(sets, 0.8, more).collect()} for more in (None, rows))
    assert a == b and len(a) == 1


def test_no_task_holds_many_sets_at_once(spark, monkeypatch):
    """Staged sets lie in row groups of bounded size, however many a task writes, and are plain bytes; they are looked through
    once, for those that share a key."""
    groups, shared, real = [], [], simhash.stage

    def watch(df, name, **k):
        out = real(df, name, **k)
        if name == "near-sets":
            assert dict(out.dtypes)["shingles"] == "binary"
            for f in out.inputFiles():
                meta = pq.ParquetFile(f.removeprefix("file://")).metadata
                groups.extend(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups))
        if name == "near-shared":
            shared.append(out.count())
        return out

    monkeypatch.setattr(simhash, "stage", watch)
    monkeypatch.setattr(simhash, "SETS_MB", 1, raising=False)
    rows = [(i, " ".join(f"{i % 399}.{k}" for k in range(1000 + i // 399))) for i in range(400)]
    assert simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).count() == 399
    assert sum(groups) > 3_000_000 and max(groups) < 2_000_000
    assert len(shared) == 1 and 2 <= shared[0] < 40


def test_keep_first_compares_what_near_duplicates_groups(spark, monkeypatch):
    """The operator sees every text, and its groups are candidates where no key of the sets is shared."""
    calls, real = [], simhash.near_duplicates

    def watch(df, *a, **k):
        calls.append((df.count(), k["count"], k["most"]))
        return real(df, *a, **k)

    monkeypatch.setattr(simhash, "near_duplicates", watch)
    monkeypatch.setattr(simhash, "BANDS", 1)
    monkeypatch.setattr(simhash, "BAND_ROWS", 300)
    rows = [*pairs_at((285, 15), (150, 150), n=10), (7, "other"), (7, "more of it"), (None, None)]
    left = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), shingle=1).collect()
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == sorted([*range(0, 20, 2), *range(20, 40)])
    assert len(left) == 31 and calls == [(43, 6, 65)]


@pytest.mark.parametrize("pack", [2_000_000, 300])
def test_keep_first_verifies_what_near_duplicates_groups(spark, monkeypatch, pack):
    """With all texts in one group those of 0.8 are linked, though no key of the sets is shared, and those just below are not."""
    monkeypatch.setattr(simhash, "PACK_SHINGLES", pack)
    monkeypatch.setattr(simhash, "BANDS", 1)
    monkeypatch.setattr(simhash, "BAND_ROWS", 300)
    monkeypatch.setattr(simhash, "near_duplicates", lambda df, id_col, **k: df.withColumn("component_id", F.lit(0)))
    rows = pairs_at((240, 30), (238, 31), n=8)
    left = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), shingle=1).collect()}
    assert left == set(range(0, 16, 2)) | set(range(16, 32))
