import hashlib
import random

import numpy as np
import pytest

from hazardgrid.llm import exact
from hazardgrid.llm.perfect_hash import PerfectHash, as_words


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        real = [i for i in ids if i is not None]
        keep = max(real, default=None)
        ordered = sorted(ids, key=lambda i: (i == keep, i is not None))
        out += [(i, keep, len(ids), k == len(ids) - 1, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ordered)]
    return sorted(out, key=str)


def found(spark, rows, history=None, schema="doc_id long, text string"):
    old = None if history is None else spark.createDataFrame(history, schema)
    out = exact.deduplicate(spark.createDataFrame(rows, schema), old).collect()
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in out), key=str)


def test_every_member_has_its_own_slot():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 70, 5000):
        words = rng.integers(0, 1 << 63, (n, 4), np.uint64)
        hashed = PerfectHash.from_bytes(PerfectHash.build(words).to_bytes())
        assert sorted(hashed.find(words).tolist()) == list(range(n))
        strangers = rng.integers(0, 1 << 63, (100, 4), np.uint64)
        assert (hashed.find(strangers) < n).all()


def test_keys_that_no_level_parts_stay_beside_them(monkeypatch):
    monkeypatch.setattr("hazardgrid.llm.perfect_hash.LEVELS", 1)
    words = as_words(np.frombuffer(b"".join(hashlib.sha256(bytes([i])).digest() for i in range(200)), np.uint8))
    hashed = PerfectHash.from_bytes(PerfectHash.build(words).to_bytes())
    assert len(hashed.rest) and sorted(hashed.find(words).tolist()) == list(range(200))


def test_groups_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exact, "SHARD_DIGESTS", 40)
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot", f"t{rng.randrange(60)}", f"u{i}", "", None, "Hot", "hot "])) for i in range(600)]
    rows += [(600, "long " * 200_000), (601, "long " * 200_000), (-5, "u1")]
    rng.shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_history_is_looked_up(spark, monkeypatch):
    monkeypatch.setattr(exact, "SHARD_DIGESTS", 10)
    history = [(i, f"t{i % 25}") for i in range(50)]
    rows = [(i, f"t{i % 40}") for i in range(30, 130)] + [(1, "t2"), (2, "new")]
    assert found(spark, rows, history) == brute(history + rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a"), (None, "a"), (None, None)], [(3, "a"), (3, "a"), (None, "a")]])
def test_odd_rows(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_clashing_columns_are_ignored(spark):
    rows = [(i, f"t{i % 3}", i, "x", 0, True) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_no int, digest string, n int, kept boolean")
    out = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in exact.deduplicate(df).collect()), key=str)
    assert out == brute([r[:2] for r in rows])
