import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from hazardgrid.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = abs(c) // 20 * 20 * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes[p[:d]].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[:len(p)] == p]
        ends = ",".join(str(c) for c in sorted(members) if len(paths[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids[p]), sum(not kids[q] for q in below),
                    sum((len(nodes[q]) - 1) * len(q[-1][1].split()) for q in below if q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, schema=SCHEMA):
    return sorted((tuple(r[c] for c in COLUMNS) for r in prefixes.conversation_trie(spark.createDataFrame(rows, schema)).collect()), key=str)


def conversations(seed=1, convs=120, longest=7):
    rng = random.Random(seed)
    starts = [[("user", f"q {i}"), ("bot", "a b c")] for i in range(3)]
    rows = []
    for c in rng.sample(range(-30, 400), convs):
        turns = rng.choice(starts)[:rng.randrange(3)] + [(rng.choice(["user", "bot", None]), rng.choice(["x", "y z", "", None, f"only {c}"])) for _ in range(rng.randrange(1, longest))]
        rows += [(c, t if rng.random() < 0.95 else None, *turn) for t, turn in enumerate(turns)]
    rng.shuffle(rows)
    seen, unique = set(), []
    for r in rows:                        # turns without a number must be unique here: brute force orders ties by text
        if r[:2] not in seen:
            seen.add(r[:2])
            unique.append(r)
    return unique


@pytest.mark.parametrize("turns, columns, piece", [(10**6, 16, 2048), (25, 2, 3), (4, 1, 1)])
def test_matches_brute_force_for_any_cut(spark, monkeypatch, turns, columns, piece):
    monkeypatch.setattr(prefixes, "SHARD_TURNS", turns)
    monkeypatch.setattr(prefixes, "COLUMNS", columns)
    monkeypatch.setattr(prefixes, "PIECE", piece)
    rows = conversations()
    assert found(spark, rows) == brute(rows)


def test_one_conversation_held_by_a_third(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "SHARD_TURNS", 30)
    rows = [r for r in conversations(3, 60) if (r[0] or 0) < 1000]
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(40) for t in range(4)]
    assert found(spark, rows) == brute(rows)


def test_turn_by_turn_and_long(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "SHARD_TURNS", 40)
    rows = [(c, t, "u", f"w{t}" if t < 35 else f"w{t} {c}") for c in (1, 2, 20, 21, 45) for t in range(40)] + [(60, 0, "u", "long " * 100_000)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, 0, "u", "a")], [(5, 0, None, None)], [(5, 0, "u", "a"), (5, 0, "u", "a"), (5, None, "u", "b")], [(7, 0, "u", "a"), (8, 0, "ua", ""), (9, 0, "", "ua")]])
def test_odd_rows(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_clashing_columns_are_ignored(spark):
    rows = conversations(5, 30)
    assert found(spark, [(*r, "x", 1, [2]) for r in rows], SCHEMA + ", block string, words int, own array<int>") == brute(rows)
