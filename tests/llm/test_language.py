import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from hazardgrid.llm import language
from hazardgrid.llm.common import crc_mod5
from hazardgrid.llm.eliasfano import Level, Levels, Sequence, load, save
from hazardgrid.session import work_folder

RNG = random.Random(5)


@pytest.mark.parametrize("n, top", [(0, 1), (1, 0), (50, 10), (1000, 10**9), (5000, 7000)])
def test_sequences(n, top):
    v = np.sort(np.random.default_rng(n).integers(0, top + 1, n))
    s = Sequence.of(v)
    assert (s[np.arange(n)] == v).all()
    if n:
        x = np.concatenate([v, v + 1, [0, top + 5]])
        assert (s.successor(x) == np.searchsorted(v, x)).all()


def test_sequence_with_many_equal_values():
    v = np.sort(np.concatenate([np.zeros(300, int), np.full(200, 7), np.arange(5000, 5100)]))
    s = Sequence.of(v)
    x = np.arange(6000)
    assert (s[np.arange(len(v))] == v).all() and (s.successor(x) == np.searchsorted(v, x)).all()


def test_levels_in_files(tmp_path):
    rng = np.random.default_rng(3)
    pairs = np.unique(rng.integers(0, [300, 50], (2000, 2)), axis=0)
    cut = int((pairs[:, 0] < 140).sum())
    paths = []
    for first, end, offset, rows in ((0, 140, 0, pairs[:cut]), (140, 300, cut, pairs[cut:])):
        a = Level.arrays(first, offset, rows[:, 0], rows[:, 1], -rows[:, 1] / 7.0, -np.arange(first, end) / 99.0, rows[:, 0] + 1)
        paths.append(f"file://{tmp_path}/{first}.level")
        save(paths[-1], a)
    assert isinstance(load(paths[0])["prob"].base, np.memmap)
    t = Levels(paths)
    place = t.find(pairs[:, 0], pairs[:, 1])
    assert (place == np.arange(len(pairs))).all() and (t.word(place) == pairs[:, 1]).all() and (t.count(place) == pairs[:, 0] + 1).all()
    assert np.allclose(t.prob(place), -pairs[:, 1] / 7.0, atol=1e-3) and np.allclose(t.backoff(np.arange(300)), -np.arange(300) / 99.0, atol=1e-3)
    have = {tuple(p) for p in pairs.tolist()}
    ask = rng.integers(-1, [310, 60], (3000, 2))
    assert ((t.find(ask[:, 0], ask[:, 1]) >= 0) == [tuple(a) in have for a in ask.tolist()]).all()


def corpus():
    rows = []
    for k in range(300):
        ws = []
        while len(ws) < RNG.randrange(3, 80):
            w = RNG.choice(["Red", "green", "blue", f"Rare{RNG.randrange(500)}"])
            ws += [w, "sky", "above"] if w == "blue" else [w]
        rows.append((k, " ".join(ws)))
    return rows + [(300, None), (301, ""), (None, "red green"), (302, "red sky\x1cx Étoile étoile"), (302, "red sky\x1cx Étoile étoile")]


def brute(rows, remainder=1):
    toks = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter(w for k, t in rows if crc_mod5(k) != remainder for w in toks(t))
    n, v = sum(c.values()), len(c)
    return sorted(((k, len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, sum(math.log10((c[w] + .5) / (n + .5 * (v + 1))) for w in toks(t))) for k, t in rows), key=str)


def test_counts_base_and_gain(spark):
    rows = corpus()
    got = language.score_documents(spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, uid int, c int")).collect()
    want = brute(rows)
    mine = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
    assert [m[:4] for m in mine] == [w[:4] for w in want] and np.allclose([m[4] for m in mine], [w[4] for w in want])
    held = [r for r in got if crc_mod5(r.doc_id) == 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_rare_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(language, "DICTIONARY_SHARE", 0.05)
    monkeypatch.setattr(language, "SEGMENT", 3)
    rows = corpus()
    got = language.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    mine = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
    want = brute(rows)
    assert [m[:4] for m in mine] == [w[:4] for w in want] and np.allclose([m[4] for m in mine], [w[4] for w in want])


def test_probabilities_sum_to_one(spark, monkeypatch):
    """The probabilities of all known words and one unseen word after each context."""
    kept = {}
    plain = language._scores
    monkeypatch.setattr(language, "_scores", lambda docs, d, pairs, triples: kept.update(d=d.value, pairs=pairs, triples=triples) or plain(docs, d, pairs, triples))
    rows = [(k, t) for k, t in corpus() if t and "Rare" not in t] + [(k, "red green blue sky above red red green") for k in range(400, 460)]
    language.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), None).count()
    d, model = kept["d"], language.Model(kept["d"], kept["pairs"], kept["triples"])
    assert kept["pairs"] and kept["triples"]
    unseen = np.log10(0.5 / d.total)
    rest = d.v - len(d.c)                                  # words too rare for the dictionary
    for context in ([b"red"], [b"blue", b"sky"], [b"green", b"blue"], []):
        at = d.numbers(context)
        total = sum(10 ** model.log10([np.append(at, w)])[-1] for w in range(len(d.c)))
        weight = model.log10([np.append(at, -1)])[-1]
        total += 10 ** (weight + unseen) + rest * 10 ** weight * 1.5 / d.total
        assert total == pytest.approx(1, abs=0.01)


@pytest.mark.parametrize("rows", [[], [(6, "all held out")], [(0, None)]])
def test_tiny_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = language.score_documents(df).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got) == [w[:4] for w in brute(rows)]


@pytest.mark.parametrize("share", [2.5e-7, 0.05])
def test_trie_holds_every_repeated_word_and_ngram(spark, monkeypatch, share):
    """Also where the words' numbers are joined and their counts are in several files."""
    kept = {}
    plain = language._scores
    monkeypatch.setattr(language, "_scores", lambda docs, d, pairs, triples: kept.update(d=d.value, pairs=pairs, triples=triples) or plain(docs, d, pairs, triples))
    monkeypatch.setattr(language, "DICTIONARY_SHARE", share)
    monkeypatch.setattr(language, "SEGMENT", 50)
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["red", "green", f"x{rng.randrange(300)}", "u v w"]) for _ in range(2000))) for k in range(200)]
    rows += [(1000, "alpha beta gamma"), (1001, "alpha beta gamma"), (1002, "lonely word")]
    got = {r.doc_id: r for r in language.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), None).collect()}
    toks = [[b"", *t.encode().split(), b""] for _, t in rows]
    one = Counter(w for t in toks for w in t[1:])
    two = Counter(p for t in toks for p in zip(t, t[1:]))
    three = Counter(p for t in toks for p in zip(t, t[1:], t[2:]))
    d, model = kept["d"], language.Model(kept["d"], kept["pairs"], kept["triples"])
    assert d.size == sum(c >= 2 for c in one.values())
    for levels, want in ((model.pairs, two), (model.triples, three)):
        assert sum(p.words.n for p in levels.parts) == sum(c >= 2 for c in want.values())
        assert sorted(np.concatenate([p.count for p in levels.parts]).tolist()) == sorted(c for c in want.values() if c >= 2)
    assert got[1000].score > got[1000].base_score + 1 and got[1000].score == got[1001].score


def test_search_in_long_buckets():
    """A frequent context has many words close together: they share their high bits."""
    rng = np.random.default_rng(8)
    v = np.unique(np.concatenate([rng.integers(0, 10**8, 300), np.arange(5 * 10**7, 5 * 10**7 + 20_000, 3), [10**8]]))
    s = Sequence.of(v)
    x = np.concatenate([v, v + 1, v - 1, rng.integers(0, 10**8 + 9, 5000)])
    x = x[x >= 0]
    want = np.searchsorted(v, x)
    assert (s.successor(x) == want).all()
    assert (s.find(x) == np.where(np.isin(x, v), want, -1)).all()


def test_staged_tables_go_with_their_last_use(spark):
    """What a later step does not read is deleted, so that the disk holds one step's tables, not all."""
    folder = Path(work_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    df = language.score_documents(spark.createDataFrame(corpus(), "doc_id long, text string"))
    left = {p.name.split("-")[0] + "-" + p.name.split("-")[1] for p in set(folder.iterdir()) - before if p.name.startswith(("lm-", "trie-"))}
    assert "lm-numbers" in left and not left & {"lm-words", "lm-rare", "lm-numbered", "lm-coded", "lm-pairs", "lm-triples", "trie-grams", "trie-files"}
    assert df.count() == len(corpus())


def test_counts_do_not_depend_on_blocks(spark, monkeypatch):
    """Few tokens at once give many blocks of a share; a pair's counts are added up over them."""
    monkeypatch.setattr(language, "_TOKENS_AT_ONCE", 50)
    rng = random.Random(4)
    texts = [[rng.randrange(40) for _ in range(rng.randrange(1, 60))] for _ in range(300)]
    coded = spark.createDataFrame([(i % 7 != 0, t) for i, t in enumerate(texts)], "learns boolean, numbers array<int>")

    def pairs_of(every, starts):
        before = np.concatenate(([-1], every[:-1]))
        before[starts] = -1
        return before[before >= 0], every[before >= 0]

    got = {(r.context, r.word): r.c for r in language._counted(coded, pairs_of, 6, 9000).collect()}
    want = Counter(p for i, t in enumerate(texts) if i % 7 for p in zip(t, t[1:]))
    assert got == {p: c for p, c in want.items() if c >= language.MIN_NGRAM}
