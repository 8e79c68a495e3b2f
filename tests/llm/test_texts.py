"""Operators that judge each text alone, against brute force and the sentencepiece library."""

import hashlib
import re
import weakref

import public_tokenizers
import pyarrow.parquet as pq
import pytest

from hazardgrid.llm import personal, pieces, queries, repetition, simhash, toxicity

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "a", "\n\n", "a" * 3000, "x " * 3000, "é​ " * 50, "▁▁ a▁b", "  two  spaces ", "tab\tnew\nline\r\x0b\x0c\x1c\x85", "１２３ \U0001f600 \x00",
       "1" * 500, "+1 " * 200, "a@b.c@d.e..f", "@@x@y.z", "a@b", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.4", "+1 (555) 123-4567, 4111 1111 1111 1111"]


def docs():
    t = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return [(r["doc_id"], r["text"]) for r in t] + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (1, "again"), (1, "again")]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(k, t, 1, "x") for k, t in docs()], "doc_id long, text string, id int, spans string")


def key(r):
    return str(r)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_repetition_against_brute_force(table):
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in repetition.repetition(table).collect()), key=key)
    want = []
    for k, t in docs():
        t = t or ""
        w = WORD.findall(t)
        lines, dup = [], 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in lines
                lines.append(line)
        wins = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        count = {}
        for x in wins:
            count[x] = count.get(x, 0) + 1
        cov = {i + j for i, x in enumerate(wins) if count[x] > 1 for j in range(5)}
        want.append((k, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cov)))
    assert got == sorted(want, key=key)


def test_repetition_verdict(spark):
    varied = " ".join(f"w{i}" for i in range(60))
    same = " ".join(["buy this thing right now today"] * 10)
    lines = "\n".join(["one single line of it"] * 5 + [f"other{i} words here too now" for i in range(5)])
    df = spark.createDataFrame([(1, varied), (2, same), (3, lines), (4, None)], "doc_id long, text string")
    assert {r.doc_id: r.repetitive for r in repetition.repetition(df).collect()} == {1: False, 2: True, 3: True, 4: False}


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base(t):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, t):
            d = re.sub(r"\D", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_plain_identifiers_match_the_patterns(table):
    got = sorted(((r.doc_id, ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans if not s.disguised)) for r in personal.personal_data(table).collect()), key=key)
    assert got == sorted([(k, base(t or "")) for k, t in docs()], key=key)


@pytest.mark.parametrize("text, kind, piece", [
    ("write jane.doe [at] mail [dot] example [dot] com now", "email", "jane.doe [at] mail [dot] example [dot] com"),
    ("write jane at example dot com now", "email", "jane at example dot com"),
    ("x jane(at)example.com y", "email", "jane(at)example.com"),
    ("mail jаne@exаmple.com ok", "email", "jаne@exаmple.com"),
    ("host 10[.]0[.]0[.]7 up", "ip", "10[.]0[.]0[.]7"),
    ("host １０.0.0.7 up", "ip", "１０.0.0.7"),
    ("call plus one five five five one two three four five six seven thanks", "phone", "plus one five five five one two three four five six seven"),
    ("card 4111​1111​1111​1111 .", "card", "4111​1111​1111​1111"),
])
def test_disguises_map_back_to_the_source(text, kind, piece):
    found = [s for s in personal.listed(text) if s["kind"] == kind]
    assert [text[s["start"]:s["end"]] for s in found] == [piece] and piece not in personal.masked(text)


@pytest.mark.parametrize("text, piece, base", [
    ("mail jаne@example.com ok", "jаne@example.com", "ne@example.com"),
    ("mail a.b@mail.example [dot] com ok", "a.b@mail.example [dot] com", "a.b@mail.example"),
])
def test_a_disguised_address_around_a_plain_one(text, piece, base):
    found = [(text[s["start"]:s["end"]], s["disguised"]) for s in personal.listed(text)]
    assert found == [(piece, True), (base, False)] or found == [(base, False), (piece, True)]
    assert personal.masked(text) == text.replace(piece, "[EMAIL]")


@pytest.mark.parametrize("piece", ["jane at example dot pl", "jane at mail dot example dot se", "jane at example dot museum", "jane at example [dot] internal"])
def test_any_top_level(piece):
    assert personal.masked(f"write {piece}, please") == "write [EMAIL], please"


@pytest.mark.parametrize("text", ["look at that dot over there", "he sat at home. Then one two went", "un deux", "", "a at b", "version 1.2.3 at 10.5"])
def test_ordinary_text_is_left_alone(text):
    assert personal.listed(text) == [] and personal.masked(text) == text


def test_encoding_and_decoding_equal_the_library(table, spark):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted(((r.doc_id, r.ids, r.decoded) for r in pieces.encode_decode(table, MODEL).collect()), key=key)
    want = []
    for k, t in docs():
        ids = lib.encode(t or "", add_eos=True)
        want.append((k, ids, lib.decode(ids)))
    assert got == sorted(want, key=key)
    p = pieces.Pieces(MODEL)
    assert all(p.decode(p.encode(t or "")) == lib.decode(lib.encode(t or "")) for _, t in docs())


def test_a_difference_from_the_library_stops_the_batch():
    p = pieces.Pieces(MODEL)
    p.known["▁the"] = ((1,), b" the")
    with pytest.raises(ValueError):
        p.check(["the"])


def test_short_and_long_agendas_agree():
    p = pieces.Pieces(MODEL)
    units = {u for _, t in docs() for u in p.split(t or "")} | {"▁" * n + c * n for n in range(1, 40) for c in ("a", "é", "the", "1")}
    assert all(p.merge_short(u) == p.merge_long(u) for u in units)


def test_units_of_the_generation_before_are_not_merged_again(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    p = pieces.Pieces(MODEL)
    text = "one two three four five"
    first = p.encode(text)
    p.check([])
    assert p.encode(text) == first and not p.fresh and len(p.known) == 5


def test_contract_queries(spark):
    rows = queries.op6_sentencepiece(spark, SF).collect()
    assert len(rows) == 200 and {len(r.ids_sha256) for r in rows} == {64}
    rows = queries.op5_personal_data(spark, SF).collect()
    assert all(r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest() for r in rows if not r.n_disguised)
    rows = queries.op10_repetition(spark, SF).collect()
    assert any(r.kept for r in rows) and not any(r.kept and r.base_failed for r in rows)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repetition.repetition(df).count() == personal.personal_data(df).count() == pieces.encode_decode(df, MODEL).count() == personal.mask(df).count() == 0


def test_a_worker_drops_what_it_kept_for_another_operator(spark, monkeypatch):
    """Remembered units stay over the tasks of one operator, not beside those of the next."""
    few = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    runs = []
    monkeypatch.setattr(type(few), "mapInArrow", lambda self, run, schema: runs.append(run) or self)
    pieces.encode_decode(few, MODEL)
    simhash.fingerprints(few)
    toxicity.vectors(few, [], spark.sparkContext.broadcast({}))
    encode, *others = runs
    for other in [*others, toxicity._example_counts]:
        list(encode(iter([])))
        first = weakref.ref(pieces.load(MODEL))
        list(encode(iter([])))
        assert first() is not None and pieces.load(MODEL) is first()
        list(other(iter([])))
        assert first() is None
