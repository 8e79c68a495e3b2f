"""WARC round trips and temporal URL lists."""

import base64
import datetime as dt
import gzip
import hashlib

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import compare
from hazardgrid.llm import queries, urllists, warc

SF = "/root/testdata/sf0.001"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, sha1 string")


ROWS = [(1, "http://a/1", "same"), (5, "http://a/5", "same"), (3, None, "same"), (4, "http://b", ""), (9, "http://c", None), (7, "u\r\nx", "é" * 70000),
        (8, "http://d", "only"), (8, "http://d", "only"), (None, "http://n", "same")]


def test_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(warc.plan_records(pages(spark, ROWS), "page_id", "url", "html"), path)
    got = sorted(((r.record_id, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes, bytes(r.payload) if r.payload is not None else None, r.digest_ok)
                  for r in warc.read_archives(spark, path).collect()), key=str)
    want = []
    for k, _, html in ROWS:
        data = (html or "").encode()
        first = {"same": 5, "": 9, None: 9}.get(html, k)
        again = k is not None and k < first
        want.append((f"<urn:record:{'none' if k is None else k}>", "revisit" if again else "response", f"<urn:record:{first}>" if again else None,
                     base64.b32encode(hashlib.sha1(data).digest()).decode(), len(data), None if again else data, None if again else True))
    assert got == sorted(want, key=str)


def test_files_are_gzip_and_uncommitted_files_are_ignored(spark, tmp_path):
    path = f"{tmp_path}/w"
    warc.write_archives(warc.plan_records(pages(spark, ROWS), "page_id", "url", "html").coalesce(1), path)
    file = next((tmp_path / "w").glob("*.warc.gz"))
    assert gzip.decompress(file.read_bytes()).count(b"WARC/1.1\r\n") == len(ROWS)
    (tmp_path / "w" / "part-lost.warc.gz").write_bytes(file.read_bytes())
    assert warc.read_archives(spark, path).count() == len(ROWS)


def test_pushdown_and_unread_payloads(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/w"
    warc.write_archives(warc.plan_records(pages(spark, ROWS), "page_id", "url", "html"), path)
    df = warc.read_archives(spark, path, "record_type string, record_id string, payload_bytes bigint").filter("record_type = 'revisit'")
    assert sorted(r.record_id for r in df.collect()) == ["<urn:record:1>", "<urn:record:3>", "<urn:record:4>"]
    assert warc.read_archives(spark, path).filter("record_id IN ('<urn:record:7>', 'x')").count() == 1
    assert warc.read_archives(spark, path).filter("refers_to IS NULL").count() == 6
    read = []
    monkeypatch.setattr(warc.Member, "more", lambda self, f=warc.Member.more: read.append(1) or f(self))
    fs, root = warc.filesystem(path)
    reader = warc.WarcReader(path, spark.createDataFrame([], "record_id string").schema)
    rows = [r for name in (tmp_path / "w").glob("*.gz") for r in reader.records(fs.open_input_file(str(name)), False)]
    assert len(rows) == len(ROWS) == len(read)         # the long payload is never unpacked further than its headers


def test_foreign_archives(spark, tmp_path):
    rows = warc.plan_records(pages(spark, ROWS), "page_id", "url", "html").collect()
    records = [warc.record(r.asDict()) for r in rows]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    assert warc.read_archives(spark, str(tmp_path)).filter("digest_ok").count() == 12
    assert warc.read_archives(spark, str(tmp_path), "record_id string").count() == 2 * len(ROWS)


def test_empty_pages(spark, tmp_path):
    warc.write_archives(warc.plan_records(pages(spark, []), "page_id", "url", "html"), f"{tmp_path}/w")
    assert warc.read_archives(spark, f"{tmp_path}/w").count() == 0


def test_warc_query(spark):
    want = [(r.page_id, len(r.html.encode()), base64.b32encode(hashlib.sha1(r.html.encode()).digest()).decode()) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = queries.op4_warc(spark, SF).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == sorted(want) and all(r.digest_ok for r in got if r.record_type == "response")


def test_lists_agree_with_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert compare(spark, con, "op7_url_lists", SF, entry.queries(), entry.oracle_sql()).startswith("ok")


DAY = dt.date(2024, 1, 10)
EVENTS = [("domain", "bad.org", "block", DAY), ("domain", "bad.org", "remove", dt.date(2024, 3, 5)), ("host", "ok.bad.org", "allow", DAY), ("host", "ok.bad.org", "allow", DAY),
          ("url", "http://ok.bad.org/x", "block", dt.date(2024, 2, 1)), ("host", "tie.com", "remove", DAY), ("host", "tie.com", "block", DAY), (None, "q", "block", DAY), ("host", None, "block", DAY),
          ("host", "q", "block", None), ("host", "q", "other", DAY)]


@pytest.mark.parametrize("url, day, verdict", [
    ("http://www.bad.org/", dt.date(2024, 1, 9), "none"), ("http://www.bad.org/", DAY, "block"), ("http://u:p@WWW.Bad.org:80?x", dt.date(2024, 3, 4), "block"),
    ("http://www.bad.org/", dt.date(2024, 3, 5), "none"), ("http://ok.bad.org/y", dt.date(2024, 2, 1), "allow"), ("http://ok.bad.org/x#f", dt.date(2024, 2, 1), "block"),
    ("http://ok.bad.org/x", dt.date(2024, 1, 31), "allow"), ("https://tie.com", dt.date(2031, 1, 1), "block"), ("http://q/", DAY, "none"), (None, DAY, "none"),
    ("nonsense", DAY, "none"), ("http://www.bad.org/", None, "none"), ("http://notbad.org/", DAY, "none")])
def test_verdicts(spark, url, day, verdict):
    caps = spark.createDataFrame([(1, url, day, "old"), (1, url, day, "old")], "id int, url string, fetched_on date, verdict string")
    events = spark.createDataFrame(EVENTS, "kind string, entry string, action string, day date")
    assert [r.verdict for r in urllists.judge(caps, events).collect()] == [verdict] * 2


def test_lists_on_empty_tables_and_without_python(spark):
    caps = spark.createDataFrame([], "url string, fetched_on date")
    events = spark.createDataFrame(EVENTS, "kind string, entry string, action string, day date")
    assert urllists.judge(caps, events).count() == 0
    assert urllists.judge(spark.createDataFrame([("http://a", DAY)], caps.schema), events.limit(0)).collect()[0].verdict == "none"
    plan = queries.op7_url_lists(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "NestedLoop", "Cartesian"))
