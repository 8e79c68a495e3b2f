import csv
import io
import zipfile

import pytest
from conftest import rows
from pyspark.sql import functions as F

from hazardgrid import fixed_values as V
from hazardgrid.functions import numbers as N
from hazardgrid.functions import text as T
from hazardgrid.operators import locating as K
from hazardgrid.operators import upserts as U
from hazardgrid.operators import validation as C
from hazardgrid.sources import archives as A

BASE = {
    "id": "Z-7/31", "county_name": "Mercer", "municipality_name": "WEST WINDSOR TWP", "crash_date": "11/02/2022",
    "crash_time": "2359", "total_killed": "2", "total_injured": "0", "pedestrians_killed": "1", "pedestrians_injured": "0",
    "severity": "I", "crash_location": "RIVER LANE", "sri_std_rte_identifier": "R-44", "milepost": "3.5",
    "latitude": "40.25", "longitude": "74.5", "light_condition": "DARK",
}


def raw(**changes):
    return [{**BASE, **changes}.get(c, "") for c in V.ARCHIVE_COLUMNS]


def frame(spark, *records):
    return spark.createDataFrame([tuple(r) for r in records], ", ".join(f"`{c}` string" for c in V.ARCHIVE_COLUMNS))


def test_valid_row_is_prepared(spark):
    good, bad = C.prepare_crash(frame(spark, raw()), "Mercer", 2022)
    r = good.first()
    assert bad.count() == 0
    assert (r["external_id"], r["municipality_name"], str(r["crash_date"]), r["severity"]) == (
        "NJDOT:2022:MERCER:Z-7/31", "WEST WINDSOR TOWNSHIP", "2022-11-02", "injury_unknown")
    assert r["ped_involved"] is True and r["bike_involved"] is None and r["milepost"] == 3.5 and r["sri"] == "R-44"
    assert (r["reported"]["lon"], r["reported"]["lat"], r["reported"]["issue"]) == (-74.5, 40.25, None)


@pytest.mark.parametrize("changes, reason", [
    ({"county_name": "Nowhere"}, "unknown county: Nowhere"), ({"county_name": "Essex"}, "county"), ({"id": " "}, "source_id"),
    ({"crash_date": "2022-11-02"}, "date"), ({"crash_date": "02/30/2022"}, "date"), ({"crash_date": "11/02/2021"}, "year"),
    ({"severity": "X"}, "severity"), ({"municipality_name": " . "}, "municipality_name"), ({"total_killed": "-1"}, "total_killed"),
    ({"total_injured": "1.5"}, "total_injured"), ({"pedestrians_killed": "x"}, "pedestrians_killed"),
    ({"pedestrians_injured": "1 2"}, "pedestrians_injured"), ({"severity": "X", "id": ""}, "source_id"),
])
def test_first_failed_check_is_the_reason(spark, changes, reason):
    good, bad = C.prepare_crash(frame(spark, raw(**changes)), "MERCER", 2022)
    assert good.count() == 0 and bad.first()["reason"] == reason


def test_blank_counts_are_unknown_not_zero(spark):
    blank = dict.fromkeys(V.CASUALTY_COLUMNS, "")
    r = C.prepare_crash(frame(spark, raw(**blank)), "Mercer", 2022)[0].first()
    assert [r[c] for c in V.CASUALTY_COLUMNS] == [None] * 4 and r["ped_involved"] is False


def test_points_and_names(spark):
    df = spark.createDataFrame([("", "", 1), ("40", "", 2), ("x", "74", 3), ("nan", "74", 4), ("45", "74", 5), ("40.5", "74.5", 6), ("40.5", "-74.5", 7), ("1e1", "7_4", 8)], "lat string, lon string, i int")
    out = dict(rows(df.select("i", N.reported_point(F.col("lat"), F.col("lon"))["issue"].alias("p"))))
    assert out == {1: "reported_missing", 2: "reported_incomplete", 3: "reported_non_numeric", 4: "reported_out_of_bounds",
                   5: "reported_out_of_bounds", 6: None, 7: None, 8: "reported_out_of_bounds"}
    names = spark.createDataFrame([(n,) for n in ("cape  may", "CapeMay", "Hudson.", "Bergen County", None)], "n string")
    assert rows(names.select(T.normalize_county(F.col("n")))) == [(None,), (None,), ("Cape May",), ("Cape May",), ("Hudson",)]
    m = spark.createDataFrame([(n,) for n in ("Princeton Boro", "Twp Hill", "ORANGE CITY", "passaic twp.", "Newark City", "St. Boro-Town")], "n string")
    assert [r[0] for r in m.select(T.normalize_municipality(F.col("n"))).collect()] == [
        "PRINCETON BOROUGH", "TWP HILL", "CITY OF ORANGE TOWNSHIP", "LONG HILL TOWNSHIP", "NEWARK CITY", "ST BORO TOWN"]


def test_long_ids_are_hashed(spark):
    import hashlib
    raw_id = "NJDOT:2022:CAPE_MAY:" + "9" * 40
    got = spark.range(1).select(T.build_external_id(F.lit("Cape May"), F.lit(2022), F.lit(" " + "9" * 40 + " "))).first()[0]
    assert got == "NJDOT:2022:CAPE_MAY:" + hashlib.sha256(raw_id.encode()).hexdigest()[:20]


def test_municipality_match(spark):
    crashes = spark.createDataFrame([(1, "Mercer", "A TOWNSHIP"), (2, "Mercer", "B"), (3, "Essex", "A TOWNSHIP"), (4, "Mercer", "C")], "line long, county string, municipality_name string")
    munis = spark.createDataFrame([(10, "A Twp", "mercer"), (11, "b", "MERCER"), (12, "B.", "Mercer")], "muni_id int, name string, county string")
    good, bad = C.match_municipality(crashes, munis)
    assert rows(good, "line", "muni_id") == [(1, 10)]
    assert rows(bad, "line", "reason") == [(2, "municipality_ambiguous"), (3, "municipality_unmatched"), (4, "municipality_unmatched")]


def repaired(spark, *files):
    """Lines of mended and rejected records of files of rows; records by their id and last two columns."""
    rows_ = [(f"f{k}", i, cells) for k, file in enumerate(files) for i, cells in enumerate(file, 1)]
    good, bad = A.repair_split_records(spark.createDataFrame(rows_, "archive string, line long, cells array<string>"))
    assert all(len(r["cells"]) == 50 for r in good.collect())
    return (sorted((r["archive"], r["line"], r["cells"][0], *r["cells"][48:]) for r in good.collect()), rows(bad, "archive", "line"))


@pytest.mark.parametrize("block", [50_000, 2])
def test_split_records_are_repaired(spark, monkeypatch, block):
    monkeypatch.setattr(A, "_BLOCK", block)
    whole, short = raw(id="w"), raw(id="s", other_property_damage=" gate")[:49]
    cases = [
        ([short, [], ["of "], [" iron", " 12"], whole], [(1, "s", "gate of iron", " 12"), (5, "w", "", "")], []),
        ([short, whole], [(2, "w", "", "")], [1]),                                    # no end: the head goes, the record stays
        ([short, ["a", "b"], whole], [(3, "w", "", "")], [1]),                        # a misfit goes with the head that it stops
        ([short, ["a", "b"], ["a", "b"], ["x"]], [], [1, 3, 4]),
        ([short], [], [1]), ([["1", "2"], [], ["x"]], [], [1, 2, 3]),
        ([short, short, ["", "8"]], [(2, "s", "gate", "8")], [1]),
        ([short, *[["x"]] * 16, ["", "1"]], [(1, "s", "gate" + " x" * 16, "1")], []),
        ([short, *[["x"]] * 17, ["e", "1"]], [], [1, 19]),                            # the piece too many goes with its head
        ([short, ["y" * 4097], ["z"], ["e", "1"]], [], [1, 3, 4]),
        ([short, ["e", "1"], ["again", "1"], ["x"], whole, ["x"]], [(1, "s", "gate e", "1"), (5, "w", "", "")], [3, 4, 6]),
    ]
    good, bad = repaired(spark, *[c[0] for c in cases])
    assert good == sorted((f"f{k}", *r) for k, c in enumerate(cases) for r in c[1])
    assert bad == sorted(((f"f{k}", line) for k, c in enumerate(cases) for line in c[2]), key=lambda r: tuple((v is not None, str(v)) for v in r))


def _text(*records):
    out = io.StringIO()
    csv.writer(out).writerows(records)
    return out.getvalue().encode("latin-1")


def test_archive_scan_reads_zips_and_rejects_broken_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "Mercer2022Accidents.zip", "w") as z:
        z.writestr("Mercer2022Accidents.txt", _text(raw(id=" 1 "), raw(id="2", municipality_name="Ré"), ["short"]))
    (tmp_path / "CapeMay2021Accidents.txt").write_bytes(_text(raw(id="3")))
    (tmp_path / "Essex2022Accidents.zip").write_bytes(b"no zip")
    good, bad = A.scan_crash_archive(spark, str(tmp_path))
    assert rows(good, "source_county", "source_year", "line", "id", "municipality_name") == [
        ("Cape May", 2021, 1, "3", "WEST WINDSOR TWP"), ("Mercer", 2022, 1, "1", "WEST WINDSOR TWP"), ("Mercer", 2022, 2, "2", "Ré")]
    assert rows(bad, "source_county", "reason") == [("Essex", "archive_invalid"), ("Mercer", "schema_columns")]


def person(source_id, flag):
    row = [""] * V.PERSON_COLUMNS
    row[0], row[1], row[33] = source_id, "31", flag
    return row


def test_person_archive(spark, tmp_path):
    (tmp_path / "ok").mkdir(), (tmp_path / "bad").mkdir()
    (tmp_path / "ok" / "Mercer2022Pedestrians.txt").write_bytes(_text(person("202211010001", "Y"), person("202211010001", "y"), person("202211010002", "N")))
    out, refused = A.scan_person_archive(spark, str(tmp_path / "ok"))
    assert refused.isEmpty() and rows(out, "external_id", "bicycle") == [
        ("NJDOT:2022:MERCER:202211010001", True), ("NJDOT:2022:MERCER:202211010001", True), ("NJDOT:2022:MERCER:202211010002", False)]
    # A bad archive is refused with its first bad row; a sound one beside it loads.
    for i, bad in enumerate(("202111010001", "202210010001", "20221101", "2022110x0001")):
        folder = tmp_path / "bad" / str(i)
        folder.mkdir()
        (folder / "Mercer2022Pedestrians.txt").write_bytes(_text(person("202211010001", "Y"), person(bad, "Y"), person(bad, "?")))
    (tmp_path / "bad" / "4").mkdir(), (tmp_path / "bad" / "5").mkdir()
    (tmp_path / "bad" / "4" / "Mercer2023Pedestrians.txt").write_bytes(_text(person("202311010001", "Y")))
    (tmp_path / "bad" / "5" / "Mercer2022Pedestrians.txt").write_bytes(_text(person("202211010001", "Y")))
    out, refused = A.scan_person_archive(spark, str(tmp_path / "bad" / "*"))
    assert [r["reason"] for r in sorted(refused.collect(), key=lambda r: r["archive"])] == ["year", "county", "case_number", "municipality_code", "archive_name"]
    assert {r["line"] for r in refused.collect()} == {1, 2} and out.count() == 1
    assert A.requested_counties(["mercer", "Cape May", "MERCER"]) == ["Mercer", "Cape May"]


def test_route_location(spark):
    sq = [[{"x": -75.0, "y": 40.0}, {"x": -74.0, "y": 40.0}, {"x": -74.0, "y": 41.0}, {"x": -75.0, "y": 41.0}, {"x": -75.0, "y": 40.0}]]
    munis = spark.createDataFrame([(1, sq)], "muni_id int, rings array<array<struct<x:double,y:double>>>")

    def route(sid, sri, *pts):
        return (sid, sri, min(p[2] for p in pts), max(p[2] for p in pts), [{"x": x, "y": y, "m": m} for x, y, m in pts])
    routes = spark.createDataFrame([
        route("NJDOT:1:0", "A", (-74.9, 40.1, 0.0), (-74.8, 40.1, 1.0), (-74.8, 40.2, 1.5)),
        route("NJDOT:2:0", "B", (-74.5, 40.1, 0.0), (-74.4, 40.1, 1.0)), route("NJDOT:3:0", "B", (-74.5, 40.3, 1.0), (-74.4, 40.3, 0.0)),
        route("NJDOT:4:0", "C", (-76.0, 40.1, 0.0), (-75.9, 40.1, 1.0))],
        "source_id string, sri string, mp_start double, mp_end double, pts array<struct<x:double,y:double,m:double>>")
    good = {"lon": -74.5, "lat": 40.5, "issue": None}
    none = {"lon": None, "lat": None, "issue": "reported_missing"}
    out = {"lon": -75.5, "lat": 40.5, "issue": None}
    df = spark.createDataFrame([
        (1, 1, good, None, None), (2, 1, none, "A", 0.5), (3, 1, out, "A", 1.0), (4, 1, none, "B", 0.5), (5, 1, none, "C", 0.5),
        (6, 1, none, "A", 9.0), (7, 1, none, None, 1.0), (8, 1, none, "A", 1.25)],
        "line long, muni_id int, reported struct<lon:double,lat:double,issue:string>, sri string, milepost double")
    got = {r["line"]: r for r in K.resolve_location(df, routes, munis, ["line"]).collect()}
    assert [got[i]["geocode_quality"] for i in range(1, 9)] == ["reported", "route_milepost", "route_milepost", None, None, None, None, "route_milepost"]
    assert [got[i]["location_reason"] for i in (4, 5, 6, 7)] == ["route_ambiguous", "route_measure_unresolved", "route_measure_unresolved", "route_reference_missing"]
    assert got[2]["lon"] == pytest.approx(-74.85) and got[3]["lon"] == pytest.approx(-74.8) and got[8]["lat"] == pytest.approx(40.15)
    assert got[3]["coordinate_issue"] == "reported_outside_municipality" and got[1]["coordinate_issue"] is None


def test_upsert_keeps_dashboard_rows_and_location(spark):
    cols = "external_id string, dashboard_id string, severity string, ped_involved boolean, bike_involved boolean, total_killed int, total_injured int, pedestrians_killed int, pedestrians_injured int, lon double"
    old = spark.createDataFrame([("a", None, "fatal", False, True, 1, 1, 1, 1, -74.0), ("b", "D1", "fatal", False, None, 1, 1, 1, 1, -74.0)], cols)
    new = spark.createDataFrame([(k, None, "injury_unknown", True, None, None, 2, 0, 0, -70.0) for k in "abc"], cols)
    out = {r["external_id"]: r for r in U.upsert_crashes(old, new).collect()}
    assert (out["a"]["severity"], out["a"]["bike_involved"], out["a"]["total_killed"], out["a"]["lon"], out["a"]["action"]) == ("injury_unknown", True, None, -74.0, "updated")
    assert (out["b"]["severity"], out["b"]["action"]) == ("fatal", "skipped") and out["c"]["action"] == "inserted"
    with pytest.raises(RuntimeError):
        U.check_affected(U.upsert_crashes(old, new), 3)
    last = C.dedupe_last_wins(spark.createDataFrame([("k", "f", 1, "x"), ("k", "f", 2, "y"), ("k", "e", 9, "z")], "id string, archive string, line long, v string"), "id", ["archive", "line"])
    assert last.first()["v"] == "y"


def test_refresh_guards(spark):
    line = "array<struct<x:double,y:double>>"
    p = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 1.0}]
    old = spark.createDataFrame([("NJDOT:1:0:M1:P0:S0", "A", .1, p), ("NJDOT:2:0:M1:P0:S0", "A", .1, p), ("osm:9", "A", .1, p)], f"source_id string, sri string, length_miles double, pts {line}")
    routes = old.limit(0)
    seen = spark.createDataFrame([("NJDOT:1:0",)], "source_id string")
    assert rows(U.snapshot_omissions(routes, old, seen)) == [("segment", "NJDOT:2:0:M1:P0:S0")]
    assert U.incompatible_changes(old, old.withColumn("length_miles", F.col("length_miles") + 1e-12), ["sri"]).isEmpty()
    moved = U.incompatible_changes(old, old.withColumn("length_miles", F.col("length_miles") + 1e-9), ["sri"])
    assert {r["problem"] for r in moved.collect()} == {"length"}
    with pytest.raises(RuntimeError):
        U.require_compatible(moved)


def test_long_edges_cost_two_buckets(spark):
    route = spark.createDataFrame([("r", "A", 0.0, 1e9, [{"x": -75.0, "y": 40.0, "m": 0.0}, {"x": -74.0, "y": 40.0, "m": 1e9}, {"x": -74.0, "y": 40.5, "m": 1e9 + .05}])],
                                  "source_id string, sri string, mp_start double, mp_end double, pts array<struct<x:double,y:double,m:double>>")
    assert K.measure_edges(route).count() <= 4
    munis = spark.createDataFrame([(1, [[{"x": -76.0, "y": 39.0}, {"x": -73.0, "y": 39.0}, {"x": -73.0, "y": 41.0}, {"x": -76.0, "y": 41.0}, {"x": -76.0, "y": 39.0}]])],
                                  "muni_id int, rings array<array<struct<x:double,y:double>>>")
    asked = spark.createDataFrame([(1, 1, "A", 5e8), (2, 1, "A", -1.0), (3, 1, "B", 1.0), (4, 1, "A", 0.0)], "line long, muni_id int, sri string, milepost double")
    assert rows(K.locate_route_milepost(asked, route, munis, ["line"]), "line", "lon") == [(1, -74.5), (4, -75.0)]


def test_legacy_dates_are_whole(spark):
    texts = ["2022-01-05 junk", "01/05/2022 08:15", "2022-01-05", "20220105", "2022-01-05T10:00:00Z", "1/5/2022 8:15 PM", "2022-02-30", "05.01.2022", None]
    df = spark.createDataFrame([(i, t, "fatal", 40.0, -74.5) for i, t in enumerate(texts)], "i int, crash_date string, severity string, latitude double, longitude double")
    assert [r[0] for r in rows(C.standardize_legacy_crashes(df), "i")] == [1, 2, 3, 4, 5]
    assert rows(C.legacy_drops(df)) == [("date", 4)]
