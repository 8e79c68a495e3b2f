import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from hazardgrid import fixed_values as V
from hazardgrid.operators import validation as C
from hazardgrid.plans import dashboard as D
from hazardgrid.sources import files as S

BASE = {
    "id_cr": "42", "casenumber": "AB-001", "County": "Mercer", "Municipality": "Princeton, Mercer", "dateofcrash": "2022-04-05",
    "Date & Time of Crash": "2022-04-05T09:15:00.000", "Year": "2022", "Highest Injury Severity Rating": "Suspected Serious Injury (A)",
    "Geopoint": '{"lon":-74.65,"lat":40.35}', "Geopoint (Calculated)": '{"lon":-74.66,"lat":40.36}', "latitude": "", "longitude": "",
    "NJDOT Summary": '["Pedestrian Involved", "Total Crashes"]', "fatalitycount": "0", "crashfatalitycount": "0", "injurycount": "1",
    "pedestrianfatalitycount": "0", "pedestrianinjurycount": "1", "fatalcrashind": "N", "njdot_dln": "D", "streetname": " Main ", "streetsri": "1",
    "Weather Condition": "Rain", "Crash Type": "", "driver": "secret",
}


def frame(spark, *changes):
    names = list(BASE)
    return spark.createDataFrame([(i, *[{**BASE, **c}[n] for n in names]) for i, c in enumerate(changes, 1)],
                                 "line long, " + ", ".join(f"`{n}` string" for n in names))


@pytest.fixture(scope="module")
def munis(spark):
    ring = [[{"x": -75.0, "y": 40.0}, {"x": -74.0, "y": 40.0}, {"x": -74.0, "y": 41.0}, {"x": -75.0, "y": 41.0}, {"x": -75.0, "y": 40.0}]]
    return spark.createDataFrame([(99, "1114", "Princeton", "Mercer", ring), (98, "x", "Ghost", "Mercer", ring)],
                                 "muni_id int, muni_code string, name string, county string, rings array<array<struct<x:double,y:double>>>")


def test_valid_record(spark, munis):
    r = C.prepare_dashboard(frame(spark, {}), munis)[0].first()
    assert (r["external_id"], r["crash_time"], r["severity"], r["muni_id"]) == ("NJDOT:2022:MERCER:20221114AB-001", "09:15", "serious_injury", 99)
    assert r["ped_involved"] is True and r["bike_involved"] is None and r["road_name"] == "Main"
    assert r["source_metadata"]["conflicts"] == [] and "driver" not in r["source_metadata"]["raw"].asDict()


@pytest.mark.parametrize("changes, reason", [
    ({"id_cr": "x"}, "invalid_dashboard_id"), ({"County": "Atlantis"}, "unknown county: Atlantis"), ({"Municipality": "Princeton, Essex"}, "municipality_county_conflict"),
    ({"Municipality": "Ghost"}, "municipality_unmatched"), ({"dateofcrash": "2022-02-30"}, "invalid_date"), ({"Year": "2021"}, "year_date_conflict"),
    ({"dateofcrash": "2018-04-05", "Year": "2018"}, "outside_2019_2025"), ({"casenumber": " "}, "invalid_case_number"),
    ({"Date & Time of Crash": "noon"}, "invalid_datetime"), ({"Date & Time of Crash": "2022-04-06T00:00:00"}, "datetime_date_conflict"),
    ({"injurycount": "1.0"}, "invalid_injurycount"), ({"fatalitycount": "9999999999"}, "invalid_fatalitycount"),
    ({"NJDOT Summary": "[1]"}, "invalid_summary"), ({"Highest Injury Severity Rating": "?", "injurycount": "", "pedestrianinjurycount": ""}, "unrecognized_severity"),
])
def test_rejects(spark, munis, changes, reason):
    good, bad = C.prepare_dashboard(frame(spark, changes), munis)
    assert good.count() == 0 and bad.first()["reason"] == reason


@pytest.mark.parametrize("rating, changes, severity, conflicts", [
    ("Fatal Injury (K)", {}, "fatal", ["fatal_rating_with_zero_fatalities"]), ("B", {}, "minor_injury", []), ("C", {"injurycount": "0"}, "possible_injury", ["pedestrianinjurycount_exceeds_total", "injury_rating_with_zero_injured"]),
    ("O", {}, "injury_unknown", ["rating_o_with_injury_evidence"]), ("B", {"crashfatalitycount": "1"}, "fatal", ["rating_with_fatal_evidence"]),
    ("O", {"injurycount": "0", "pedestrianinjurycount": "", "fatalitycount": "1"}, "injury_unknown", ["rating_o_with_unqualified_fatality_count"]),
    ("", {}, "injury_unknown", ["missing_rating_with_injury_evidence"]), ("A", {"fatalcrashind": "y"}, "fatal", ["rating_with_fatal_evidence"]),
])
def test_severity(spark, munis, rating, changes, severity, conflicts):
    r = C.prepare_dashboard(frame(spark, {"Highest Injury Severity Rating": rating, **changes}), munis)[0].first()
    assert r["severity"] == severity and r["source_metadata"]["conflicts"] == conflicts


def test_identity_audit(spark, munis):
    raw = frame(spark, {}, {}, {"id_cr": "43", "casenumber": "AB-2"}, {"id_cr": "43", "casenumber": "AB-3"},
                {"id_cr": "44", "casenumber": "Z"}, {"id_cr": "45", "casenumber": "Z"}, {"id_cr": "x"})
    staged = D.stage_and_audit(raw, munis)
    reasons = dict(rows(staged.audited, "line", "reason"))
    assert reasons == {1: None, 2: None, 3: "conflicting_dashboard_id", 4: "conflicting_dashboard_id", 5: "ambiguous_legacy_identity", 6: "ambiguous_legacy_identity", 7: "invalid_dashboard_id"}
    assert rows(staged.counts, "input", "eligible", "duplicates", "quarantined") == [(7, 1, 1, 5)]
    assert staged.records.count() == 1


def stored(spark, prepared, **changes):
    """A stored crash made from a prepared record."""
    base = prepared.limit(1).select(
        F.lit(1).cast("long").alias("crash_id"), "dashboard_id", "external_id", "crash_date", "crash_time", "severity", "ped_involved", "bike_involved",
        *V.CASUALTY_COLUMNS, "muni_id", "road_name", "route_number", "weather_condition", F.lit("DARK").alias("light_condition"),
        F.struct("source_metadata.source", "source_metadata.schema_version", "source_metadata.raw", "source_metadata.conflicts",
                 "source_metadata.provenance", F.lit("dashboard_current").alias("location_method")).alias("source_metadata"),
        F.lit("dashboard_current").alias("geocode_quality"), F.lit(7).cast("long").alias("segment_id"), F.lit(3.0).alias("snap_distance"),
        F.lit(-74.65).alias("lon"), F.lit(40.35).alias("lat"))
    return base.withColumns({k: F.lit(v).cast(base.schema[k].dataType) for k, v in changes.items()})


def outcome(spark, munis, record=None, allow_new=False, **changes):
    prepared = C.prepare_dashboard(frame(spark, record or {}), munis)[0].drop("line", "source_year")
    crashes = stored(spark, prepared, **changes) if changes.pop("known", True) else stored(spark, prepared).limit(0)
    return D.run_reconciliation(prepared, crashes, munis, allow_new=allow_new).actions.first()


def test_reconciliation_outcomes(spark, munis):
    assert outcome(spark, munis)["outcome"] == "unchanged"
    moved = outcome(spark, munis, lon=-74.5, bike_involved=True, ped_involved=True)
    assert moved["outcome"] == "updated" and moved["values"]["segment_id"] is None and moved["values"]["bike_involved"] is True
    legacy = outcome(spark, munis, dashboard_id=None, external_id="NJDOT:2022:MERCER:20221114AB-001", severity="injury_unknown")
    assert legacy["outcome"] == "updated" and legacy["values"]["segment_id"] == 7 and legacy["values"]["light_condition"] == "DARK"
    assert outcome(spark, munis, dashboard_id="77")["outcome"] == "existing_dashboard_identity_conflict"
    assert outcome(spark, munis, muni_id=98)["outcome"] == "existing_date_or_municipality_conflict"
    fought = outcome(spark, munis, record={"NJDOT Summary": "Bicycle Involved"}, bike_involved=False)
    assert fought["values"]["bike_involved"] is True and fought["values"]["source_metadata"]["conflicts"] == ["bicycle_flag_conflicts_with_existing_evidence"]
    nowhere = {"Geopoint": '{"lon":-75.2,"lat":40.35}', "Geopoint (Calculated)": ""}
    assert outcome(spark, munis, record=nowhere)["outcome"] == "unchanged"          # falls back to the stored point
    assert outcome(spark, munis, record=nowhere, lon=-75.3)["outcome"] == "location_unresolved"
    assert outcome(spark, munis, external_id="other", dashboard_id=None)["outcome"] == "historical_identity_unmatched"
    assert outcome(spark, munis, external_id="other", dashboard_id=None, allow_new=True)["outcome"] == "unknown_source_overlap"
    assert outcome(spark, munis, external_id="NJDOT:z", dashboard_id=None, allow_new=True)["outcome"] == "inserted"


def test_apply_writes_all_or_nothing(spark, munis, tmp_path):
    prepared = C.prepare_dashboard(frame(spark, {}, {"id_cr": "50", "casenumber": "N", "dateofcrash": "2024-04-05", "Year": "2024", "Date & Time of Crash": ""}), munis)[0].drop("line", "source_year")
    crashes = stored(spark, prepared.filter("dashboard_id = '42'"), severity="fatal")
    dry = D.run_reconciliation(prepared, crashes, munis)
    assert dry.state is None and not (tmp_path / "new").exists()
    done = D.run_reconciliation(prepared, crashes, munis, apply_to=str(tmp_path / "new"))
    assert rows(done.state, "dashboard_id", "severity", "crash_id") == [("42", "serious_injury", 1), ("50", "serious_injury", None)]
    assert {(r["counter"], r["name"]): r["records"] for r in done.report.collect()}["outcome", "inserted"] == 1
    same = D.run_reconciliation(prepared.filter("dashboard_id = '42'"), done.state.filter("crash_id = 1"), munis, apply_to=str(tmp_path / "again"))
    assert same.actions.first()["outcome"] == "unchanged" and not (tmp_path / "again").exists()


def test_csv_scan_and_contract(spark, tmp_path):
    import csv
    def write(name, header, *lines):
        with open(tmp_path / name, "w", newline="", encoding="utf-8-sig") as f:
            csv.writer(f).writerows([header, *lines])
        return str(tmp_path / name)
    good = write("good.csv", list(BASE), list(BASE.values()), [v + '\n"x"' if k == "streetname" else v for k, v in BASE.items()])
    df = S.scan_dashboard_csv(spark, good)
    assert df.columns == list(BASE) and df.count() == 2 and [r["streetname"] for r in df.collect()][1].endswith('\n"x"')
    assert df.first()["latitude"] == ""
    for name, header in (("dup.csv", [*BASE, "County"]), ("less.csv", list(BASE)[1:])):
        with pytest.raises(S.SourceContractError):
            S.scan_dashboard_csv(spark, write(name, header, ["x"] * len(header)))
    with pytest.raises(S.SourceContractError):
        S.scan_dashboard_csv(spark, write("empty.csv", list(BASE)))
    with pytest.raises(Exception):
        S.scan_dashboard_csv(spark, write("wide.csv", list(BASE), [*BASE.values(), "extra"])).collect()
    with pytest.raises(S.SourceContractError):
        S.check_source_contract({"a": "int"}, ["a", "b"])
    with pytest.raises(S.SourceContractError):
        S.check_source_contract({"a": "int"}, ["a"], needs_m=True, has_m=False)


def test_feature_and_header_row_scans(spark, tmp_path):
    from pyspark.sql.types import StructType
    pages = tmp_path / "pages"
    pages.mkdir()
    feature = lambda i: {"attributes": {"OBJECTID": i, "sri": " a1 ", "f_system_code": 3}, "geometry": {"hasM": True, "paths": [[[-74.75, 40.2, 1.0], [-74.747, 40.2, 1.2]]]}}
    (pages / "1.json").write_text(json.dumps({"features": [feature(19)]}))
    (pages / "2.json").write_text(json.dumps({"features": [feature(20)]}))
    attributes = StructType.fromDDL("OBJECTID long, sri string, f_system_code int")
    df = S.scan_feature_pages(spark, str(pages), attributes, "OBJECTID", expected=2)
    paths, routes, rejects = C.parse_road_feature(df.select("OBJECTID", "sri", "f_system_code", "geometry.paths"))
    assert rows(paths, "source_id", "sri", "road_class") == [("NJDOT:19:0", "A1", "arterial"), ("NJDOT:20:0", "A1", "arterial")]
    assert rows(routes, "mp_start", "mp_end") == [(1.0, 1.2), (1.0, 1.2)] and rejects.isEmpty()
    with pytest.raises(S.SourceContractError):
        S.scan_feature_pages(spark, str(pages), attributes, "OBJECTID", expected=3)
    (pages / "3.json").write_text(json.dumps({"features": [feature(19)]}))
    with pytest.raises(S.SourceContractError):
        S.scan_feature_pages(spark, str(pages), attributes, "OBJECTID")
    (tmp_path / "acs.json").write_text(json.dumps([["NAME", "state", "county", "tract"], ["x", "34", "021", "000100"]]))
    assert S.scan_header_row_json(spark, str(tmp_path / "acs.json")).first()["tract_id"] == "34021000100"
    square = [[[-75, 40], [-74, 40], [-74, 41], [-75, 40]]]
    (tmp_path / "tracts.json").write_text(json.dumps({"features": [{"properties": {"GEOID": "34021000100", "COUNTYFP": "021"}, "geometry": {"type": "Polygon", "coordinates": square}}]}))
    t = S.scan_tract_boundaries(spark, str(tmp_path / "tracts.json")).first()
    assert t["tract_id"] == "34021000100" and len(t["rings"]) == 1 and t["rings"][0][1]["x"] == -74.0
    roads = {"crs": {"properties": {"name": "urn:ogc:def:crs:OGC:1.3:CRS84"}}, "features": [{"properties": {"highway": "primary"}, "geometry": {"type": "LineString", "coordinates": [[-75, 40], [-74, 40]]}}]}
    (tmp_path / "roads.json").write_text(json.dumps(roads))
    r = S.scan_road_features(spark, str(tmp_path / "roads.json"), StructType.fromDDL("highway string")).first()
    assert r["highway"] == "primary" and len(r["pts"]) == 2
    roads["crs"]["properties"]["name"] = "EPSG:3424"
    (tmp_path / "other.json").write_text(json.dumps(roads))
    with pytest.raises(S.SourceContractError):
        S.scan_road_features(spark, str(tmp_path / "other.json"), StructType.fromDDL("highway string"))


def test_sample_documents(spark, tmp_path):
    square = [[[-75, 40], [-74, 40], [-74, 41], [-75, 40]]]
    docs = {
        "municipalities": [{"muni_id": 1, "name": "A", "county": "Mercer", "muni_code": "1", "center_lat": 40.0, "center_lon": -74.0, "boundary": {"type": "Polygon", "coordinates": square}}],
        "road_segments": [{"osm_id": "9", "road_name": "R", "road_type": "primary", "road_class": "arterial", "length_miles": 0.1, "muni_id": 1, "geometry": {"type": "LineString", "coordinates": [[-75, 40], [-74, 40]]}}],
        "crashes": [{"crash_id": 1, "external_id": "e", "crash_date": "2022-01-02", "severity": "fatal", "ped_involved": True, "muni_id": 1, "latitude": 40.0, "longitude": -74.5}],
        "census_tracts": [{"tract_id": "34", "muni_id": 1, "svi_percentile": 80.0, "geometry": {"type": "MultiPolygon", "coordinates": [square]}}],
    }
    for name, rows_ in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(rows_))
    out = S.scan_sample_json(spark, str(tmp_path))
    assert len(out["municipalities"].first()["rings"][0]) == 4 and len(out["road_segments"].first()["pts"]) == 2
    assert str(out["crashes"].first()["crash_date"]) == "2022-01-02" and out["crashes"].first()["bike_involved"] is None
    assert len(out["census_tracts"].first()["rings"]) == 1


def test_files_are_read_by_their_own_header(spark, tmp_path):
    from hazardgrid.sources.files import SourceContractError, scan_header_row_json
    (tmp_path / "a.json").write_text('[["state","county","tract","n"],["34","001","000100","7"]]')
    (tmp_path / "b.json").write_text('[["n","tract","county","state"],["8","000200","003","34"],["9","000300"]]')
    got = sorted(map(tuple, scan_header_row_json(spark, str(tmp_path)).select("tract_id", "n").collect()), key=lambda r: r[1])
    assert got == [("34001000100", "7"), ("34003000200", "8"), (None, "9")]
    (tmp_path / "c.json").write_text('[["state","other"]]')
    with pytest.raises(SourceContractError):
        scan_header_row_json(spark, str(tmp_path))


@pytest.mark.parametrize("multi_line", [True, False])
def test_every_file_is_read_by_its_own_header(spark, tmp_path, multi_line):
    from hazardgrid import fixed_values as V
    from hazardgrid.sources.files import SourceContractError, scan_dashboard_csv
    names = list(V.DASHBOARD_REQUIRED)
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + (",".join(names) + "\n" + ",".join(f"a{i}" for i, _ in enumerate(names)) + "\n").encode())
    assert scan_dashboard_csv(spark, str(tmp_path), multi_line=multi_line).count() == 1
    other = [*reversed(names), "extra"]
    (tmp_path / "b.csv").write_text(",".join(other) + "\n" + ",".join([*(f"b{len(names) - 1 - i}" for i, _ in enumerate(names)), "more"]) + "\n")
    got = rows(scan_dashboard_csv(spark, str(tmp_path), multi_line=multi_line), *names, "extra")
    assert got == [(*(f"{f}{i}" for i, _ in enumerate(names)), e) for f, e in (("a", ""), ("b", "more"))]
    (tmp_path / "c.csv").write_text(",".join(names[1:]) + "\n")
    with pytest.raises(SourceContractError):
        scan_dashboard_csv(spark, str(tmp_path), multi_line=multi_line)
