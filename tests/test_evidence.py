import datetime as dt
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from hazardgrid.operators import evidence as E
from hazardgrid.operators import filters as D
from hazardgrid.operators import freshness as M
from hazardgrid.operators import summaries as U
from hazardgrid.sinks import exports as X

CASE = ("crash_id long, crash_date date, severity string, ped_involved boolean, bike_involved boolean, total_killed int, total_injured int, "
        "pedestrians_killed int, pedestrians_injured int, muni_id int, segment_id long, geocode_quality string")


@pytest.fixture(scope="module")
def world(spark):
    d = dt.date
    crashes = spark.createDataFrame([
        (1, d(2022, 1, 1), "fatal", True, None, 1, 0, 1, 0, 1, 10, "reported"), (2, d(2022, 6, 1), "injury_unknown", False, False, None, 2, 0, 0, 1, 10, " "),
        (3, d(2024, 6, 1), "property_damage", False, True, 0, 0, 0, 0, 1, 11, None), (4, d(2023, 1, 1), "fatal", True, True, 9, 9, 9, 9, 2, 20, "reported"),
        (5, d(2021, 12, 31), "fatal", True, True, 1, 1, 1, 1, 1, 10, "reported")], CASE)
    roads = spark.createDataFrame([(1, 10, .6, "A", "Main"), (1, 11, .4, None, " "), (1, 12, 1.0, None, None), (1, 13, .001, None, None), (2, 20, 1.0, "B", "B")],
                                  "muni_id int, segment_id long, length_miles double, sri string, road_name string")
    hin = spark.createDataFrame([
        (1, 100, 10, 9, 1.0, True, 5, 4, 1, 0, 0, None), (2, 100, 10, 9, 2.0, True, 5, 6, 1, 0, None, True), (3, 100, 11, 9, 3.0, True, None, 1, 0, 0, 0, False),
        (4, 100, 12, 9, 9.0, False, 5, 9, 9, 9, 9, True), (5, 101, 12, 9, 9.0, True, 5, 9, 9, 9, 9, True), (6, 100, 20, 9, 9.0, True, 5, 9, 9, 9, 9, True)],
        "hin_id long, analysis_id int, segment_id long, severity_score int, crash_rate double, is_significant boolean, corridor_id int, crash_count_total int, "
        "crash_count_fatal int, crash_count_serious_injury int, crash_count_possible_injury int, in_vulnerable_tract boolean",
    ).withColumn("corridor_name", F.lit("C")).withColumn("is_ped_hin", F.col("hin_id") == 2).withColumn("is_bike_hin", F.lit(False))
    analyses = spark.createDataFrame([(100, 1, 2022, 2024, "completed")], "analysis_id int, muni_id int, start_year int, end_year int, status string")
    return crashes, roads, hin, analyses


def test_selection_is_newest_and_local(world):
    _, roads, hin, analyses = world
    assert rows(E.latest_result_per_segment(hin, roads, analyses), "segment_id", "hin_id") == [(10, 2), (11, 3)]
    top = E.top_segments(E.latest_result_per_segment(hin, roads, analyses), k=1)
    assert rows(top, "segment_id", "rank") == [(11, 1)]


def test_network_totals_do_not_multiply(world):
    crashes, roads, hin, analyses = world
    r = E.network_totals(crashes, E.latest_result_per_segment(hin, roads, analyses), roads, 2022, 2024).filter("muni_id = 1").first()
    assert r["selected_miles"] == pytest.approx(1) and r["selected_crashes"] == 3 and r["loaded_crashes"] == 3
    assert r["selected_killed"] is None and r["selected_injured"] == 2
    assert r["road_share_pct"] == pytest.approx(50) and r["crash_share_pct"] == pytest.approx(100)
    assert (r["known_segments"], r["unknown_segments"], r["high_vulnerability_miles"]) == (2, 0, pytest.approx(.6))


def test_annual_gap_years(spark, world):
    munis = spark.createDataFrame([(1,), (3,)], "muni_id int")
    got = {(r["muni_id"], r["year"]): r for r in E.annual_evidence(world[0], munis, 2022, 2024).collect()}
    assert got[(1, 2022)]["total_crashes"] == 2 and got[(1, 2022)]["total_killed"] is None and got[(1, 2022)]["total_injured"] == 2
    assert got[(1, 2023)]["total_crashes"] == 0 and got[(1, 2023)]["total_killed"] is None and len(got) == 6


def test_corridors(world):
    crashes, roads, hin, analyses = world
    sel = E.latest_result_per_segment(hin, roads, analyses)
    c = E.top_corridors(E.corridor_evidence(sel, crashes, 2022, 2024))
    got = rows(c, "rank", "corridor_id", "first_segment_id", "crashes", "injury_unknown_crashes")
    assert got == [(1, 5, 10, 6, 1), (2, None, 11, 1, 0)]
    assert c.filter("rank = 1").first()["rate"] == pytest.approx(6 / (.6 * 3))
    assert rows(E.corridor_members(sel), "first_segment_id", "segment_id") == [(10, 10), (11, 11)]


def test_summary_and_quality(spark, world):
    crashes, roads, hin, analyses = world
    munis = spark.createDataFrame([(1, "A", "Mercer"), (3, "C", "Essex")], "muni_id int, name string, county string")
    s = {r["muni_id"]: r for r in U.municipality_summary(crashes, munis, 2022, 2024).collect()}
    assert s[1]["total_crashes"] == 3 and s[1]["total_killed"] is None and s[1]["total_injured"] == 2 and not s[1]["casualty_counts_complete"]
    assert s[3]["total_crashes"] == 0 and s[3]["total_killed"] is None and s[3]["casualty_counts_complete"] is False
    assert s[1]["bike_involvement_unknown_crashes"] == 1
    assert rows(U.geocode_counts(crashes, 2022, 2024).filter("muni_id = 1"), "method", "crashes") == [(" ", 1), ("reported", 1), ("unknown", 1)]
    assert rows(U.location_methods(crashes, 2022, 2024).filter("muni_id = 1"), "method", "crashes") == [("reported", 1), ("unknown", 2)]
    totals = E.analysis_summary(crashes, hin, roads, analyses).first()
    assert totals["total_crashes"] == 3 and totals["total_fatalities"] is None and totals["hin_segment_count"] == 4
    r = E.report_summary(crashes, munis, hin, roads, analyses, 2022, 2024).first()
    assert r["vulnerable_tract_percentage"] == pytest.approx(100 * 2 / 3) and r["hin_corridors"] == 1


def test_year_rules(spark, world):
    d = dt.date
    many = spark.createDataFrame([(m, d(y, 1, 1)) for m, ys in ((1, range(2016, 2023)), (2, (2012, 2014, 2015, 2016, 2017, 2018, 2019)), (3, (2020, 2022))) for y in ys], "muni_id int, crash_date date")
    assert rows(U.default_year_range(many)) == [(1, 2017, 2021), (2, 2015, 2019), (3, 2022, 2022)]
    munis = spark.createDataFrame([(1,), (2,)], "muni_id int")
    with pytest.raises(M.MissingCrashData):
        M.require_years(many, munis, 2012, 2013)
    M.require_years(many, munis, 2016, 2019)
    runs = spark.createDataFrame([
        (1, 1, 2016, 2018, "completed", 3, "v"), (2, 1, 2016, 2018, "completed", 4, "v"), (3, 1, 2015, 2018, "completed", 3, "v"), (4, 1, 2000, 2001, "completed", 0, "v"),
        (5, 1, 2000, 2001, "running", None, None), (6, 1, 2016, 2018, "completed", 3, None), (7, 9, 2016, 2018, "completed", 0, "v")],
        "analysis_id int, muni_id int, start_year int, end_year int, status string, total_crashes long, input_version string")
    assert dict(rows(M.assess_freshness(runs, many, "v"), "analysis_id", "data_status")) == {
        1: "ready", 2: "stale", 3: "missing_years", 4: "no_data", 5: "ready", 6: "stale", 7: "no_data"}


def test_fingerprints_see_edits_but_not_order(spark, world):
    crashes = world[0]
    one = M.dataset_fingerprint("crashes", crashes, ["crash_id", "severity", "total_killed"]).first()
    assert M.dataset_fingerprint("crashes", crashes.orderBy(F.desc("crash_id")), ["crash_id", "severity", "total_killed"]).first() == one
    edited = crashes.withColumn("total_killed", F.when(F.col("crash_id") == 2, 0).otherwise(F.col("total_killed")))
    assert M.dataset_fingerprint("crashes", edited, ["crash_id", "severity", "total_killed"]).first() != one
    snapped = crashes.withColumn("segment_id", F.lit(1).cast("long"))
    assert M.row_fingerprint(snapped, ("segment_id",)).first() == M.row_fingerprint(crashes, ("segment_id",)).first()


def test_exports(spark, world, tmp_path):
    crashes, roads, hin, _ = world
    located = crashes.withColumn("lon", F.lit(-74.5)).withColumn("lat", F.lit(40.5)).withColumn("road_name", F.when(F.col("crash_id") == 1, " =1+1").otherwise("x-1"))
    out = X.export_csv(X.crash_features(located, muni_id=1, y1=2022, y2=2024), "crashes")
    assert out.columns[:3] == ["crash_id", "date", "severity"] and rows(out, "crash_id", "road_name") == [(1, "' =1+1"), (2, "x-1"), (3, "x-1")]
    X.write_csv(out, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert text.startswith("crash_id,date,severity") and ",fatal,true,," in text
    features = X.crash_geojson(located, muni_id=1)
    one = json.loads(features.filter("crash_id = 2").first()["feature"])
    assert one["properties"]["total_killed"] is None and one["geometry"] == {"type": "Point", "coordinates": [-74.5, 40.5]} and len(one["properties"]) == 15
    X.write_features(features, str(tmp_path / "geo"), single_collection=True)
    doc = json.loads("".join(p.read_text() for p in (tmp_path / "geo").glob("part-*")))
    assert doc["type"] == "FeatureCollection" and len(doc["features"]) == 4
    shaped = roads.withColumn("pts", F.array(F.struct(F.lit(-74.5).alias("x"), F.lit(40.0).alias("y")), F.struct(F.lit(-74.4).alias("x"), F.lit(40.0).alias("y"))))
    line = json.loads(X.hin_geojson(hin, shaped, "pedestrian").first()["feature"])
    assert line["properties"]["crash_count_possible_injury"] is None and line["geometry"]["coordinates"] == [[-74.5, 40.0], [-74.4, 40.0]]
    with pytest.raises(ValueError):
        D.filter_hin_type(hin, "bicycle", unknown_involvement=3)
    known = spark.createDataFrame([(True,), (False,)], "bike_involved boolean")
    assert X.hin_features(hin, shaped, "bicycle", known).count() == hin.filter("is_significant AND is_bike_hin").join(shaped, "segment_id").count()
    for crashes_ in (None, known.unionByName(spark.createDataFrame([(None,)], "bike_involved boolean"))):
        with pytest.raises(ValueError):
            X.hin_geojson(hin, shaped, "bicycle", crashes_)
    with pytest.raises(ValueError):
        D.filter_hin_type(hin, "other")
    X.write_run_report(spark.range(1), str(tmp_path / "run"))
    assert (tmp_path / "run" / "_SUCCESS").exists()
