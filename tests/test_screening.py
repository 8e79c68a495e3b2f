import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from hazardgrid.functions.poisson import upper_tail
from hazardgrid.operators import segments as G
from hazardgrid.plans import screening as P

STATS = ("muni_id int, segment_id long, length_miles double, road_class string, total_crashes long, fatal_crashes long, "
         "serious_injury_crashes long, minor_injury_crashes long, possible_injury_crashes long, property_damage_crashes long, "
         "ped_crashes long, bike_crashes long, severity_score long")


def stats(spark, *items):
    return spark.createDataFrame([(1, i, length, cls, n, 0, 0, 0, 0, n, ped, 0, n) for i, length, cls, n, ped in items], STATS)


def screen(df, years=1, alpha=.05):
    return {r["segment_id"]: r for r in G.poisson_screen(G.leave_one_out_baseline(df, years), years, alpha).collect()}


def test_leave_one_out_expectations(spark):
    out = screen(stats(spark, (1, .1, "local", 1, 0), (2, .1, "local", 3, 2), (3, 10.0, "local", 1, 0)))
    assert out[1]["expected_crashes"] == pytest.approx(4 / 10.1 * .1) and not out[1]["is_significant"]
    assert out[2]["expected_crashes"] == pytest.approx(2 / 10.1 * .1) and out[2]["p_value"] < .001
    assert out[2]["is_significant"] and out[2]["is_ped_hin"] and not out[2]["is_bike_hin"]


def test_fallback_to_municipality_and_alone(spark):
    out = screen(stats(spark, (1, .1, "arterial", 3, 0), (2, 10.0, "local", 1, 0)))
    assert out[1]["expected_crashes"] == pytest.approx(.01) and out[1]["is_significant"]
    alone = screen(stats(spark, (1, .1, "arterial", 3, 0)))
    assert alone[1]["expected_crashes"] == 0 and alone[1]["p_value"] == 1


def test_short_fragment_is_kept_but_never_tested(spark):
    out = screen(stats(spark, (1, .001, "local", 100, 0), (2, .1, "local", 3, 0), (3, 10.0, "local", 1, 0), (4, 0.0, "local", 9, 0)))
    assert out[1]["expected_crashes"] == 0 and out[1]["p_value"] == 1 and out[2]["expected_crashes"] == pytest.approx(.01)
    assert 4 not in out


def test_null_class_is_its_own_class(spark):
    out = screen(stats(spark, (1, 1.0, None, 4, 0), (2, 1.0, None, 2, 0), (3, 1.0, "local", 50, 0), (4, 1.0, "local", 50, 0)))
    assert out[1]["expected_crashes"] == pytest.approx(2) and out[2]["expected_crashes"] == pytest.approx(4)


def test_statistics_keep_empty_segments_and_weigh_unknown_injuries(spark):
    r = spark.createDataFrame([(1, 10, .1, "local"), (1, 11, .1, "local")], "muni_id int, segment_id long, length_miles double, road_class string")
    c = spark.createDataFrame([
        (1, "2022-01-01", "fatal", True, None, 10), (2, "2023-12-31", "minor_injury", False, True, 10), (3, "2024-01-01", "fatal", True, True, 10),
        (4, "2022-05-05", "injury_unknown", None, None, 12), (5, "2022-05-05", "strange", None, None, 12)],
        "crash_id long, d string, severity string, ped_involved boolean, bike_involved boolean, segment_id long").withColumn("crash_date", F.to_date("d"))
    got = {x["segment_id"]: x for x in G.segment_stats(r, c, 2022, 2023).collect()}
    assert (got[10]["total_crashes"], got[10]["severity_score"], got[10]["ped_crashes"], got[10]["bike_crashes"]) == (2, 13, 1, 1)
    assert got[11]["total_crashes"] == 0 and got[11]["severity_score"] == 0
    twelve = r.limit(1).withColumn("segment_id", F.lit(12).cast("long"))
    assert G.segment_stats(twelve, c, 2022, 2023).first()["severity_score"] == 4          # 3 + other 1
    one = G.segment_crash_stats(c, 2022, 2023, 12).first()
    assert one["severity_score"] == 2 and one["injury_unknown_crashes"] == 1             # 1 + other 1
    assert G.segment_crash_stats(c, 2022, 2023, 999).first()["severity_score"] == 0


def _exact(n, lam):
    from fractions import Fraction
    term, total = Fraction(1), Fraction(0)
    lam_f = Fraction(lam)
    for i in range(n):
        total += term
        term = term * lam_f / (i + 1)
    return 1 - math.exp(-lam) * float(total)


def test_poisson_tail(spark):
    cases = [(0, .5), (1, 1.0), (3, .1), (3, 5.0), (5, 5.0), (50, 49.9), (30, 20.0)]
    got = spark.createDataFrame(cases, "n long, lam double").select("n", "lam", upper_tail(F.col("n"), F.col("lam")).alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(_exact(r["n"], r["lam"]), rel=1e-9, abs=1e-12)


def test_poisson_tail_stays_exact_for_large_and_tiny_values(spark):
    got = spark.createDataFrame([(100000, 100000.0), (1200, 1000.0), (100, .01)], "n long, lam double").select(
        upper_tail(F.col("n"), F.col("lam")).alias("p")).collect()
    assert got[0]["p"] == pytest.approx(.50042, abs=1e-5)
    assert got[1]["p"] == pytest.approx(4.684e-10, rel=1e-3)
    assert 0 <= got[2]["p"] < 1e-300


def test_threshold_is_checked(spark):
    with pytest.raises(ValueError):
        G.poisson_screen(None, 1, 1.5)
    with pytest.raises(ValueError):
        P.screen_segments(None, None, 2024, 2023)
