import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from hazardgrid.functions import spatial as S
from hazardgrid.operators import snapping as N

ROAD = "segment_id long, muni_id int, pts array<struct<x:double,y:double>>"
CRASH = "crash_id long, muni_id int, lon double, lat double, segment_id long, snap_distance double"


def roads(spark, *lines):
    return spark.createDataFrame([(i, m, [{"x": x, "y": y} for x, y in pts]) for i, m, pts in lines], ROAD)


def crash(spark, *items):
    return spark.createDataFrame([(*c, *([None, None] if len(c) == 4 else [])) for c in items], CRASH)


def test_metric_nearest_beats_degree_nearest(spark):
    r = roads(spark, (1, 7, [(-74.4991, 40.2999), (-74.4991, 40.3001)]), (2, 7, [(-74.5001, 40.3007), (-74.4999, 40.3007)]))
    out = N.snap_crashes(crash(spark, (1, 7, -74.5, 40.3)), r, distance_m=100).first()
    assert out["segment_id"] == 1 and 70 < out["snap_distance"] < 85


def test_tie_takes_lowest_id_and_radius_zero_works(spark):
    same = [(-74.5001, 40.3), (-74.4999, 40.3)]
    r = roads(spark, (-92061, 7, same), (-92062, 7, same), (-92060, 7, [(-74.5, 40.31), (-74.4, 40.31)]))
    out = N.snap_crashes(crash(spark, (1, 7, -74.5, 40.3)), r, distance_m=0).first()
    assert out["segment_id"] == -92062 and out["snap_distance"] == pytest.approx(0, abs=1e-6)


def test_no_match_clears_and_other_municipality_is_untouched(spark):
    r = roads(spark, (1, 7, [(-74.4996, 40.2999), (-74.4996, 40.3001)]))
    c = crash(spark, (1, 7, -74.5, 40.3, 55, 3.0), (2, 8, -74.4996, 40.3, 56, 4.0))
    assert rows(N.snap_crashes(c, r, distance_m=10, muni_id=7), "crash_id", "segment_id", "snap_distance") == [
        (1, None, None), (2, 56, 4.0)]


def test_own_municipality_only(spark):
    r = roads(spark, (1, 8, [(-74.5, 40.2999), (-74.5, 40.3001)]), (2, 7, [(-74.4996, 40.2999), (-74.4996, 40.3001)]))
    out = N.snap_crashes(crash(spark, (1, 7, -74.5, 40.3)), r).first()
    assert out["segment_id"] == 2


def test_unforced_run_keeps_assignments(spark):
    r = roads(spark, (1, 7, [(-74.5, 40.2999), (-74.5, 40.3001)]))
    c = crash(spark, (1, 7, -74.5, 40.3, 99, 1.0), (2, 7, -74.5, 40.3))
    assert rows(N.snap_crashes(c, r, force=False), "crash_id", "segment_id") == [(1, 99), (2, 1)]


@pytest.mark.parametrize("bound", [1, 3, 4096])
def test_any_bound_gives_the_same_rows(spark, bound):
    r = roads(spark, *[(i, 7, [(-74.5 + i * 1e-5, 40.2999), (-74.5 + i * 1e-5, 40.3001)]) for i in range(1, 9)])
    c = crash(spark, (5, 7, -74.49996, 40.3), (5, 7, -74.49996, 40.3), (None, 7, -74.49994, 40.3), (None, 7, -74.49994, 40.3),
              (6, 7, None, None, 9, 1.0), (7, None, -74.5, 40.3, 9, 1.0), (8, 7, -74.3, 40.3, 9, 1.0))
    got = [(x["crash_id"], x["segment_id"]) for x in N.snap_crashes(c, r, edges_per_row=bound).collect()]
    assert sorted(got, key=str) == sorted([(5, 4), (5, 4), (None, 6), (None, 6), (6, None), (7, None), (8, None)], key=str)


@pytest.mark.parametrize("bad", [-1, float("nan"), float("inf"), "far", None])
def test_invalid_distance_is_refused_before_any_work(bad):
    with pytest.raises(ValueError):
        N.snap_crashes(None, None, distance_m=bad)


def _brute(px, py, pts):
    """Vincenty-free check: dense sampling of the edge on the ellipsoid's local scale."""
    best = math.inf
    for (ax, ay), (bx, by) in zip(pts, pts[1:]):
        for k in range(2001):
            x, y = ax + (bx - ax) * k / 2000, ay + (by - ay) * k / 2000
            mid = math.radians((y + py) / 2)
            w2 = 1 - S.ECC2 * math.sin(mid) ** 2
            kx = math.radians(S.SEMI_MAJOR_M) * math.cos(mid) / math.sqrt(w2)
            ky = math.radians(S.SEMI_MAJOR_M) * (1 - S.ECC2) / w2 ** 1.5
            best = min(best, math.hypot((x - px) * kx, (y - py) * ky))
    return best


@pytest.mark.parametrize("edges_per_row", [4096, 2])
def test_matches_brute_force_also_when_cells_overflow(spark, edges_per_row):
    import random
    rnd = random.Random(5)
    lines = [(i, 1, [(-74.5 + rnd.random() * .01, 40 + rnd.random() * .01) for _ in range(rnd.choice([2, 3]))]) for i in range(40)]
    points = [(i, 1, -74.5 + rnd.random() * .01, 40 + rnd.random() * .01) for i in range(30)]
    got = {r["crash_id"]: r for r in N.snap_crashes(
        crash(spark, *points), roads(spark, *lines), distance_m=120, edges_per_row=edges_per_row).collect()}
    assert len(got) == 30
    for i, _, x, y in points:
        d, seg = min((_brute(x, y, p), s) for s, _, p in lines)
        if d < 119:
            assert got[i]["segment_id"] == seg and got[i]["snap_distance"] == pytest.approx(d, abs=.2)
        elif d > 121:
            assert got[i]["segment_id"] is None


def test_long_diagonal_edge_is_found_along_its_whole_length(spark):
    r = roads(spark, (1, 1, [(-75.0, 40.0), (-74.8, 40.15)]))
    points = [(i, 1, -75.0 + .2 * i / 20, 40.0 + .15 * i / 20) for i in range(21)]
    assert N.snap_crashes(crash(spark, *points), r).filter("segment_id = 1").count() == 21


def test_hot_point_is_not_multiplied(spark):
    r = roads(spark, (1, 7, [(-74.5, 40.2999), (-74.5, 40.3001)]), (2, 7, [(-74.5, 40.2999), (-74.5, 40.3001)]))
    c = spark.range(5000).select(F.col("id").alias("crash_id"), F.lit(7).alias("muni_id"), F.lit(-74.5).alias("lon"), F.lit(40.3).alias("lat"))
    out = N.snap_crashes(c, r)
    assert out.count() == 5000 and out.filter("segment_id = 1").count() == 5000
