import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from hazardgrid.functions import spatial as S
from hazardgrid.operators import boundaries as B
from hazardgrid.operators import equity as E
from hazardgrid.operators import overlay as O
from hazardgrid.operators import validity as P

PTS = "array<struct<x:double,y:double>>"


def pts(*xy):
    return [{"x": float(x), "y": float(y)} for x, y in xy]


def ring(x0, y0, x1, y1):
    return pts((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))


def test_overlay_takes_the_lowest_tract_id_and_keeps_unknown(spark):
    roads = spark.createDataFrame([(i, pts((x, 0.5), (x + .1, 0.5))) for i, x in enumerate((0.2, 2.2, 4.2, 9.0), 1)], f"segment_id long, pts {PTS}")
    tracts = spark.createDataFrame([
        ("a", 99.0, 50.0, [ring(0, 0, 1, 1)]), ("b", 1.0, 99.0, [ring(0, 0, 1, 1)]),
        ("c", None, 90.0, [ring(2, 0, 3, 1)]), ("d", 88.0, None, [ring(4, 0, 5, 1)])],
        f"tract_id string, svi_score double, svi_percentile double, rings array<{PTS}>")
    out = E.equity_overlay(roads.select("segment_id"), roads, tracts)
    assert rows(out, "segment_id", "avg_svi_score", "in_vulnerable_tract") == [
        (1, 99.0, False), (2, None, True), (3, 88.0, None), (4, None, None)]


def test_point_cover_honours_holes_and_edges(spark):
    munis = spark.createDataFrame([(1, [ring(0, 0, 10, 10), ring(4, 4, 6, 6)]), (2, [ring(20, 0, 20.001, .001)])], f"muni_id int, rings array<{PTS}>")
    p = spark.createDataFrame([(1, 1, 1.0, 1.0), (2, 1, 5.0, 5.0), (3, 1, 4.0, 5.0), (4, 1, 0.0, 3.0), (5, 1, 11.0, 3.0), (6, 1, None, None),
                               (7, 2, 20.0005, .0005), (8, 9, 1.0, 1.0), (9, 1, 10.0, 10.0)], "id long, muni_id int, lon double, lat double")
    out = dict(rows(B.point_covered(p, munis), "id", "covered"))
    assert out == {1: True, 2: False, 3: True, 4: True, 5: False, 6: False, 7: True, 8: False, 9: True}


def test_within_excludes_the_boundary_and_repeats_overlaps(spark):
    munis = spark.createDataFrame([(1, [ring(0, 0, 2, 2)]), (2, [ring(1, 1, 3, 3)])], f"muni_id int, rings array<{PTS}>")
    p = spark.createDataFrame([(1, 1.5, 1.5), (2, 0.0, 1.0), (3, 9.0, 9.0)], "crash_id long, lon double, lat double")
    assert rows(B.assign_boundary(p, munis), "crash_id", "muni_id") == [(1, 1), (1, 2), (2, None), (3, None)]


def test_intersections_of_lines_and_polygons_of_all_sizes(spark):
    polys = spark.createDataFrame([(1, [ring(0, 0, 50, 50)]), (2, [ring(10, 10, 10.0005, 10.0005)]), (3, [ring(60, 60, 61, 61)])], f"muni_id int, rings array<{PTS}>")
    lines = spark.createDataFrame([(1, pts((-5, 10.0002), (70, 10.0002))), (2, pts((60.2, 60.2), (60.3, 60.3))), (3, pts((70, 70), (71, 71))), (4, pts((61, 61), (62, 62)))], f"segment_id long, pts {PTS}")
    assert rows(B.assign_boundary_intersects(lines, polys), "segment_id", "muni_id") == [(1, 1), (1, 2), (2, 3), (3, None), (4, 3)]
    a = spark.createDataFrame([(7, [ring(1, 1, 2, 2)]), (8, [ring(-1, -1, 90, 90)]), (9, [ring(200, 0, 201, 1)])], f"tract_id long, rings array<{PTS}>")
    assert rows(B.tracts_touching_boundary(a, polys), "muni_id", "tract_id") == [(1, 7), (1, 8), (2, 8), (3, 8)]


def test_projection_round_trip_and_known_point(spark):
    df = spark.createDataFrame([(-75.0, 40.0), (-74.2, 40.9), (-75.5, 39.1)], "lon double, lat double").withColumn("m", S.to_metric(F.col("lon"), F.col("lat")))
    got = df.withColumn("g", S.to_lonlat(F.col("m.x"), F.col("m.y"))).collect()
    assert max(max(abs(r["g"]["x"] - r["lon"]), abs(r["g"]["y"] - r["lat"])) for r in got) < 1e-11
    assert tuple(got[0]["m"]) == pytest.approx((500000.0, 4427757.219), abs=.01)


def test_projection_in_columns_is_the_projection(spark):
    df = spark.createDataFrame([(-75.0, 40.0), (-74.2, 40.9), (None, 39.1)], "lon double, lat double").withColumn("m", S.to_metric(F.col("lon"), F.col("lat")))
    df = S.with_steps(df, "n", S.TO_METRIC, {"lon": F.col("lon"), "lat": F.col("lat")})
    df = S.with_steps(df, "g", S.TO_LONLAT, {"x": F.col("m.x"), "y": F.col("m.y")}).withColumn("h", S.to_lonlat(F.col("m.x"), F.col("m.y")))
    assert df.columns == ["lon", "lat", "m", "n", "g", "h"] and all(r["m"] == r["n"] and r["g"] == r["h"] for r in df.collect())


def test_pieces_are_projected_in_compiled_columns_and_paths_are_spread(spark):
    parts = spark.createDataFrame([("p", "1", 0, 7, pts((-74.75, 40.2), (-74.7, 40.3)))], f"source_id string, muni_code string, part int, muni_id int, pts {PTS}")
    plan = O.split_line_equal(parts, 0.05)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "sinh(" in plan and not [p for p in plan.splitlines() if "sinh(" in p and "lambda" in p]
    munis = spark.createDataFrame([(1, "1", [ring(0, 0, 1, 1)])], f"muni_id int, muni_code string, rings array<{PTS}>")
    paths = spark.createDataFrame([("in", pts((.1, .1), (.2, .2)))], f"source_id string, pts {PTS}").coalesce(1)
    assert "RoundRobinPartitioning" in O.stretches_inside(paths, munis)._jdf.queryExecution().executedPlan().toString()


def clipped(spark, munis, **paths):
    m = spark.createDataFrame([(i, str(i), rings) for i, rings in munis.items()], f"muni_id int, muni_code string, rings array<{PTS}>")
    p = spark.createDataFrame(list(paths.items()), f"source_id string, pts {PTS}")
    out = O.clip_paths(p, m)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    return sorted((r["source_id"], r["muni_id"], r["part"], [(q["x"], q["y"]) for q in r["pts"]]) for r in out.collect())


def test_clip_gives_parts_in_order_and_leaves_covered_paths_alone(spark):
    two = [ring(0, 0, 1, 1), ring(2, 0, 3, 1)]
    zigzag = pts((.1, .1), (.5, .9), (.5, .9), (.9, .1))
    got = clipped(spark, {1: two}, across=pts((-1, .5), (4, .5)), inside=zigzag, far=pts((5, 5), (6, 6)), corner=pts((-1, 1), (1, 3)), border=pts((0, .2), (0, .7)))
    assert got == [("across", 1, 1, [(0, .5), (1, .5)]), ("across", 1, 2, [(2, .5), (3, .5)]), ("border", 1, 0, [(0, .2), (0, .7)]),
                   ("inside", 1, 0, [(.1, .1), (.5, .9), (.5, .9), (.9, .1)])]


def test_clip_slanted_concave_and_holed(spark):
    bay = pts((0, 0), (4, 0), (4, 3), (2, 1), (0, 3), (0, 0))                     # concave: a bay from the top
    lake = [ring(10, 0, 14, 4), pts((11, 2), (12, 1), (13, 2), (12, 3), (11, 2))]
    got = clipped(spark, {1: [bay], 2: lake}, high=pts((-1, 2), (5, 2)), low=pts((-1, .5), (5, .5)), tip=pts((1, 1), (3, 1)), wet=pts((9, 2), (15, 2)),
                  shore=pts((11, 2), (12, 3)), through=pts((10.5, .5), (13.5, 3.5)))
    by = {}
    for source, muni, part, line in got:
        by.setdefault((source, muni), []).append((part, [(round(x, 9), round(y, 9)) for x, y in line]))
    assert by["high", 1] == [(1, [(0, 2), (1, 2)]), (2, [(3, 2), (4, 2)])] and by["low", 1] == [(0, [(0, .5), (4, .5)])]
    assert by["tip", 1] == [(0, [(1, 1), (3, 1)])]                               # touches the bay's tip and stays inside
    assert by["wet", 2] == [(1, [(10, 2), (11, 2)]), (2, [(13, 2), (14, 2)])] and by["shore", 2] == [(0, [(11, 2), (12, 3)])]
    assert by["through", 2] == [(1, [(10.5, .5), (11.5, 1.5)]), (2, [(12.5, 2.5), (13.5, 3.5)])] and len(by) == 6


def test_split_gives_equal_pieces_with_stable_ids(spark):
    munis = spark.createDataFrame([(1, "1114", [ring(-75, 40, -74, 41)])], f"muni_id int, muni_code string, rings array<{PTS}>")
    paths = spark.createDataFrame([("NJDOT:19:0", pts((-74.75, 40.2), (-74.747, 40.2)))], f"source_id string, pts {PTS}")
    pieces = O.split_line_equal(O.clip_paths(paths, munis))
    got = rows(pieces, "source_id", "length_miles", "muni_id")
    assert [g[0] for g in got] == ["NJDOT:19:0:M1114:P0:S0", "NJDOT:19:0:M1114:P0:S1"]
    assert got[0][1] == pytest.approx(got[1][1], rel=1e-6) and .05 < got[0][1] <= .1


def test_paths_that_only_touch_have_no_boundary(spark):
    munis = spark.createDataFrame([(1, "1", [ring(0, 0, 1, 1)])], f"muni_id int, muni_code string, rings array<{PTS}>")
    paths = spark.createDataFrame([("in", pts((.1, .1), (.2, .2))), ("touch", pts((1, .5), (2, .5))), ("out", pts((5, 5), (6, 6)))], f"source_id string, pts {PTS}")
    assert rows(O.paths_without_boundary(paths, munis), "source_id") == [("out",), ("touch",)]


def test_polygon_repair_and_audit(spark):
    df = spark.createDataFrame([
        (1, [pts((0, 0), (1, 0), (1, 0), (1, 1), (0, 1))]),                    # open, repeated vertex
        (2, [pts((0, 0), (2, 2), (2, 0), (0, 1), (0, 0))]),                    # crosses itself
        (3, [pts((0, 0), (1, 1), (0, 0))]), (4, [ring(0, 0, 1, 1)])], f"id long, rings array<{PTS}>")
    good, bad = P.repair_polygon(df)
    assert rows(good, "id") == [(1,), (4,)]
    assert rows(bad, "id", "reason") == [(2, "self_intersection"), (3, "empty_geometry")]
    assert good.filter("id = 1").select(F.size(F.col("rings")[0])).first()[0] == 5


def test_pieces_follow_bends_and_add_up(spark):
    line = pts((-74.75, 40.2), (-74.748, 40.2004), (-74.748, 40.2004), (-74.7475, 40.2031), (-74.745, 40.2))
    parts = spark.createDataFrame([("p", "1", 0, 7, line), ("none", "1", 0, 7, line[:1] * 2)], f"source_id string, muni_code string, part int, muni_id int, pts {PTS}")
    got = sorted(O.split_line_equal(parts, 0.05).withColumn("m", S.metric_length(F.col("pts"))).collect(), key=lambda r: r["piece"])
    total = parts.filter("source_id = 'p'").select(S.metric_length(F.col("pts"))).first()[0]
    assert len(got) == math.ceil(total / (0.05 * 1609.344)) and {r["muni_id"] for r in got} == {7}
    assert all(r["m"] == pytest.approx(total / len(got), abs=1e-6) for r in got)
    ends = [(r["pts"][0], r["pts"][-1]) for r in got]
    assert ends[0][0]["x"] == -74.75 and ends[-1][1]["x"] == -74.745
    assert all(a[1]["x"] == pytest.approx(b[0]["x"], abs=1e-11) and a[1]["y"] == pytest.approx(b[0]["y"], abs=1e-11) for a, b in zip(ends, ends[1:]))
    assert {(-74.748, 40.2004), (-74.7475, 40.2031)} <= {(q["x"], q["y"]) for r in got for q in r["pts"]}


def test_large_ring_and_rings_through_each_other(spark):
    n = 20_000
    circle = [(math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n)) for i in range(n)]
    loop = circle[:5000] + [circle[5002], circle[5001]] + circle[5003:]             # two vertices change places far inside the ring
    df = spark.createDataFrame([
        (1, [pts(*circle, circle[0])]), (2, [pts(*loop, loop[0])]), (3, [ring(0, 0, 4, 4), ring(1, 1, 2, 2)]), (4, [ring(0, 0, 4, 4), ring(3, 1, 5, 2)]),
        (5, [ring(0, 0, 4, 4), pts((0, 2), (1, 1), (2, 2), (1, 3), (0, 2))]), (6, [pts((0, 0), (4, 0), (4, 4), (2, 4), (2, 6), (2, 4), (0, 4), (0, 0))]), (7, None), (8, [])],
        f"id long, rings array<{PTS}>")
    assert dict(rows(P.polygon_problems(df), "id", "reason")) == {2: "self_intersection", 4: "ring_crossing", 6: "self_intersection", 7: "empty_geometry", 8: "empty_geometry"}


def test_wkt(spark):
    one = spark.range(1).select(
        S.to_multipolygon_wkt(F.array(S.box_rings(F.lit(0), F.lit(0), F.lit(1), F.lit(2)))).alias("ok"),
        S.to_multipolygon_wkt(F.array(F.array(S.line((F.lit(0), F.lit(0)), (F.lit(1), F.lit(1)))))).alias("bad")).first()
    assert one["ok"] == "MULTIPOLYGON (((0.0 0.0, 1.0 0.0, 1.0 2.0, 0.0 2.0, 0.0 0.0)))" and one["bad"] is None


def test_boundary_features(spark):
    from hazardgrid.operators.validation import normalize_boundary
    box = [ring(0, 0, 1, 1)]
    df = spark.createDataFrame([
        (1, "1113 ", "West Windsor", None, "MERCER", "Township", "Polygon", box), (2, "1114", None, "Princeton", "cape may", "Borough", "MultiPolygon", box),
        (3, "1113", "Again", None, "MERCER", "Township", "Polygon", box), (4, "", "No Code", None, "MERCER", "Town", "Polygon", box),
        (5, "1115", "Line", None, "MERCER", "Town", "LineString", box)],
        f"seq long, MUN_CODE string, MUN_LABEL string, NAME string, COUNTY string, MUN_TYPE string, geometry_type string, rings array<{PTS}>")
    good, bad = normalize_boundary(df)
    assert rows(good, "muni_code", "name", "county") == [("1113", "West Windsor", "Mercer"), ("1114", "Princeton", "Cape May")]
    assert rows(bad, "seq", "reason") == [(3, "duplicate_code"), (4, "required_fields"), (5, "boundary_geometry")]


def test_lengths_and_legacy_csv(spark, tmp_path):
    from hazardgrid.operators.validation import standardize_legacy_crashes
    from hazardgrid.sources.files import scan_legacy_crash_csv
    one = spark.range(1).select(S.line_length_m(S.line((F.lit(-75.0), F.lit(40.0)), (F.lit(-75.0), F.lit(40.01)))).alias("m")).first()
    assert one["m"] == pytest.approx(1110.36, abs=.05)
    (tmp_path / "c.csv").write_text("DATE,SEVERITY,LAT,LON,BICYCLE\n2020-01-02,Killed,40.1,-74.5,yes\n,PDO,40.1,-74.5,no\n2020-01-03,?,50,-74.5,1\n")
    out = standardize_legacy_crashes(scan_legacy_crash_csv(spark, str(tmp_path / "c.csv")))
    assert rows(out, "severity", "bike_involved", "geocode_quality") == [("fatal", True, "medium")]
