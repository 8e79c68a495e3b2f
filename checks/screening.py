"""Snapping, segment statistics, baselines, Poisson screen, corridors, overlay."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import view
from hazardgrid.functions import spatial as S
from hazardgrid.operators import corridors as C
from hazardgrid.operators import equity as E
from hazardgrid.operators import segments as G
from hazardgrid.operators import snapping as N
from hazardgrid.plans import screening as P

Y1, Y2 = 1996, 1999
# Rates are rounded after a shift of 1e-10: many are exact binary fractions that end
# on the rounding digit, where the order of a sum would decide the last place.
PERIOD = "crash_date >= DATE '1996-01-01' AND crash_date < DATE '2000-01-01'"


def roads(spark, d):
    return view(spark, d, "t_road").withColumn("pts", S.line(
        (F.col("x1"), F.col("y")), (F.col("x2"), F.col("y"))))


def crashes(spark, d):
    return view(spark, d, "t_crash")


def tracts(spark, d):
    return view(spark, d, "t_tract").select(
        "tract_id", "muni_id", F.col("svi_percentile").alias("svi_score"), "svi_percentile", "source_year",
        S.box_rings(F.col("tx0"), F.col("ty0"), F.col("tx1"), F.col("ty1")).alias("rings"))


# --- SQL building blocks (independent of the library's expressions) -----------
_W2 = "(1 - 0.0066943799901413165 * sin(radians((lat + y) / 2)) * sin(radians((lat + y) / 2)))"
DISTANCE = (
    "sqrt(pow((greatest(least(lon, x2), x1) - lon) * radians(6378137.0)"
    f" * cos(radians((lat + y) / 2)) / sqrt({_W2}), 2)"
    f" + pow((y - lat) * radians(6378137.0) * (1 - 0.0066943799901413165) / ({_W2} * sqrt({_W2})), 2))"
)
SNAPPED = f"""
s_pairs AS (
  SELECT crash_id, segment_id, {DISTANCE} AS d
  FROM t_crash c JOIN t_road r ON c.muni_id = r.muni_id
   AND r.y BETWEEN c.lat - 0.001 AND c.lat + 0.001 AND c.lon BETWEEN r.x1 - 0.002 AND r.x2 + 0.002),
s_best AS (
  SELECT crash_id, segment_id, d FROM (
    SELECT *, row_number() OVER (PARTITION BY crash_id ORDER BY round(d, 6), segment_id) AS rn
    FROM s_pairs WHERE round(d, 6) <= 50) WHERE rn = 1),
s_snapped AS (
  SELECT c.* , b.segment_id, b.d AS snap_distance FROM t_crash c LEFT JOIN s_best b USING (crash_id))"""
COUNTS = """
  COUNT(crash_id) AS total_crashes,
  COUNT(CASE WHEN severity = 'fatal' THEN 1 END) AS fatal_crashes,
  COUNT(CASE WHEN severity = 'serious_injury' THEN 1 END) AS serious_injury_crashes,
  COUNT(CASE WHEN severity = 'minor_injury' THEN 1 END) AS minor_injury_crashes,
  COUNT(CASE WHEN severity = 'possible_injury' THEN 1 END) AS possible_injury_crashes,
  COUNT(CASE WHEN severity = 'property_damage' THEN 1 END) AS property_damage_crashes,
  COUNT(CASE WHEN ped_involved THEN 1 END) AS ped_crashes,
  COUNT(CASE WHEN bike_involved THEN 1 END) AS bike_crashes,
  CAST(COALESCE(SUM(CASE severity WHEN 'fatal' THEN 10 WHEN 'serious_injury' THEN 5
    WHEN 'minor_injury' THEN 3 WHEN 'possible_injury' THEN 3 WHEN 'injury_unknown' THEN 3
    ELSE CASE WHEN crash_id IS NULL THEN 0 ELSE 1 END END), 0) AS BIGINT) AS severity_score"""
STATS = f"""
s_stats AS (
  SELECT r.muni_id, r.segment_id, r.length_miles, r.road_class, {COUNTS}
  FROM t_road r LEFT JOIN s_snapped c ON c.segment_id = r.segment_id AND {PERIOD}
  GROUP BY r.muni_id, r.segment_id, r.length_miles, r.road_class)"""
BASELINE = """
s_base AS (
  SELECT a.*, CASE WHEN a.length_miles >= 0.01 THEN
      CASE WHEN cls.n > 1 THEN (cls.c - a.total_crashes) / ((cls.m - a.length_miles) * 4)
           WHEN mun.n > 1 THEN (mun.c - a.total_crashes) / ((mun.m - a.length_miles) * 4) END END AS baseline_rate
  FROM s_stats a
  LEFT JOIN (SELECT muni_id, road_class, sum(total_crashes) c, sum(length_miles) m, count(*) n
             FROM s_stats WHERE length_miles >= 0.01 GROUP BY 1, 2) cls
    ON cls.muni_id = a.muni_id AND cls.road_class IS NOT DISTINCT FROM a.road_class
  LEFT JOIN (SELECT muni_id, sum(total_crashes) c, sum(length_miles) m, count(*) n
             FROM s_stats WHERE length_miles >= 0.01 GROUP BY 1) mun ON mun.muni_id = a.muni_id)"""
SCREEN = """
s_lam AS (
  SELECT *, total_crashes / (length_miles * 4) AS crash_rate,
    CASE WHEN baseline_rate IS NULL THEN 0 ELSE baseline_rate * length_miles * 4 END AS expected_crashes
  FROM s_base WHERE length_miles > 0),
s_p AS (
  SELECT *, CASE WHEN expected_crashes > 0 THEN
      CASE WHEN total_crashes = 0 THEN 1 ELSE list_sum(list_transform(range(total_crashes, total_crashes + 400),
        lambda i: exp(-expected_crashes + i * ln(expected_crashes) - lgamma(i + 1)))) END
    ELSE 1 END AS p_value FROM s_lam),
s_screen AS (
  SELECT *, (p_value < 0.05 AND total_crashes >= 3) AS is_significant,
    (p_value < 0.05 AND total_crashes >= 3) AS is_general_hin,
    (p_value < 0.05 AND total_crashes >= 3 AND ped_crashes >= 2) AS is_ped_hin,
    (p_value < 0.05 AND total_crashes >= 3 AND bike_crashes >= 2) AS is_bike_hin
  FROM s_p)"""
SCREENED = ",".join((SNAPPED, STATS, BASELINE, SCREEN))


@query("snap_crashes", f"""WITH {SNAPPED}
SELECT crash_id, muni_id, segment_id, round(snap_distance, 3) AS snap_distance FROM s_snapped""")
def snap_crashes(spark, d):
    return N.snap_crashes(crashes(spark, d), roads(spark, d)).select(
        "crash_id", "muni_id", "segment_id", F.round("snap_distance", 3).alias("snap_distance"))


@query("snap_unassigned_only", f"""WITH {SNAPPED}
SELECT c.crash_id, CASE WHEN c.l_suppkey % 3 = 0 THEN -1 ELSE s.segment_id END AS segment_id,
  CASE WHEN c.l_suppkey % 3 = 0 THEN 9 ELSE round(s.snap_distance, 3) END AS snap_distance
FROM t_crash c JOIN s_snapped s USING (crash_id)""")
def snap_unassigned_only(spark, d):
    held = F.col("l_suppkey") % 3 == 0
    df = crashes(spark, d).withColumn("segment_id", F.when(held, F.lit(-1)).cast("long")).withColumn(
        "snap_distance", F.when(held, F.lit(9.0)))
    return N.snap_crashes(df, roads(spark, d), force=False).select(
        "crash_id", "segment_id", F.round("snap_distance", 3).alias("snap_distance"))


@query("nearest_segment", f"""WITH {SNAPPED}
SELECT crash_id, segment_id, round(snap_distance, 3) AS distance FROM s_snapped""")
def nearest_segment(spark, d):
    return N.nearest_segment(crashes(spark, d), roads(spark, d), 50).withColumn(
        "distance", F.round("distance", 3))


@query("point_line_distance", f"""SELECT crash_id, round({DISTANCE}, 3) AS distance FROM t_crash JOIN t_road ON segment_id = l_partkey + 1""")
def point_line_distance(spark, d):
    own = crashes(spark, d).withColumn("segment_id", F.col("l_partkey") + 1).join(roads(spark, d).select("segment_id", "pts"), "segment_id")
    return own.select("crash_id", F.round(S.point_line_distance_m(F.col("lon"), F.col("lat"), F.col("pts")), 3).alias("distance"))


@query("within_distance", f"""WITH {SNAPPED}
SELECT crash_id FROM s_best""")
def within_distance(spark, d):
    return N.crashes_within(crashes(spark, d), roads(spark, d), 50)


@query("segment_stats", f"WITH {SNAPPED},{STATS} SELECT * FROM s_stats")
def segment_stats(spark, d):
    return G.segment_stats(roads(spark, d), N.snap_crashes(crashes(spark, d), roads(spark, d)), Y1, Y2)


@query("leave_one_out_baseline", f"""WITH {SNAPPED},{STATS},{BASELINE}
SELECT segment_id, total_crashes, round(baseline_rate + 1e-10, 8) AS baseline_rate FROM s_base""")
def leave_one_out_baseline(spark, d):
    return G.leave_one_out_baseline(segment_stats(spark, d), Y2 - Y1 + 1).select(
        "segment_id", "total_crashes", F.round(F.col("baseline_rate") + 1e-10, 8).alias("baseline_rate"))


SCREEN_COLUMNS = """muni_id, segment_id, total_crashes, severity_score, round(crash_rate + 1e-10, 8) AS crash_rate,
  round(expected_crashes + 1e-10, 8) AS expected_crashes, round(p_value, 8) AS p_value,
  is_significant, is_general_hin, is_ped_hin, is_bike_hin"""


def screened(spark, d):
    return P.screen_segments(crashes(spark, d), roads(spark, d), Y1, Y2)


@query("poisson_screen", f"WITH {SCREENED} SELECT {SCREEN_COLUMNS} FROM s_screen")
def poisson_screen(spark, d):
    return screened(spark, d).selectExpr(*_split(SCREEN_COLUMNS))


def _split(columns: str) -> list[str]:
    """Split a select list at its top-level commas."""
    out, depth, part = [], 0, ""
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(part)
            part = ""
        else:
            part += ch
    return [p.strip() for p in out + [part]]


@query("top_segments", f"""WITH {SCREENED}
SELECT {SCREEN_COLUMNS} FROM s_screen WHERE is_significant ORDER BY s_screen.crash_rate DESC, segment_id LIMIT 10""")
def top_segments(spark, d):
    best = screened(spark, d).filter("is_significant").orderBy(F.desc("crash_rate"), "segment_id").limit(10)
    return best.selectExpr(*_split(SCREEN_COLUMNS))


@query("ordered_segments", f"WITH {SNAPPED},{STATS} SELECT * FROM s_stats ORDER BY segment_id")
def ordered_segments(spark, d):
    return G.ordered_segments(segment_stats(spark, d))


# --- corridors -------------------------------------------------------------------
# Stored results are the input here, so that the graph is dense enough to matter.
NODES = """
k_nodes AS (
  SELECT DISTINCT r.muni_id AS scope, r.segment_id,
    COALESCE('sri:' || NULLIF(upper(trim(r.sri)), ''), 'name:' || NULLIF(upper(trim(r.road_name)), ''),
             'segment:' || r.segment_id) AS road_key,
    array_to_string(list_transform(regexp_extract_all(lower(COALESCE(NULLIF(trim(r.road_name), ''),
      NULLIF(trim(r.sri), ''), 'Unnamed')), '([a-z0-9]+|[^a-z0-9]+)'), lambda w: upper(w[1]) || w[2:]), '') AS corridor_name,
    x1, x2, y
  FROM t_result h JOIN t_road r USING (segment_id) WHERE is_significant)"""
_GAP = "sqrt(pow(({a} - {b}) * 111412.84 * cos(radians(l.y)), 2) + pow((l.y - r.y) * 111132.9, 2)) <= 1"
EDGES = f"""
k_edges AS (
  SELECT l.scope, l.segment_id AS source, r.segment_id AS target
  FROM k_nodes l JOIN k_nodes r ON l.scope = r.scope AND l.road_key = r.road_key AND l.segment_id < r.segment_id
  WHERE {" OR ".join(_GAP.format(a=a, b=b) for a in ("l.x1", "l.x2") for b in ("r.x1", "r.x2"))})"""
GROUPED = """
k_both AS (SELECT scope, source, target FROM k_edges UNION ALL SELECT scope, target, source FROM k_edges),
k_reach AS (SELECT scope, segment_id AS root, segment_id FROM k_nodes
  UNION SELECT k.scope, k.root, b.target FROM k_reach k JOIN k_both b ON b.source = k.segment_id AND b.scope = k.scope),
k_comp AS (SELECT scope, segment_id, min(root) AS root FROM k_reach GROUP BY scope, segment_id),
k_named AS (SELECT c.scope, c.segment_id, c.root,
    dense_rank() OVER (PARTITION BY c.scope ORDER BY c.root) AS corridor_id,
    min(n.corridor_name) OVER (PARTITION BY c.scope, c.root) AS corridor_name
  FROM k_comp c JOIN k_nodes n ON n.scope = c.scope AND n.segment_id = c.segment_id)"""


def stored(spark, d):
    return view(spark, d, "t_result").select("hin_id", "segment_id", "is_significant").join(
        view(spark, d, "t_road").select("muni_id", "segment_id"), "segment_id")


@query("corridor_nodes", f"WITH {NODES} SELECT scope, segment_id, road_key, corridor_name FROM k_nodes")
def corridor_nodes(spark, d):
    return C.corridor_nodes(stored(spark, d), roads(spark, d)).select("scope", "segment_id", "road_key", "corridor_name")


@query("start_end_points", """SELECT segment_id, round(x1, 9) AS sx, round(y, 9) AS sy, round(x2, 9) AS ex, round(y, 9) AS ey FROM t_road""")
def start_end_points(spark, d):
    a, b = S.start_point(F.col("pts")), S.end_point(F.col("pts"))
    return roads(spark, d).select("segment_id", *[F.round(p[c], 9).alias(n) for p, c, n in (
        (a, "x", "sx"), (a, "y", "sy"), (b, "x", "ex"), (b, "y", "ey"))])


@query("endpoint_adjacency", f"WITH {NODES},{EDGES} SELECT * FROM k_edges")
def endpoint_adjacency(spark, d):
    return C.endpoint_adjacency(C.corridor_nodes(stored(spark, d), roads(spark, d)))


@query("directed_edges", f"""WITH {NODES},{EDGES}
SELECT scope, source, target FROM k_edges UNION ALL SELECT scope, target AS source, source AS target FROM k_edges""")
def directed_edges(spark, d):
    return C.directed_edges(endpoint_adjacency(spark, d))


@query("reach_distinct", f"WITH RECURSIVE {NODES},{EDGES},{GROUPED} SELECT scope, segment_id, root FROM k_comp")
def reach_distinct(spark, d):
    return C.segment_components(C.corridor_nodes(stored(spark, d), roads(spark, d)))


@query("corridor_numbers", f"WITH RECURSIVE {NODES},{EDGES},{GROUPED} SELECT DISTINCT scope, root, corridor_id FROM k_named")
def corridor_numbers(spark, d):
    from hazardgrid.operators.ranking import dense_rank
    return dense_rank(reach_distinct(spark, d), ["scope"], "root", "corridor_id")


@query("group_corridors", f"""WITH RECURSIVE {NODES},{EDGES},{GROUPED}
SELECT h.hin_id, h.segment_id, h.is_significant, CASE WHEN h.is_significant THEN k.corridor_id END AS corridor_id,
  CASE WHEN h.is_significant THEN k.corridor_name END AS corridor_name
FROM t_result h LEFT JOIN k_named k ON k.segment_id = h.segment_id""")
def group_corridors(spark, d):
    return C.group_corridors(stored(spark, d), roads(spark, d)).select(
        "hin_id", "segment_id", "is_significant", "corridor_id", "corridor_name")


# --- overlay ---------------------------------------------------------------------
TRACT = """
e_first AS (
  SELECT segment_id, tract_id, svi_percentile FROM (
    SELECT r.segment_id, t.tract_id, t.svi_percentile,
      row_number() OVER (PARTITION BY r.segment_id ORDER BY t.tract_id) AS rn
    FROM t_road r JOIN t_tract t ON r.y BETWEEN t.ty0 AND t.ty1 AND r.x2 >= t.tx0 AND r.x1 <= t.tx1) WHERE rn = 1)"""


@query("first_intersecting_tract", f"""WITH {TRACT}
SELECT r.segment_id, e.tract_id, e.svi_percentile FROM t_road r LEFT JOIN e_first e USING (segment_id)""")
def first_intersecting_tract(spark, d):
    return E.first_intersecting_tract(roads(spark, d), tracts(spark, d)).select("segment_id", "tract_id", "svi_percentile")


@query("equity_overlay", f"""WITH {TRACT}
SELECT h.hin_id, e.svi_percentile AS avg_svi_score, e.svi_percentile > 75 AS in_vulnerable_tract
FROM t_result h LEFT JOIN e_first e USING (segment_id)""")
def equity_overlay(spark, d):
    return E.equity_overlay(view(spark, d, "t_result").select("hin_id", "segment_id"), roads(spark, d), tracts(spark, d)).select(
        "hin_id", "avg_svi_score", "in_vulnerable_tract")


@query("line_intersects_tract", """SELECT r.segment_id, t.tract_id FROM t_road r
JOIN t_tract t ON r.y BETWEEN t.ty0 AND t.ty1 AND r.x2 >= t.tx0 AND r.x1 <= t.tx1""")
def line_intersects_tract(spark, d):
    from hazardgrid.operators.boundaries import lines_meeting_polygons
    return lines_meeting_polygons(roads(spark, d), tracts(spark, d).select("tract_id", "rings")).distinct()


ANALYSED = SCREENED + """,
k_nodes AS (
  SELECT s.muni_id AS scope, s.segment_id,
    COALESCE('sri:' || NULLIF(upper(trim(r.sri)), ''), 'name:' || NULLIF(upper(trim(r.road_name)), ''),
             'segment:' || r.segment_id) AS road_key, r.road_name AS corridor_name, x1, x2, y
  FROM s_screen s JOIN t_road r USING (segment_id) WHERE is_significant),""" + EDGES + "," + GROUPED + "," + TRACT


def analysis(spark, d):
    return P.run_analysis(crashes(spark, d), roads(spark, d), view(spark, d, "t_muni"), tracts(spark, d), Y1, Y2)


@query("run_analysis", f"""WITH RECURSIVE {ANALYSED}
SELECT s.segment_id, s.total_crashes, round(s.p_value, 8) AS p_value, s.is_significant, s.is_ped_hin, s.is_bike_hin,
  k.corridor_id, k.corridor_name, e.svi_percentile AS avg_svi_score, e.svi_percentile > 75 AS in_vulnerable_tract
FROM s_screen s LEFT JOIN k_named k ON k.segment_id = s.segment_id LEFT JOIN e_first e ON e.segment_id = s.segment_id""")
def run_analysis(spark, d):
    return analysis(spark, d).results.select(
        "segment_id", "total_crashes", F.round("p_value", 8).alias("p_value"), "is_significant", "is_ped_hin",
        "is_bike_hin", "corridor_id", "corridor_name", "avg_svi_score", "in_vulnerable_tract")


@query("run_analysis_summary", f"""WITH {SCREENED},
a_tot AS (SELECT muni_id, count(*) AS n, CASE WHEN count(total_killed) = count(*) THEN sum(total_killed) END AS k
          FROM t_crash WHERE {PERIOD} GROUP BY muni_id),
a_net AS (SELECT muni_id, count(*) AS c, sum(length_miles) AS m FROM s_screen WHERE is_significant GROUP BY muni_id)
SELECT muni_id, COALESCE(n, 0) AS total_crashes, CAST(k AS BIGINT) AS total_fatalities,
  COALESCE(c, 0) AS hin_segment_count, round(COALESCE(m, 0), 6) AS hin_miles
FROM t_muni LEFT JOIN a_tot USING (muni_id) LEFT JOIN a_net USING (muni_id)""")
def run_analysis_summary(spark, d):
    return analysis(spark, d).summary.select(
        "muni_id", "total_crashes", "total_fatalities", "hin_segment_count", F.round("hin_miles", 6).alias("hin_miles"))
