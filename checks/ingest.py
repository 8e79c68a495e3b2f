"""Normalisation, validation, matching, location, reconciliation and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.reports import muni_polygons, munis
from checks.screening import crashes, roads, tracts
from checks.views import view
from hazardgrid import fixed_values as V
from hazardgrid.functions import numbers as N
from hazardgrid.functions import spatial as S
from hazardgrid.functions import text as T
from hazardgrid.operators import boundaries as B
from hazardgrid.operators import equity as E
from hazardgrid.operators import loads as L
from hazardgrid.operators import locating as K
from hazardgrid.operators import overlay as O
from hazardgrid.operators import reconcile as R
from hazardgrid.operators import upserts as U
from hazardgrid.operators import validation as C
from hazardgrid.operators import validity as P
from hazardgrid.plans import dashboard as J
from hazardgrid.session import new_folder, stage
from hazardgrid.sources import archives as A


def archive(spark, d):
    return view(spark, d, "t_archive")


# --- scalar normalisation: SQL blocks -------------------------------------------------
_COUNTY = "CASE regexp_replace(upper({c}), '[^A-Z]', '', 'g') WHEN 'CAPEMAY' THEN 'Cape May' WHEN 'MERCER' THEN 'Mercer' WHEN 'ESSEX' THEN 'Essex' WHEN 'CAMDEN' THEN 'Camden' END"
_WORDS = "trim(regexp_replace(upper({c}), '[^A-Z0-9]+', ' ', 'g'))"
_SUFFIX = f"regexp_replace(regexp_replace({_WORDS}, '(^| )TWP$', '\\1TOWNSHIP'), '(^| )BORO$', '\\1BOROUGH')"
_NAME = f"CASE {_SUFFIX} WHEN 'ORANGE CITY' THEN 'CITY OF ORANGE TOWNSHIP' WHEN 'LOWER ALLOWAYS CRK TOWNSHIP' THEN 'LOWER ALLOWAYS CREEK TOWNSHIP' ELSE {_SUFFIX} END"


def county_sql(c):
    return _COUNTY.format(c=c)


def name_sql(c):
    return _NAME.format(c=c)


def ext_sql(county, year, ident):
    raw = f"'NJDOT:' || {year} || ':' || replace(upper({county}), ' ', '_') || ':' || {ident}"
    return (f"CASE WHEN length({raw}) <= 50 THEN {raw} ELSE 'NJDOT:' || {year} || ':' || "
            f"substr(replace(upper({county}), ' ', '_'), 1, 8) || ':' || substr(sha256({raw}), 1, 20) END")


@query("normalize_county", f"SELECT line, {county_sql('county_name')} AS county FROM t_archive")
def normalize_county(spark, d):
    return archive(spark, d).select("line", T.normalize_county(F.col("county_name")).alias("county"))


@query("normalize_municipality", f"SELECT line, {name_sql('municipality_name')} AS name FROM t_archive")
def normalize_municipality(spark, d):
    return archive(spark, d).select("line", T.normalize_municipality(F.col("municipality_name")).alias("name"))


@query("build_external_id", f"""SELECT line, {ext_sql(county_sql('county_name'), "'2022'", "trim(id)")} AS external_id
FROM t_archive WHERE {county_sql('county_name')} IS NOT NULL""")
def build_external_id(spark, d):
    county = T.normalize_county(F.col("county_name"))
    return archive(spark, d).filter(county.isNotNull()).select(
        "line", T.build_external_id(county, F.lit(2022), F.col("id")).alias("external_id"))


_INT = "CASE WHEN regexp_full_match(trim({c}), '[0-9]+') THEN CAST(trim({c}) AS INT) END"
_BAD = "(trim({c}) <> '' AND NOT regexp_full_match(trim({c}), '[0-9]+'))"


@query("optional_nonneg_int", f"SELECT line, {_INT.format(c='total_killed')} AS killed, {_BAD.format(c='total_killed')} AS bad, {_BAD.format(c='total_injured')} AS bad_injured FROM t_archive")
def optional_nonneg_int(spark, d):
    value, bad = N.optional_nonneg_int(F.col("total_killed"))
    return archive(spark, d).select("line", value.alias("killed"), bad.alias("bad"),
                                    N.optional_nonneg_int(F.col("total_injured"))[1].alias("bad_injured"))


_LAT, _LON = "TRY_CAST(latitude AS DOUBLE)", "-abs(TRY_CAST(longitude AS DOUBLE))"
_ISSUE = f"""CASE WHEN latitude = '' AND longitude = '' THEN 'reported_missing' WHEN latitude = '' OR longitude = '' THEN 'reported_incomplete'
 WHEN {_LAT} IS NULL OR {_LON} IS NULL THEN 'reported_non_numeric'
 WHEN NOT ({_LON} BETWEEN -75.6 AND -73.9 AND {_LAT} BETWEEN 38.9 AND 41.4) THEN 'reported_out_of_bounds' END"""


@query("reported_point", f"""SELECT line, issue, CASE WHEN issue IS NULL THEN {_LON} END AS lon, CASE WHEN issue IS NULL THEN {_LAT} END AS lat
FROM (SELECT *, {_ISSUE} AS issue FROM t_archive) t""")
def reported_point(spark, d):
    return archive(spark, d).select("line", N.reported_point(F.col("latitude"), F.col("longitude")).alias("p")).select(
        "line", "p.issue", "p.lon", "p.lat")


@query("map_severity_fip", "SELECT line, CASE upper(trim(severity)) WHEN 'F' THEN 'fatal' WHEN 'I' THEN 'injury_unknown' WHEN 'P' THEN 'property_damage' END AS severity FROM t_archive")
def map_severity_fip(spark, d):
    return archive(spark, d).select("line", T.map_severity_fip(F.col("severity")).alias("severity"))


_DATE = "CASE WHEN regexp_full_match(crash_date, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}') THEN CAST(try_strptime(crash_date, '%m/%d/%Y') AS DATE) END"
_REASON = f"""CASE WHEN {county_sql('county_name')} IS NULL THEN 'unknown county: ' || county_name WHEN {county_sql('county_name')} <> 'Mercer' THEN 'county'
 WHEN trim(id) = '' THEN 'source_id' WHEN {_DATE} IS NULL THEN 'date' WHEN year({_DATE}) <> 2022 THEN 'year'
 WHEN upper(trim(severity)) NOT IN ('F', 'I', 'P') THEN 'severity' WHEN {_WORDS.format(c='municipality_name')} = '' THEN 'municipality_name'
 WHEN {_BAD.format(c='total_killed')} THEN 'total_killed' WHEN {_BAD.format(c='total_injured')} THEN 'total_injured'
 WHEN {_BAD.format(c='pedestrians_killed')} THEN 'pedestrians_killed' WHEN {_BAD.format(c='pedestrians_injured')} THEN 'pedestrians_injured' END"""
PREPARED = f"""
a_tag AS (SELECT *, {_REASON} AS reason FROM t_archive),
a_good AS (SELECT archive, line, {ext_sql("'Mercer'", "'2022'", "trim(id)")} AS external_id, 'Mercer' AS county, {name_sql('municipality_name')} AS municipality_name,
  {_DATE} AS crash_date, NULLIF(crash_time, '') AS crash_time,
  CASE upper(trim(severity)) WHEN 'F' THEN 'fatal' WHEN 'I' THEN 'injury_unknown' ELSE 'property_damage' END AS severity,
  COALESCE({_INT.format(c='pedestrians_killed')} > 0, FALSE) OR COALESCE({_INT.format(c='pedestrians_injured')} > 0, FALSE) AS ped_involved,
  {", ".join(f"{_INT.format(c=c)} AS {c}" for c in V.CASUALTY_COLUMNS)},
  COALESCE(NULLIF(trim(crash_location), ''), trim(route)) AS road_name, NULLIF(upper(trim(sri_std_rte_identifier)), '') AS sri,
  TRY_CAST(milepost AS DOUBLE) AS milepost, {_ISSUE} AS issue, {_LON} AS lon, {_LAT} AS lat
  FROM a_tag WHERE reason IS NULL)"""


def prepared(spark, d):
    return C.prepare_crash(archive(spark, d), "MERCER", 2022)


_PREPARED_OUT = ["line", "external_id", "county", "municipality_name", "crash_date", "crash_time", "severity", "ped_involved",
                 *V.CASUALTY_COLUMNS, "road_name", "sri", "milepost"]


@query("prepare_crash", f"WITH {PREPARED} SELECT {', '.join(_PREPARED_OUT)}, issue FROM a_good")
def prepare_crash(spark, d):
    return prepared(spark, d)[0].select(*_PREPARED_OUT, F.col("reported.issue").alias("issue"))


@query("prepare_crash_rejects", f"WITH {PREPARED} SELECT archive, reason, count(*) AS records FROM a_tag WHERE reason IS NOT NULL GROUP BY 1, 2")
def prepare_crash_rejects(spark, d):
    return prepared(spark, d)[1].groupBy("archive", "reason").agg(F.count("*").alias("records"))


@query("rejection_counts", f"""WITH {PREPARED} SELECT archive, 'rejection' AS kind, reason AS value, count(*) AS records FROM a_tag WHERE reason IS NOT NULL GROUP BY 1, 2, 3
UNION ALL SELECT archive, 'coordinate_issue', issue, count(*) FROM (SELECT archive, {_ISSUE} AS issue FROM t_archive) i WHERE issue IS NOT NULL GROUP BY 1, 2, 3""")
def rejection_counts(spark, d):
    tagged = C.tag_crash(archive(spark, d), "Mercer", 2022).withColumn("coordinate_issue", F.col("reported.issue"))
    return L.rejection_counts(tagged)


def _archives(spark, d):
    tagged = C.tag_crash(archive(spark, d), "Mercer", 2022).withColumn(
        "status", F.when(F.col("reason").isNull(), "loaded").otherwise("rejected"))
    return L.archive_totals(tagged)


@query("archive_totals", f"WITH {PREPARED} SELECT archive, count(*) AS records, count(*) - count(reason) AS loaded, 0 AS updated, 0 AS duplicate, count(reason) AS rejected FROM a_tag GROUP BY archive")
def archive_totals(spark, d):
    return _archives(spark, d)


@query("manifest_totals", f"""WITH {PREPARED}, per AS (SELECT archive, count(*) AS records, count(*) - count(reason) AS loaded, count(reason) AS rejected,
  CASE WHEN archive = 'file3' THEN 'failed' WHEN archive = 'file2' THEN 'pending' ELSE 'succeeded' END AS status FROM a_tag GROUP BY archive),
 picked AS (SELECT run, p.* FROM per p, (VALUES ('all'), ('sound'), ('open'), ('none')) r(run)
   WHERE run = 'all' OR (run = 'sound' AND status = 'succeeded') OR (run = 'open' AND status <> 'failed'))
SELECT run, count(status) AS archives, CAST(coalesce(sum(records), 0) AS BIGINT) AS records, CAST(coalesce(sum(loaded), 0) AS BIGINT) AS loaded, CAST(0 AS BIGINT) AS updated,
 CAST(0 AS BIGINT) AS duplicates, CAST(coalesce(sum(rejected), 0) AS BIGINT) AS rejected, coalesce(count(CASE WHEN status = 'succeeded' THEN 1 END), 0) AS succeeded,
 CASE WHEN coalesce(bool_or(status = 'failed'), FALSE) THEN 'failed' WHEN coalesce(bool_and(status = 'succeeded'), FALSE) THEN 'succeeded' ELSE 'running' END AS status
FROM (VALUES ('all'), ('sound'), ('open'), ('none')) r(run) LEFT JOIN picked USING (run) GROUP BY run""")
def manifest_totals(spark, d):
    state = F.when(F.col("archive") == "file3", "failed").when(F.col("archive") == "file2", "pending").otherwise("succeeded")
    archives = stage(_archives(spark, d).withColumn("status", state), "checks-archives")
    out = None
    for run, picked in (("all", "true"), ("sound", "status = 'succeeded'"), ("open", "status <> 'failed'"), ("none", "false")):
        one = L.manifest_totals(archives.filter(picked)).withColumn("run", F.lit(run))
        out = one if out is None else out.unionByName(one)
    done = F.filter("status_counts", lambda s: s["status"] == "succeeded")
    return out.withColumn("succeeded", F.coalesce(F.get(done, F.lit(0))["n"], F.lit(0)).cast("bigint")).drop("status_counts")


@query("merged_reasons", f"WITH {PREPARED} SELECT 'rejection' AS kind, reason AS value, count(*) AS records FROM a_tag WHERE reason IS NOT NULL GROUP BY 2")
def merged_reasons(spark, d):
    return L.merged_reasons(rejection_counts(spark, d).filter("kind = 'rejection'"))


# --- municipality matching -------------------------------------------------------------
MATCHED = PREPARED + f""",
m_key AS (SELECT {county_sql('county')} AS county, {name_sql('name')} AS municipality_name, count(*) AS n, min(muni_id) AS muni_id FROM t_label GROUP BY 1, 2),
m_good AS (SELECT g.*, k.muni_id, k.n FROM a_good g LEFT JOIN m_key k USING (county, municipality_name))"""


def labels(spark, d):
    return view(spark, d, "t_label")


def matched(spark, d):
    return C.match_municipality(prepared(spark, d)[0], labels(spark, d))


@query("match_municipality", f"""WITH {MATCHED} SELECT line, CASE WHEN n = 1 THEN muni_id END AS muni_id,
 CASE WHEN n IS NULL THEN 'municipality_unmatched' WHEN n > 1 THEN 'municipality_ambiguous' END AS reason FROM m_good""")
def match_municipality(spark, d):
    good, bad = matched(spark, d)
    return good.select("line", "muni_id", F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select("line", F.lit(None).cast("int").alias("muni_id"), "reason"))


@query("filter_municipality_name", f"""WITH {MATCHED} SELECT line, CASE WHEN municipality_name <> 'NATION 5' THEN 'municipality_filter' WHEN muni_id <> 99 THEN 'muni_id_mismatch' END AS reason
FROM m_good WHERE n = 1""")
def filter_municipality_name(spark, d):
    from hazardgrid.operators.filters import filter_municipality_name as keep
    kept, rejects = keep(matched(spark, d)[0], "nation  5", 99)
    return rejects.select("line", "reason").unionByName(kept.select("line", F.lit(None).cast("string").alias("reason")))


@query("municipality_keys", f"""SELECT {county_sql('county')} AS county, {name_sql('name')} AS municipality_name, muni_id, lpad(trim(muni_code), 4, '0') AS muni_code
FROM t_label WHERE regexp_full_match(trim(muni_code), '[0-9]{{1,4}}')""")
def municipality_keys(spark, d):
    return C.municipality_keys(labels(spark, d))


@query("dedupe_last_wins", f"WITH {PREPARED} SELECT municipality_name, line, external_id FROM a_good QUALIFY row_number() OVER (PARTITION BY municipality_name ORDER BY archive DESC, line DESC) = 1")
def dedupe_last_wins(spark, d):
    return C.dedupe_last_wins(prepared(spark, d)[0].drop("reported"), "municipality_name", ["archive", "line"]).select(
        "municipality_name", "line", "external_id")


# --- location -----------------------------------------------------------------------------
def located_input(spark, d):
    """Prepared rows with a municipality taken from their line, so that every box is used."""
    return prepared(spark, d)[0].withColumn("muni_id", (F.col("line") % 25).cast("int"))


def routes(spark, d):
    m = lambda x, v: F.struct(x.alias("x"), F.col("y").alias("y"), F.lit(float(v)).alias("m"))
    mid = (F.col("x_start") + F.col("x_end")) / 2
    return view(spark, d, "t_route").withColumn("pts", F.array(m(F.col("x_start"), 0), m(mid, 0.2), m(F.col("x_end"), 0.5)))


@query("point_covered_by_boundary", f"""WITH {PREPARED} SELECT line, COALESCE(issue IS NULL AND lon BETWEEN x0 AND x0 + 0.3 AND lat BETWEEN y0 AND y0 + 0.4, FALSE) AS covered
FROM a_good JOIN t_muni m ON m.muni_id = line % 25""")
def point_covered_by_boundary(spark, d):
    df = located_input(spark, d).withColumns({"lon": F.col("reported.lon"), "lat": F.col("reported.lat")})
    return B.point_covered(df, muni_polygons(spark, d)).select("line", "covered")


_AT = """CASE WHEN milepost <= 0.2 THEN x_start + (milepost / 0.2) * ((x_start + x_end) / 2 - x_start)
 ELSE (x_start + x_end) / 2 + ((milepost - 0.2) / (0.5 - 0.2)) * (x_end - (x_start + x_end) / 2) END"""
ROUTED = PREPARED + f""",
l_all AS (SELECT g.*, line % 25 AS muni_id, COALESCE(issue IS NULL AND lon BETWEEN x0 AND x0 + 0.3 AND lat BETWEEN y0 AND y0 + 0.4, FALSE) AS valid, x0, y0
  FROM a_good g JOIN t_muni m ON m.muni_id = g.line % 25),
l_hit AS (SELECT line, r.source_id, {_AT} AS route_lon, r.y AS route_lat FROM l_all l JOIN t_route r ON r.sri = l.sri AND milepost BETWEEN mp_start AND mp_end
  WHERE NOT valid AND {_AT} BETWEEN x0 AND x0 + 0.3 AND r.y BETWEEN y0 AND y0 + 0.4)"""


@query("locate_route_milepost", f"WITH {ROUTED} SELECT line, source_id, round(route_lon, 9) AS lon, round(route_lat, 9) AS lat FROM l_hit")
def locate_route_milepost(spark, d):
    flagged = B.point_covered(located_input(spark, d).withColumns({
        "_x": F.col("reported.lon"), "_y": F.col("reported.lat")}), muni_polygons(spark, d), "valid", "_x", "_y")
    hits = K.locate_route_milepost(flagged.filter(~F.col("valid")), routes(spark, d), muni_polygons(spark, d), ["line"])
    return hits.distinct().select("line", "source_id", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


@query("resolve_location", f"""WITH {ROUTED} SELECT l.line, CASE WHEN valid THEN 'reported' WHEN route_lon IS NOT NULL THEN 'route_milepost' END AS geocode_quality,
 CASE WHEN valid OR route_lon IS NOT NULL THEN NULL WHEN sri IS NULL OR milepost IS NULL THEN 'route_reference_missing' ELSE 'route_measure_unresolved' END AS location_reason,
 COALESCE(issue, CASE WHEN NOT valid THEN 'reported_outside_municipality' END) AS coordinate_issue,
 round(CASE WHEN valid THEN lon ELSE route_lon END, 9) AS lon, round(CASE WHEN valid THEN lat ELSE route_lat END, 9) AS lat
FROM l_all l LEFT JOIN l_hit h USING (line)""")
def resolve_location(spark, d):
    return K.resolve_location(located_input(spark, d), routes(spark, d), muni_polygons(spark, d), ["line"]).select(
        "line", "geocode_quality", "location_reason", "coordinate_issue", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


_CAND = """SELECT o_orderkey, CAST(o_orderkey AS STRING) AS source_id, CAST(o_custkey % 50 AS BIGINT) AS k,
 CAST(-75 AS DOUBLE) + CASE WHEN o_custkey % 50 < 25 THEN CAST(0.00000005 AS DOUBLE) * (o_orderkey % 2) ELSE CAST(0.001 AS DOUBLE) * (o_orderkey % 3) END AS lon,
 CAST(40 AS DOUBLE) AS lat FROM orders"""


@query("collapse_route_points", f"""SELECT k, CASE WHEN k < 25 THEN round(first(lon ORDER BY source_id), 9) END AS route_lon,
 CASE WHEN k >= 25 THEN 'route_ambiguous' END AS route_reason FROM ({_CAND}) c GROUP BY k""")
def collapse_route_points(spark, d):
    return K.collapse_route_points(view(spark, d, "orders", _CAND), ["k"]).select(
        "k", F.round("route_lon", 9).alias("route_lon"), "route_reason")


@query("locate_along_measure", f"""SELECT source_id, k, round({_AT.replace('milepost', '(k / 20)')}, 9) AS lon FROM t_route, range(0, 11) t(k)""")
def locate_along_measure(spark, d):
    df = routes(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long"))))
    return df.select("source_id", "k", F.explode(S.locate_along_measure(F.col("pts"), F.col("k") / 20)).alias("p")).select(
        "source_id", "k", F.round("p.x", 9).alias("lon"))


@query("vertex_edges", """SELECT source_id, 0 AS pos, round(x_start, 9) AS ax, round((x_start + x_end) / 2, 9) AS bx FROM t_route
UNION ALL SELECT source_id, 1, round((x_start + x_end) / 2, 9), round(x_end, 9) FROM t_route""")
def vertex_edges(spark, d):
    return routes(spark, d).select("source_id", F.posexplode(S.edges(F.col("pts"))).alias("pos", "e")).select(
        "source_id", "pos", F.round("e.a.x", 9).alias("ax"), F.round("e.b.x", 9).alias("bx"))


@query("line_length", """SELECT segment_id, round((x2 - x1) * radians(6378137.0) * cos(radians(y)) / sqrt(1 - 0.0066943799901413165 * sin(radians(y)) * sin(radians(y))) / 1609.344, 8) AS miles FROM t_road""")
def line_length(spark, d):
    return roads(spark, d).select("segment_id", F.round(S.line_length_miles(F.col("pts")), 8).alias("miles"))


@query("assign_boundary_within", """SELECT crash_id, m.muni_id FROM t_crash c LEFT JOIN t_muni m ON lon > x0 AND lon < x0 + 0.3 AND lat > y0 AND lat < y0 + 0.4""")
def assign_boundary_within(spark, d):
    return B.assign_boundary(crashes(spark, d), muni_polygons(spark, d)).select("crash_id", "muni_id")


@query("assign_boundary_intersects", """SELECT segment_id, m.muni_id FROM t_road r LEFT JOIN t_muni m ON x2 >= x0 AND x1 <= x0 + 0.3 AND y BETWEEN y0 AND y0 + 0.4""")
def assign_boundary_intersects(spark, d):
    return B.assign_boundary_intersects(roads(spark, d).select("segment_id", "pts"), muni_polygons(spark, d)).select("segment_id", "muni_id")


@query("tracts_touching_boundary", """SELECT muni_id, tract_id FROM t_muni m JOIN (SELECT tract_id, tx0, tx1, ty0, ty1 FROM t_tract) t
ON tx1 >= x0 - 1e-12 AND tx0 <= x0 + 0.3 + 1e-12 AND ty1 >= y0 AND ty0 <= y0 + 0.4""")
def tracts_touching_boundary(spark, d):
    # Outlines are widened by a hair: neighbouring boxes share an edge up to rounding.
    wide = munis(spark, d).withColumn("rings", S.box_rings(
        F.col("x0") - 1e-12, F.col("y0"), F.col("x0") + 0.3 + 1e-12, F.col("y0") + 0.4))
    return B.tracts_touching_boundary(tracts(spark, d), wide)


# --- roads: features, clipping, splitting, guards ------------------------------------------
def cross_paths(spark, d):
    """Measured routes stretched over the municipality's western border."""
    return view(spark, d, "t_route").withColumn("pts", S.line(
        (F.col("x_start") - 0.02 - F.col("rr") * 1e-5, F.col("y")), (F.col("x_end"), F.col("y")))).select("source_id", "pts")


def coded(spark, d):
    return muni_polygons(spark, d).withColumn("muni_code", F.lpad(F.col("muni_id").cast("string"), 4, "0"))


@query("clip_paths_to_boundaries", """SELECT r.source_id, m.muni_id, 0 AS part, round(greatest(x_start - 0.02 - rr * 1e-5, x0), 9) AS from_lon, round(least(x_end, x0 + 0.3), 9) AS to_lon
FROM t_route r JOIN t_muni m ON x_end > x0 AND x_start - 0.02 - rr * 1e-5 < x0 + 0.3 - 1e-9 AND y BETWEEN y0 AND y0 + 0.4""")
def clip_paths_to_boundaries(spark, d):
    parts = O.clip_paths(cross_paths(spark, d), coded(spark, d)).filter(S.line_length_m(F.col("pts")) > 0.001)
    return parts.select("source_id", "muni_id", "part", F.round(S.start_point(F.col("pts"))["x"], 9).alias("from_lon"),
                        F.round(S.end_point(F.col("pts"))["x"], 9).alias("to_lon"))


_BOUNDS = """SELECT c_custkey, CASE WHEN c_custkey % 31 = 0 THEN ' ' ELSE CONCAT(CAST(1000 + FLOOR(c_custkey / 2) AS STRING), ' ') END AS MUN_CODE,
 CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CONCAT('Place ', CAST(c_custkey AS STRING)) END AS MUN_LABEL, CONCAT('Name ', CAST(c_custkey AS STRING)) AS NAME, 'MERCER' AS COUNTY,
 'Township' AS MUN_TYPE, CASE WHEN c_custkey % 7 = 0 THEN 'LineString' ELSE 'Polygon' END AS geometry_type FROM customer"""


@query("normalize_boundary", f"""WITH b AS (SELECT *, trim(MUN_CODE) AS code, CASE WHEN trim(MUN_CODE) = '' THEN 'required_fields' WHEN geometry_type = 'LineString' THEN 'boundary_geometry' END AS wrong FROM ({_BOUNDS}) q),
 f AS (SELECT *, min(CASE WHEN wrong IS NULL THEN c_custkey END) OVER (PARTITION BY code) AS first FROM b)
SELECT CAST(c_custkey AS BIGINT) AS seq, coalesce(wrong, CASE WHEN c_custkey > first THEN 'duplicate_code' END) AS reason, coalesce(MUN_LABEL, NAME) AS name FROM f""")
def normalize_boundary(spark, d):
    box = F.array(S.line((F.lit(0), F.lit(0)), (F.lit(1), F.lit(0)), (F.lit(1), F.lit(1)), (F.lit(0), F.lit(0))))
    good, bad = C.normalize_boundary(view(spark, d, "customer", _BOUNDS).withColumns({"rings": box, "seq": F.col("c_custkey").cast("long")}))
    return good.select("seq", F.lit(None).cast("string").alias("reason"), "name").unionByName(bad.select("seq", "reason", "name"))


# Municipalities with a slanted west side, a concave east side and a triangular hole; paths across them, and across their neighbours' ends.
_SHAPED = """SELECT muni_id, x0, y0, CAST(FLOOR(muni_id / 5) AS INT) AS tier FROM t_muni"""
_ACROSS = """SELECT c_custkey, CONCAT('NJDOT:', CAST(c_custkey AS STRING), ':0') AS source_id, x0 - 0.05 AS xa, x0 + 0.35 AS xb, CAST(FLOOR(muni_id / 5) AS INT) AS tier,
 y0 + 0.4 * (CAST(c_custkey % 97 AS DOUBLE) + 0.5) / 97 AS y FROM customer JOIN t_muni ON muni_id = c_custkey % 25"""


def shaped(spark, d):
    x, y = F.col("x0"), F.col("y0")
    shell = S.line((x, y), (x + 0.3, y), (x + 0.27, y + 0.2), (x + 0.3, y + 0.4), (x + 0.1, y + 0.4), (x, y))
    hole = S.line((x + 0.15, y + 0.1), (x + 0.25, y + 0.1), (x + 0.2, y + 0.3), (x + 0.15, y + 0.1))
    return view(spark, d, "t_muni", _SHAPED).select("muni_id", F.lpad(F.col("muni_id").cast("string"), 4, "0").alias("muni_code"), F.array(shell, hole).alias("rings"))


def across(spark, d):
    y = F.col("y")
    return view(spark, d, "customer", _ACROSS).select("source_id", S.line((F.col("xa"), y), (F.col("xa") + 0.123, y), (F.col("xb"), y)).alias("pts"))


_STRETCHES = f"""p AS ({_ACROSS}), m AS ({_SHAPED}),
 met AS (SELECT p.source_id, muni_id, y, greatest(xa, x0 + 0.25 * (y - y0)) AS a, least(xb, x0 + 0.3 - 0.15 * least(y - y0, y0 + 0.4 - y)) AS b,
   CASE WHEN y - y0 BETWEEN 0.1 AND 0.3 THEN x0 + 0.15 + 0.25 * (y - y0 - 0.1) END AS l, CASE WHEN y - y0 BETWEEN 0.1 AND 0.3 THEN x0 + 0.25 - 0.25 * (y - y0 - 0.1) END AS r
   FROM p JOIN m ON m.tier = p.tier),
 cut AS (SELECT source_id, muni_id, y, unnest(CASE WHEN l IS NULL OR l >= b OR r <= a THEN [{{'a': a, 'b': b}}] ELSE [{{'a': a, 'b': l}}, {{'a': r, 'b': b}}] END) AS s FROM met WHERE a < b),
 parts AS (SELECT source_id, muni_id, y, s.a AS a, s.b AS b, count(*) OVER w AS n, row_number() OVER (w ORDER BY s.a) AS k FROM cut WHERE s.a < s.b WINDOW w AS (PARTITION BY source_id, muni_id))"""


@query("clip_shaped_boundaries", f"""WITH {_STRETCHES} SELECT source_id, muni_id, CAST(CASE WHEN n = 1 THEN 0 ELSE k END AS INT) AS part, round(a, 8) AS from_lon, round(b, 8) AS to_lon FROM parts""")
def clip_shaped_boundaries(spark, d):
    return O.clip_paths(across(spark, d), shaped(spark, d)).select(
        "source_id", "muni_id", "part", F.round(S.start_point(F.col("pts"))["x"], 8).alias("from_lon"), F.round(S.end_point(F.col("pts"))["x"], 8).alias("to_lon"))


def _plane_sql(lon, lat):
    """Easting and northing of a point, up to a shift, as SQL."""
    s, dl = f"sin(radians({lat}))", f"radians({lon} + 75.0)"
    t = f"sinh(atanh({s}) - {S._ECC!r} * atanh({S._ECC!r} * {s}))"
    xi, eta = f"atan2({t}, cos({dl}))", f"asinh(sin({dl}) / sqrt(({t}) * ({t}) + cos({dl}) * cos({dl})))"
    east = " + ".join([eta] + [f"{a!r} * cos({2 * k} * {xi}) * sinh({2 * k} * {eta})" for k, a in enumerate(S._TO_PLANE, 1)])
    north = " + ".join([xi] + [f"{a!r} * sin({2 * k} * {xi}) * cosh({2 * k} * {eta})" for k, a in enumerate(S._TO_PLANE, 1)])
    return f"{S._RECTIFYING!r} * ({east})", f"{S._RECTIFYING!r} * ({north})"


(_E0, _N0), (_E1, _N1) = _plane_sql("a", "y"), _plane_sql("b", "y")


@query("split_line_equal", f"""WITH {_STRETCHES}, straight AS (SELECT *, sqrt(pow({_E1} - ({_E0}), 2) + pow({_N1} - ({_N0}), 2)) AS len FROM parts
   WHERE NOT (a < x_mid AND x_mid < b)),
 counted AS (SELECT *, CAST(ceil(len / (0.5 * {V.METERS_PER_MILE!r})) AS INT) AS pieces FROM straight)
SELECT source_id || ':M' || lpad(CAST(muni_id AS VARCHAR), 4, '0') || ':P' || CASE WHEN n = 1 THEN 0 ELSE k END || ':S' || i AS source_id, muni_id, round(len / pieces, 3) AS meters
FROM counted, LATERAL (SELECT unnest(range(pieces)) AS i) u""".replace("SELECT source_id, muni_id, y, s.a AS a, s.b AS b,", "SELECT source_id, muni_id, y, xa + 0.123 AS x_mid, s.a AS a, s.b AS b,").replace(
    "SELECT source_id, muni_id, y, unnest(", "SELECT source_id, muni_id, y, xa, unnest(").replace("SELECT p.source_id, muni_id, y, greatest(", "SELECT p.source_id, muni_id, y, xa, greatest("))
def split_line_equal(spark, d):
    # Parts of two vertices; those with the bend between them are longer than a straight line and are left to tests.
    parts = O.clip_paths(across(spark, d), shaped(spark, d)).filter(F.size("pts") == 2)
    return O.split_line_equal(parts, 0.5).select("source_id", "muni_id", F.round(S.metric_length(F.col("pts")), 3).alias("meters"))


@query("paths_without_boundary", """SELECT source_id FROM t_route r WHERE rr % 3 = 0""")
def paths_without_boundary(spark, d):
    far = F.when(F.regexp_extract("source_id", r":(\d+):", 1).cast("long") % 100000 % 3 == 0, 30.0).otherwise(0.0)
    moved = cross_paths(spark, d).withColumn("pts", F.transform("pts", lambda p: S.point(p["x"] + far, p["y"])))
    return O.paths_without_boundary(moved, coded(spark, d)).select("source_id")


_FEATURE = """SELECT p_partkey, CASE WHEN p_partkey % 53 = 0 THEN '' ELSE CONCAT(' r', CAST(p_partkey % 40 AS STRING), CASE WHEN p_partkey % 59 = 0 THEN '_a_very_long_route_id' ELSE '' END) END AS sri,
 p_size % 9 AS f_system_code, CAST(p_partkey % 100 AS DOUBLE) / 100 - 75 AS x, CAST(p_size AS DOUBLE) / 100 + 40 AS y,
 CASE p_partkey % 6 WHEN 0 THEN 'nolength' WHEN 1 THEN 'reverse' WHEN 2 THEN 'nomeasure' WHEN 3 THEN 'range' ELSE 'good' END AS kind FROM part"""


def features(spark, d):
    kind, x, y = F.col("kind"), F.col("x"), F.col("y")
    m1 = F.when(kind == "reverse", F.lit(0.9)).otherwise(F.lit(0.1))
    last = F.when(kind == "nomeasure", F.array(x + 0.002, y)).otherwise(F.array(x + 0.002, y, F.lit(0.2)))
    bent = F.array(F.array(x, y, F.lit(0.0)), F.array(x + 0.001, y, m1), last)
    path = F.when(kind == "nolength", F.array(F.array(x, y, F.lit(0.0)), F.array(x, y, F.lit(0.1)))).when(
        kind == "range", F.array(F.array(x, y, F.lit(0.0)), F.array(x + 300, y, F.lit(0.1)))).otherwise(bent)
    return view(spark, d, "part", _FEATURE).withColumn("OBJECTID", F.col("p_partkey")).withColumn("paths", F.array(path, bent.alias("b")))


_CLASS = "CASE WHEN f_system_code BETWEEN 1 AND 4 THEN 'arterial' WHEN f_system_code IN (5, 6) THEN 'collector' WHEN f_system_code = 7 THEN 'local' ELSE 'unclassified' END"
_OK = f"(SELECT * FROM ({_FEATURE}) f WHERE sri <> '' AND length(trim(sri)) <= 20)"


@query("parse_road_feature", f"""SELECT 'NJDOT:' || p_partkey || ':0' AS source_id, upper(trim(sri)) AS sri, {_CLASS} AS road_class, 'functional_class_' || f_system_code AS road_type,
  CASE WHEN kind = 'good' THEN 0.2 END AS mp_end FROM {_OK} f WHERE kind NOT IN ('nolength', 'range')
UNION ALL SELECT 'NJDOT:' || p_partkey || ':1', upper(trim(sri)), {_CLASS}, 'functional_class_' || f_system_code, CASE WHEN kind NOT IN ('reverse', 'nomeasure') THEN 0.2 END FROM {_OK} f""")
def parse_road_feature(spark, d):
    paths, measured, _ = C.parse_road_feature(features(spark, d))
    return paths.select("source_id", "sri", "road_class", "road_type").join(measured.select("source_id", "mp_end"), "source_id", "left")


@query("parse_road_feature_rejects", f"""SELECT kind, reason, count(*) AS n FROM (
 SELECT 'feature' AS kind, CASE WHEN sri = '' THEN 'no_sri' ELSE 'sri_too_long' END AS reason FROM ({_FEATURE}) f WHERE sri = '' OR length(trim(sri)) > 20
 UNION ALL SELECT 'analysis', CASE WHEN kind = 'nolength' THEN 'no_length' ELSE 'invalid_xy' END FROM {_OK} f WHERE kind IN ('nolength', 'range')
 UNION ALL SELECT 'reference', 'invalid_measures' FROM {_OK} f, range(2) t WHERE kind IN ('reverse', 'nomeasure')) r GROUP BY 1, 2""")
def parse_road_feature_rejects(spark, d):
    return C.parse_road_feature(features(spark, d))[2].groupBy("kind", "reason").agg(F.count("*").alias("n"))


@query("functional_road_class", f"SELECT p_partkey, {_CLASS} AS road_class, 'functional_class_' || f_system_code AS road_type FROM ({_FEATURE}) f")
def functional_road_class(spark, d):
    return view(spark, d, "part", _FEATURE).select("p_partkey", T.functional_road_class(F.col("f_system_code")).alias("c")).select("p_partkey", "c.*")


def stored_segments(spark, d):
    return roads(spark, d).withColumn("source_id", F.concat(
        F.lit("NJDOT:"), (F.col("muni_id") * 100000 + F.floor((F.col("segment_id") - 1) / 100)).cast("string"), F.lit(":0:M1:P0:S"), F.col("segment_id").cast("string")))


@query("snapshot_omissions", """SELECT 'route' AS kind, source_id FROM t_route WHERE rr % 4 = 1
UNION ALL SELECT 'segment', 'NJDOT:' || (muni_id * 100000 + CAST(floor((segment_id - 1) / 100) AS BIGINT)) || ':0:M1:P0:S' || segment_id FROM t_road
WHERE CAST(floor((segment_id - 1) / 100) AS BIGINT) % 4 = 1""")
def snapshot_omissions(spark, d):
    r = view(spark, d, "t_route")
    return U.snapshot_omissions(r, stored_segments(spark, d), r.filter("rr % 4 <> 1"))


@query("incompatible_changes", """SELECT segment_id, CASE WHEN segment_id % 10 = 1 THEN 'attributes' WHEN segment_id % 10 = 2 THEN 'length' ELSE 'geometry' END AS problem
FROM t_road WHERE segment_id % 10 IN (1, 2, 3)""")
def incompatible_changes(spark, d):
    old = stored_segments(spark, d)
    k = F.col("segment_id") % 10
    new = old.withColumn("road_name", F.when(k == 1, F.lit(None)).otherwise(F.col("road_name"))).withColumn(
        "length_miles", F.col("length_miles") + F.when(k == 2, 1e-9).when(k == 4, 1e-11).otherwise(0.0)).withColumn(
        "pts", F.when(k == 3, F.reverse("pts")).otherwise(F.col("pts")))
    return U.incompatible_changes(old, new, ["sri", "road_name", "road_class", "muni_id"]).select(
        F.substring_index("source_id", ":S", -1).cast("long").alias("segment_id"), "problem")


@query("stale_segments", """SELECT segment_id FROM t_road WHERE CAST(floor((segment_id - 1) / 100) AS BIGINT) % 2 = 0 AND segment_id % 3 = 0""")
def stale_segments(spark, d):
    old = stored_segments(spark, d)
    paths = old.select(U.path_prefix(F.col("source_id")).alias("source_id")).distinct().filter(
        F.regexp_extract("source_id", r":(\d+):", 1).cast("long") % 100000 % 2 == 0)
    return U.stale_segments(old, paths, old.filter("segment_id % 3 <> 0")).select(
        F.substring_index("source_id", ":S", -1).cast("long").alias("segment_id"))


# --- dashboard ---------------------------------------------------------------------------------
def raw_dash(spark, d):
    return view(spark, d, "t_dash").withColumnsRenamed({
        "county": "County", "municipality": "Municipality", "year": "Year", "crash_at": "Date & Time of Crash",
        "rating": "Highest Injury Severity Rating", "summary": "NJDOT Summary", "crash_type": "Crash Type",
        "geopoint": "Geopoint", "geopoint_calculated": "Geopoint (Calculated)", "weather": "Weather Condition"})


_CODE = "COALESCE(NULLIF(regexp_extract(rating, '\\(([KABCO])\\)$', 1), ''), CASE WHEN rating IN ('K', 'A', 'B', 'C', 'O') THEN rating END)"
_CNT = "CASE WHEN regexp_full_match({c}, '[0-9]+') THEN CAST({c} AS INT) END"
_LABELS = "CASE WHEN summary = '' THEN CAST([] AS VARCHAR[]) WHEN NOT starts_with(summary, '[') THEN [summary] WHEN summary = '[broken' THEN NULL ELSE CAST(from_json(summary, '[\"VARCHAR\"]') AS VARCHAR[]) END"
DASH = f"""
d_raw AS (SELECT *, {_CODE} AS code, {_LABELS} AS labels, {", ".join(f"{_CNT.format(c=c)} AS n_{c}" for c in V.DASHBOARD_COUNTS)},
  {county_sql('county')} AS cty, trim(CASE WHEN contains(municipality, ',') THEN split_part(municipality, ',', 1) ELSE municipality END) AS label,
  CASE WHEN contains(municipality, ',') THEN {county_sql("split_part(municipality, ',', 2)")} END AS label_cty,
  TRY_CAST(dateofcrash AS DATE) AS dt FROM t_dash),
d_ev AS (SELECT *, COALESCE(n_crashfatalitycount > 0, FALSE) OR upper(fatalcrashind) = 'Y' AS fatal_ev,
  COALESCE(n_injurycount > 0, FALSE) OR COALESCE(n_pedestrianinjurycount > 0, FALSE) OR COALESCE(list_contains(labels, 'Injury Crashes'), FALSE) AS injury_ev,
  COALESCE(n_fatalitycount > 0, FALSE) OR COALESCE(n_pedestrianfatalitycount > 0, FALSE) AS loose_ev FROM d_raw),
d_sev AS (SELECT *, CASE WHEN fatal_ev THEN 'fatal' WHEN code = 'O' AND (injury_ev OR loose_ev) THEN 'injury_unknown'
    WHEN code IS NOT NULL THEN CASE code WHEN 'K' THEN 'fatal' WHEN 'A' THEN 'serious_injury' WHEN 'B' THEN 'minor_injury' WHEN 'C' THEN 'possible_injury' ELSE 'property_damage' END
    WHEN injury_ev THEN 'injury_unknown' END AS severity,
  list_filter([CASE WHEN fatal_ev THEN CASE WHEN code IS DISTINCT FROM 'K' THEN 'rating_with_fatal_evidence' END WHEN code = 'O' AND injury_ev THEN 'rating_o_with_injury_evidence'
      WHEN code = 'O' AND loose_ev THEN 'rating_o_with_unqualified_fatality_count' WHEN code IS NULL AND injury_ev THEN 'missing_rating_with_injury_evidence' END,
    CASE WHEN n_pedestrianfatalitycount > n_fatalitycount THEN 'pedestrianfatalitycount_exceeds_total' END,
    CASE WHEN n_pedestrianinjurycount > n_injurycount THEN 'pedestrianinjurycount_exceeds_total' END,
    CASE WHEN code = 'K' AND n_fatalitycount = 0 THEN 'fatal_rating_with_zero_fatalities' END,
    CASE WHEN code IN ('A', 'B', 'C') AND n_injurycount = 0 THEN 'injury_rating_with_zero_injured' END], lambda c: c IS NOT NULL) AS conflicts,
  COALESCE(list_contains(labels, 'Pedestrian Involved'), FALSE) OR crash_type = 'Pedestrian' OR COALESCE(n_pedestrianinjurycount > 0, FALSE)
    OR COALESCE(n_pedestrianfatalitycount > 0, FALSE) AS ped, CASE WHEN list_contains(labels, 'Bicyclist Involved') THEN TRUE END AS bike FROM d_ev),
d_key AS (SELECT {county_sql('county')} AS cty, {name_sql('name')} AS nm, count(*) AS n, min(muni_id) AS muni_id, min(trim(muni_code)) AS muni_code FROM t_label
  WHERE regexp_full_match(trim(muni_code), '[0-9]{{1,4}}') GROUP BY 1, 2),
d_tag AS (SELECT s.*, k.muni_id, k.muni_code, CASE WHEN NOT regexp_full_match(id_cr, '[0-9]+') THEN 'invalid_dashboard_id' WHEN s.cty IS NULL THEN 'unknown county: ' || county
    WHEN label_cty <> s.cty THEN 'municipality_county_conflict' WHEN k.n IS NULL THEN 'municipality_unmatched' WHEN k.n > 1 THEN 'municipality_ambiguous'
    WHEN dt IS NULL THEN 'invalid_date' WHEN CAST(year(dt) AS VARCHAR) <> s.year THEN 'year_date_conflict' WHEN year(dt) NOT BETWEEN 2019 AND 2025 THEN 'outside_2019_2025'
    WHEN trim(casenumber) = '' THEN 'invalid_case_number' WHEN crash_at = 'soon' THEN 'invalid_datetime' WHEN crash_at <> '' AND CAST(substr(crash_at, 1, 10) AS DATE) <> dt THEN 'datetime_date_conflict'
    {" ".join(f"WHEN {c} <> '' AND n_{c} IS NULL THEN 'invalid_{c}'" for c in V.DASHBOARD_COUNTS)}
    WHEN labels IS NULL THEN 'invalid_summary' WHEN severity IS NULL THEN 'unrecognized_severity' END AS reason
  FROM d_sev s LEFT JOIN d_key k ON k.cty = s.cty AND k.nm = {name_sql('label')})"""
_DEXT = ext_sql("cty", "CAST(year(dt) AS VARCHAR)", "(year(dt) || lpad(muni_code, 4, '0') || trim(casenumber))")


def tagged_dash(spark, d):
    return C.tag_dashboard(raw_dash(spark, d), labels(spark, d))


@query("kabco_code", f"SELECT rating, {_CODE} AS code, count(*) AS n FROM t_dash GROUP BY 1, 2")
def kabco_code(spark, d):
    return view(spark, d, "t_dash").groupBy("rating", T.kabco_code(F.col("rating")).alias("code")).agg(F.count("*").alias("n"))


@query("summary_labels", f"SELECT summary, array_to_string({_LABELS}, '|') AS labels, count(*) AS n FROM t_dash GROUP BY 1, 2")
def summary_labels(spark, d):
    return view(spark, d, "t_dash").groupBy("summary", F.array_join(T.summary_labels(F.col("summary")), "|").alias("labels")).agg(F.count("*").alias("n"))


@query("json_point", """SELECT id_cr, geopoint, CASE WHEN lon BETWEEN -75.6 AND -73.9 AND lat BETWEEN 38.9 AND 41.4 THEN lon END AS lon,
 CASE WHEN lon BETWEEN -75.6 AND -73.9 AND lat BETWEEN 38.9 AND 41.4 THEN lat END AS lat, count(*) AS n
FROM (SELECT *, TRY_CAST(NULLIF(geopoint, '') ->> 'lon' AS DOUBLE) AS lon, TRY_CAST(NULLIF(geopoint, '') ->> 'lat' AS DOUBLE) AS lat FROM (SELECT id_cr, geopoint FROM t_dash) q) t GROUP BY 1, 2, 3, 4""")
def json_point(spark, d):
    p = N.json_point(F.col("geopoint"))
    return view(spark, d, "t_dash").groupBy("id_cr", "geopoint", p["lon"].alias("lon"), p["lat"].alias("lat")).agg(F.count("*").alias("n"))


@query("prepare_dashboard", f"""WITH {DASH} SELECT id_cr AS dashboard_id, {_DEXT} AS external_id, muni_id, CAST(dt AS VARCHAR) AS crash_date,
 CASE WHEN crash_at <> '' THEN '09:15' END AS crash_time, severity, ped AS ped_involved, bike AS bike_involved, n_fatalitycount AS total_killed, n_injurycount AS total_injured,
 n_pedestrianfatalitycount AS pedestrians_killed, n_pedestrianinjurycount AS pedestrians_injured, NULLIF(trim(streetname), '') AS road_name, array_to_string(conflicts, '|') AS conflicts
FROM d_tag WHERE reason IS NULL""")
def prepare_dashboard(spark, d):
    return C.split_rejects(tagged_dash(spark, d))[0].select(
        "dashboard_id", "external_id", "muni_id", F.col("crash_date").cast("string").alias("crash_date"), "crash_time", "severity",
        "ped_involved", "bike_involved", *V.CASUALTY_COLUMNS, "road_name", F.array_join("source_metadata.conflicts", "|").alias("conflicts"))


@query("prepare_dashboard_rejects", f"WITH {DASH} SELECT year AS source_year, reason, count(*) AS n FROM d_tag WHERE reason IS NOT NULL GROUP BY 1, 2")
def prepare_dashboard_rejects(spark, d):
    return C.split_rejects(tagged_dash(spark, d))[1].groupBy("source_year", "reason").agg(F.count("*").alias("n"))


@query("reconcile_severity", f"WITH {DASH} SELECT code, severity, count(*) AS n FROM d_tag WHERE reason IS NULL GROUP BY 1, 2")
def reconcile_severity(spark, d):
    raw = F.col("source_metadata.raw")["Highest Injury Severity Rating"]
    return C.split_rejects(tagged_dash(spark, d))[0].groupBy(T.kabco_code(raw).alias("code"), "severity").agg(F.count("*").alias("n"))


@query("severity_conflicts", f"WITH {DASH} SELECT conflict, count(*) AS n FROM (SELECT unnest(conflicts) AS conflict FROM d_tag WHERE reason IS NULL) t GROUP BY 1")
def severity_conflicts(spark, d):
    return C.split_rejects(tagged_dash(spark, d))[0].select(F.explode("source_metadata.conflicts").alias("conflict")).groupBy("conflict").agg(F.count("*").alias("n"))


@query("involvement_flags", f"WITH {DASH} SELECT ped AS ped_involved, bike AS bike_involved, count(*) AS n FROM d_tag WHERE reason IS NULL GROUP BY 1, 2")
def involvement_flags(spark, d):
    return C.split_rejects(tagged_dash(spark, d))[0].groupBy("ped_involved", "bike_involved").agg(F.count("*").alias("n"))


@query("public_metadata", f"WITH {DASH} SELECT id_cr AS dashboard_id, 'njdot_dashboard' AS source, 1 AS schema_version, streetname, casenumber FROM d_tag WHERE reason IS NULL")
def public_metadata(spark, d):
    m = "source_metadata"
    return C.split_rejects(tagged_dash(spark, d))[0].select(
        "dashboard_id", f"{m}.source", f"{m}.schema_version", f"{m}.raw.streetname", f"{m}.raw.casenumber")


AUDIT = DASH + f""",
u_good AS (SELECT *, {_DEXT} AS external_id, count(*) OVER (PARTITION BY id_cr) AS copies FROM d_tag WHERE reason IS NULL),
u_id AS (SELECT id_cr, arg_min(external_id, line) AS external_id, max(copies) > 1 AS conflict, min(line) AS first_line FROM u_good GROUP BY id_cr),
u_ext AS (SELECT external_id, count(*) AS ids FROM u_id GROUP BY external_id),
u_all AS (SELECT t.*, CASE WHEN t.reason IS NOT NULL THEN t.reason WHEN i.conflict THEN 'conflicting_dashboard_id' WHEN e.ids > 1 THEN 'ambiguous_legacy_identity' END AS final_reason
  FROM d_tag t LEFT JOIN u_id i ON i.id_cr = t.id_cr AND t.reason IS NULL LEFT JOIN u_ext e ON e.external_id = i.external_id)"""


@query("conflicting_dashboard_ids", f"WITH {AUDIT} SELECT id_cr AS dashboard_id, copies FROM u_good WHERE copies > 1")
def conflicting_dashboard_ids(spark, d):
    audited = C.duplicate_identity_audit(tagged_dash(spark, d))
    bad = audited.filter("reason = 'conflicting_dashboard_id'")
    return bad.join(bad.groupBy("dashboard_id").agg(F.count("*").alias("copies")), "dashboard_id").select("dashboard_id", "copies")


@query("duplicate_identity_audit", f"""WITH {AUDIT} SELECT year AS source_year, 2 * count(*) AS input, count(*) - count(final_reason) AS eligible,
  count(*) - count(final_reason) AS duplicates, 2 * count(final_reason) AS quarantined FROM u_all GROUP BY year""")
def duplicate_identity_audit(spark, d):
    # Every row twice: equal payloads are repeats, not conflicts.
    twice = raw_dash(spark, d).withColumn("line", F.explode(F.array(2 * F.col("line"), 2 * F.col("line") + 1)))
    return J.stage_and_audit(twice, labels(spark, d)).counts


@query("stage_and_audit", f"""WITH {AUDIT} SELECT line, id_cr AS dashboard_id, year AS source_year, final_reason AS reason FROM u_all""")
def stage_and_audit(spark, d):
    return J.stage_and_audit(raw_dash(spark, d), labels(spark, d)).audited.select("line", "dashboard_id", "source_year", "reason")


@query("ambiguous_legacy_identity", f"WITH {AUDIT} SELECT id_cr AS dashboard_id FROM u_all WHERE final_reason = 'ambiguous_legacy_identity'")
def ambiguous_legacy_identity(spark, d):
    audited = C.duplicate_identity_audit(tagged_dash(spark, d))
    return audited.filter("reason = 'ambiguous_legacy_identity'").select("dashboard_id")


@query("validate_export", f"""SELECT CAST(count(*) AS BIGINT) AS rows, count(DISTINCT id_cr) AS unique_ids, count(CASE WHEN r = 'year' THEN 1 END) AS outside_years, count(CASE WHEN r = 'date' THEN 1 END) AS invalid_dates,
 count(CASE WHEN r = 'date_year' THEN 1 END) AS date_year_conflicts, count(CASE WHEN r = 'id' THEN 1 END) AS invalid_ids, count(*) - count(DISTINCT id_cr) AS duplicate_ids, 20000 - count(*) AS missing_rows
FROM (SELECT id_cr, CASE WHEN CAST(year AS INT) NOT BETWEEN 2019 AND 2025 THEN 'year' WHEN TRY_CAST(dateofcrash AS DATE) IS NULL THEN 'date'
  WHEN year(CAST(dateofcrash AS DATE)) <> CAST(year AS INT) THEN 'date_year' WHEN NOT regexp_full_match(id_cr, '[0-9]+') THEN 'id' END AS r FROM t_dash) t""")
def validate_export(spark, d):
    return C.validate_export(raw_dash(spark, d), 2019, 2025, expected_rows=20000)


@query("export_counts_by_year", "SELECT year, count(*) AS rows FROM t_dash GROUP BY year")
def export_counts_by_year(spark, d):
    return C.export_counts_by_year(raw_dash(spark, d))


# --- archives as frames ------------------------------------------------------------------------
# Rows of seven archives, one of them with over a third of all, of every width that record repair tells apart.
_ARCHIVE_ROWS = """SELECT CASE WHEN o_custkey % 3 = 0 THEN 'A0' ELSE CONCAT('A', CAST(o_custkey % 7 AS STRING)) END AS archive, o_orderkey AS line,
 CASE WHEN o_custkey % 11 < 3 THEN 50 WHEN o_custkey % 11 < 6 THEN 49 WHEN o_custkey % 11 < 8 THEN 1 WHEN o_custkey % 11 = 8 THEN 2 WHEN o_custkey % 11 = 9 THEN 0 ELSE 3 END AS width,
 CONCAT('t', CAST(o_orderkey % 97 AS STRING)) AS txt, CONCAT('d', CAST(o_orderkey % 89 AS STRING)) AS dmg FROM orders"""


@query("run_report", f"""WITH {PREPARED}, per AS (SELECT archive, count(*) AS records, count(reason) AS rejected FROM a_tag GROUP BY archive),
 why AS (SELECT 'rejection' AS kind, reason AS value, count(*) AS n FROM a_tag WHERE reason IS NOT NULL GROUP BY ALL
   UNION ALL SELECT 'coordinate_issue', issue, count(*) FROM (SELECT {_ISSUE} AS issue FROM t_archive) i WHERE issue IS NOT NULL GROUP BY ALL)
SELECT 'archives' AS pipeline, 'failed' AS status, '2022' AS year, sum(records)::BIGINT AS records, sum(rejected)::BIGINT AS rejected, count(*) AS archives,
 (SELECT string_agg(kind || '=' || value || ':' || n, '|' ORDER BY kind, value) FROM why) AS counts, string_agg(archive || ':' || records, '|' ORDER BY archive) AS listed FROM per""")
def run_report(spark, d):
    tagged = stage(C.tag_crash(archive(spark, d), "Mercer", 2022).withColumn("coordinate_issue", F.col("reported.issue")).select("archive", "reason", "coordinate_issue"), "checks-tagged")
    status = F.when(F.col("archive") == "file3", "failed").otherwise("succeeded")
    archives = L.archive_totals(tagged.withColumn("status", F.when(F.col("reason").isNull(), "loaded").otherwise("rejected"))).withColumn("status", status)
    report = L.run_report("archives", archives, L.rejection_counts(tagged), {"year": 2022, "county": None})
    return report.select(
        "pipeline", "status", F.col("parameters")["year"].alias("year"), "totals.records", "totals.rejected", "totals.archives",
        F.array_join(F.transform("counts", lambda c: F.concat(c["kind"], F.lit("="), c["value"], F.lit(":"), c["records"].cast("string"))), "|").alias("counts"),
        F.array_join(F.transform("archives", lambda a: F.concat(a["archive"], F.lit(":"), a["records"].cast("string"))), "|").alias("listed"))


@query("repair_split_records", f"""WITH r AS ({_ARCHIVE_ROWS}),
 s AS (SELECT archive, list({{'w': CAST(width AS INT), 'line': CAST(line AS BIGINT), 'txt': txt, 'dmg': dmg, 'pend': CAST(NULL AS BIGINT), 'n': 0, 'chars': 0,
        'found': CAST([] AS STRUCT(line BIGINT, damage VARCHAR)[])}} ORDER BY line) AS steps FROM r GROUP BY archive),
 f AS (SELECT archive, list_reduce([{{'w': -1, 'line': CAST(0 AS BIGINT), 'txt': '', 'dmg': '', 'pend': CAST(NULL AS BIGINT), 'n': 0, 'chars': 0,
        'found': CAST([] AS STRUCT(line BIGINT, damage VARCHAR)[])}}] || steps, lambda a, r: {{'w': r.w, 'line': r.line, 'txt': r.txt,
   'dmg': CASE WHEN r.w = 49 THEN r.dmg WHEN r.w = 1 THEN a.dmg || ' ' || r.txt ELSE a.dmg END,
   'pend': CASE WHEN r.w = 49 THEN r.line WHEN r.w = 0 THEN a.pend WHEN r.w = 1 AND a.n < 16 AND a.chars + length(r.txt) <= 4096 THEN a.pend END,
   'n': CASE WHEN r.w = 49 THEN 0 WHEN r.w = 1 THEN a.n + 1 ELSE a.n END, 'chars': CASE WHEN r.w = 49 THEN 0 WHEN r.w = 1 THEN a.chars + CAST(length(r.txt) AS INT) ELSE a.chars END,
   'found': a.found || CASE WHEN r.w = 50 THEN CASE WHEN a.pend IS NULL THEN [] ELSE [{{'line': a.pend, 'damage': NULL}}] END || [{{'line': r.line, 'damage': r.dmg}}]
     WHEN r.w = 49 THEN CASE WHEN a.pend IS NULL THEN [] ELSE [{{'line': a.pend, 'damage': NULL}}] END
     WHEN a.pend IS NULL THEN [{{'line': r.line, 'damage': NULL}}]
     WHEN r.w = 0 OR (r.w = 1 AND a.n < 16 AND a.chars + length(r.txt) <= 4096) THEN []
     WHEN r.w = 2 THEN [{{'line': a.pend, 'damage': a.dmg || ' ' || r.txt}}] ELSE [{{'line': a.pend, 'damage': NULL}}] END}}) AS state FROM s)
SELECT archive, u.line AS line, u.damage AS damage FROM (SELECT archive, unnest(state.found || CASE WHEN state.pend IS NULL THEN [] ELSE [{{'line': state.pend, 'damage': NULL}}] END) AS u FROM f)""")
def repair_split_records(spark, d):
    n = F.col("width")
    cell = lambda i: F.when((n >= 49) & (i == 49), F.col("dmg")).when((n <= 3) & (i == 1), F.col("txt")).when((n == 2) & (i == 2), "7").otherwise("")
    cells = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), cell))
    rows = stage(view(spark, d, "orders", _ARCHIVE_ROWS).select("archive", F.col("line").cast("long").alias("line"), cells.alias("cells")), "checks-archive")
    good, bad = A.repair_split_records(rows)
    return good.select("archive", "line", F.get("cells", F.lit(V.DAMAGE_COLUMN)).alias("damage")).unionByName(
        bad.select("archive", "line", F.lit(None).cast("string").alias("damage")))


_NAMES = """SELECT DISTINCT CONCAT('/data/', CASE o_custkey % 5 WHEN 0 THEN 'Mercer' WHEN 1 THEN 'Cape May' WHEN 2 THEN 'CapeMay' WHEN 3 THEN 'Atlantis' ELSE 'ESSEX' END,
 CAST(2015 + o_orderkey % 9 AS STRING), CASE o_orderkey % 3 WHEN 0 THEN 'Accidents.zip' WHEN 1 THEN 'Pedestrians.txt' ELSE 'Other.txt' END) AS path FROM orders"""


@query("archive_inventory", f"""SELECT path, CASE WHEN contains(path, 'Other') THEN NULL WHEN contains(path, 'Mercer') THEN 'Mercer' WHEN contains(path, 'Cape') THEN 'Cape May' WHEN contains(path, 'ESSEX') THEN 'Essex' END AS county,
 CASE WHEN NOT contains(path, 'Other') THEN CAST(regexp_extract(path, '[0-9]+') AS INT) END AS year FROM ({_NAMES}) n""")
def archive_inventory(spark, d):
    return A.archive_inventory(view(spark, d, "orders", _NAMES))


# Person rows of an archive for each county and year; a code or a year outside the contract spoils its whole archive.
_PERSONS = """SELECT CASE o_custkey % 4 WHEN 0 THEN 'Mercer' WHEN 1 THEN 'Essex' WHEN 2 THEN 'Camden' ELSE 'Union' END AS county, CAST(2015 + o_custkey % 9 AS INT) AS year, o_orderkey AS line,
 CASE WHEN o_orderkey % 3 = 0 THEN 'Y' WHEN o_orderkey % 3 = 1 THEN 'n' ELSE '' END AS flag, o_custkey % 9 = 3 AND o_orderkey % 500 = 4 AS bad_flag,
 CASE o_custkey % 4 WHEN 0 THEN '11' WHEN 1 THEN '07' WHEN 2 THEN '04' ELSE '20' END AS code FROM orders"""


@query("scan_person_archive", f"""WITH p AS (SELECT *, county || year AS archive, NOT year BETWEEN 2017 AND 2022 AS bad_name FROM ({_PERSONS})),
 v AS (SELECT archive, min(line) FILTER (WHERE bad_flag OR bad_name) AS line, bool_or(bad_name) AS bad_name FROM p GROUP BY archive)
SELECT p.archive, CAST(p.line AS BIGINT) AS line, p.year || p.code || '05' || p.line AS case_number, upper(flag) = 'Y' AS bicycle, CAST(NULL AS VARCHAR) AS reason FROM p JOIN v USING (archive) WHERE v.line IS NULL
UNION ALL SELECT archive, CAST(line AS BIGINT), NULL, NULL, CASE WHEN bad_name THEN 'archive_name' ELSE 'bicycle_flag' END FROM v WHERE line IS NOT NULL""")
def scan_person_archive(spark, d):
    source_id = F.concat(F.col("year").cast("string"), "code", F.lit("05"), F.col("line").cast("string"))
    cells = F.transform(F.sequence(F.lit(1), F.lit(V.PERSON_COLUMNS)), lambda i: F.when(i == 1, source_id).when(
        i == V.PERSON_FLAG_COLUMN + 1, F.when(F.col("bad_flag"), "?").otherwise(F.col("flag"))).otherwise(""))
    rows = view(spark, d, "orders", _PERSONS).select(
        F.concat("county", F.col("year").cast("string")).alias("archive"), "county", "year", F.col("line").cast("long").alias("line"), cells.alias("cells"), F.lit(None).cast("string").alias("reason"))
    good, refused = A.judge_person_rows(rows)
    return good.select("archive", "line", F.substring_index("external_id", ":", -1).alias("case_number"), "bicycle", F.lit(None).cast("string").alias("reason")).unionByName(
        refused.select("archive", "line", F.lit(None).cast("string").alias("case_number"), F.lit(None).cast("boolean").alias("bicycle"), "reason"))


# --- reconciliation ----------------------------------------------------------------------------
STAGED = AUDIT + """,
r_new AS (SELECT g.*, CASE WHEN reported_lon BETWEEN x0 AND x0 + 0.3 AND reported_lat BETWEEN y0 AND y0 + 0.4 THEN 1 ELSE 0 END AS rep_ok,
    CASE WHEN calc_lon BETWEEN x0 AND x0 + 0.3 AND calc_lat BETWEEN y0 AND y0 + 0.4 THEN 1 ELSE 0 END AS calc_ok
  FROM (SELECT *, CASE WHEN geopoint <> '' THEN TRY_CAST(geopoint ->> 'lon' AS DOUBLE) ELSE TRY_CAST(longitude AS DOUBLE) END AS reported_lon,
      CASE WHEN geopoint <> '' THEN TRY_CAST(geopoint ->> 'lat' AS DOUBLE) ELSE TRY_CAST(latitude AS DOUBLE) END AS reported_lat,
      TRY_CAST(NULLIF(geopoint_calculated, '') ->> 'lon' AS DOUBLE) AS calc_lon, TRY_CAST(NULLIF(geopoint_calculated, '') ->> 'lat' AS DOUBLE) AS calc_lat,
      CAST(id_cr AS BIGINT) AS idn FROM u_all WHERE final_reason IS NULL) g JOIN t_muni m ON m.muni_id = g.muni_id),
r_match AS (SELECT *, CASE WHEN idn % 4 = 0 THEN 'dash' WHEN idn % 4 = 1 THEN 'ext' WHEN idn % 40 = 2 THEN 'both' ELSE 'none' END AS how FROM r_new),
r_out AS (SELECT *, CASE
    WHEN how = 'both' THEN 'dashboard_and_legacy_identity_conflict'
    WHEN how <> 'none' AND idn % 24 = 8 THEN 'existing_date_or_municipality_conflict'
    WHEN how = 'ext' AND idn % 20 = 5 THEN 'existing_dashboard_identity_conflict'
    WHEN how = 'none' AND year(dt) <= 2022 THEN 'historical_identity_unmatched'
    WHEN rep_ok = 1 OR calc_ok = 1 THEN CASE WHEN how = 'none' THEN 'inserted' ELSE 'updated' END
    WHEN how <> 'none' AND idn % 3 = 0 THEN 'updated' ELSE 'location_unresolved' END AS outcome FROM r_match)"""


def staged(spark, d):
    """The records of the whole export that pass validation and audit."""
    return stage(J.stage_and_audit(raw_dash(spark, d), labels(spark, d)).records, "checks-records")


def known_crashes(spark, d, s=None):
    """Stored crashes that some of the staged records match, built from the records."""
    s = staged(spark, d) if s is None else s
    n = F.col("dashboard_id").try_cast("long")
    box = munis(spark, d).select("muni_id", "x0", "y0")
    wrong_day = F.when(n % 24 == 8, F.date_add("crash_date", 1)).otherwise(F.col("crash_date"))
    ok = n % 3 == 0
    meta = F.struct(F.col("source_metadata.source"), F.col("source_metadata.schema_version"), F.col("source_metadata.raw"),
                    F.col("source_metadata.conflicts"), F.col("source_metadata.provenance"), F.lit("old").alias("location_method"))
    base = s.join(box, "muni_id").select(
        n.alias("n"), "dashboard_id", "external_id", wrong_day.alias("crash_date"), F.lit("01:00").alias("crash_time"),
        F.lit("injury_unknown").alias("severity"), (n % 5 == 0).alias("ped_involved"),
        F.when(n % 7 == 0, F.lit(True)).when(n % 7 == 1, F.lit(False)).alias("bike_involved"),
        *[F.lit(None).cast("int").alias(c) for c in V.CASUALTY_COLUMNS], "muni_id", F.lit("Old Rd").alias("road_name"),
        "route_number", "weather_condition", F.lit("DARK").alias("light_condition"), meta.alias("source_metadata"),
        F.when(n % 2 == 0, F.lit("reported")).alias("geocode_quality"), n.alias("segment_id"), F.lit(5.0).alias("snap_distance"),
        F.when(ok, F.col("x0") + 0.1).otherwise(F.lit(-70.0)).alias("lon"), (F.col("y0") + 0.1).alias("lat"))
    dash = base.filter((n % 4 == 0) | (F.col("n") % 40 == 2)).withColumns({
        "crash_id": F.col("n") * 10, "external_id": F.concat(F.lit("NJDOT:old:"), "dashboard_id")})
    other = F.when(F.col("n") % 20 == 5, F.concat(F.lit("other"), "dashboard_id"))
    ext = base.filter((F.col("n") % 4 == 1) | (F.col("n") % 40 == 2)).withColumns({
        "crash_id": F.col("n") * 10 + 1, "dashboard_id": other})
    return stage(dash.unionByName(ext).drop("n"), "checks-known")


def actions(spark, d):
    s = staged(spark, d)
    return R.reconcile_dashboard(R.match_records(s, known_crashes(spark, d, s), muni_polygons(spark, d)))


@query("identity_match", f"""WITH {STAGED} SELECT id_cr AS dashboard_id, how <> 'none' AS matched, how = 'both' AS identity_conflict FROM r_match""")
def identity_match(spark, d):
    s = staged(spark, d)
    return R.identity_match(s, known_crashes(spark, d, s)).select(
        "dashboard_id", F.col("existing").isNotNull().alias("matched"), "identity_conflict")


@query("unknown_source_overlap", f"""WITH {STAGED} SELECT id_cr AS dashboard_id, how = 'none' AND EXISTS (
  SELECT 1 FROM r_match o WHERE o.muni_id = r.muni_id AND o.dt = r.dt AND o.idn % 6 = 3) AS overlap FROM r_match r""")
def unknown_source_overlap(spark, d):
    s = staged(spark, d)
    foreign = s.filter(F.col("dashboard_id").try_cast("long") % 6 == 3).select(
        "muni_id", "crash_date", F.lit(None).cast("string").alias("dashboard_id"),
        F.when(F.col("severity") == "fatal", F.lit("legacy-1")).alias("external_id"))
    m = R.identity_match(s, known_crashes(spark, d, s))
    return R.unknown_source_overlap(m, foreign).select("dashboard_id", F.col("unknown_source_overlap").alias("overlap"))


@query("reconcile_dashboard", f"""WITH {STAGED} SELECT id_cr AS dashboard_id, outcome,
 CASE WHEN outcome IN ('updated', 'inserted') THEN CASE WHEN rep_ok = 1 THEN 'dashboard_current' WHEN calc_ok = 1 THEN 'dashboard_calculated'
   WHEN idn % 2 = 0 THEN 'reported' ELSE 'historical_validated' END END AS method,
 CASE WHEN outcome = 'updated' THEN CASE WHEN idn % 7 = 0 THEN TRUE WHEN bike IS NULL AND idn % 7 = 1 THEN FALSE ELSE bike END WHEN outcome = 'inserted' THEN bike END AS bike_involved,
 CASE WHEN outcome = 'updated' THEN ped OR idn % 5 = 0 WHEN outcome = 'inserted' THEN ped END AS ped_involved,
 CASE WHEN outcome = 'updated' AND rep_ok = 0 AND calc_ok = 0 THEN idn END AS segment_id, CASE WHEN outcome = 'updated' THEN 'DARK' END AS light_condition,
 CASE WHEN outcome = 'updated' THEN idn * 10 + CASE WHEN how = 'ext' THEN 1 ELSE 0 END END AS crash_id FROM r_out""")
def reconcile_dashboard(spark, d):
    v = "values"
    return actions(spark, d).select(
        "dashboard_id", "outcome", F.col(f"{v}.geocode_quality").alias("method"), f"{v}.bike_involved", f"{v}.ped_involved",
        f"{v}.segment_id", f"{v}.light_condition", F.when(F.col("outcome") == "updated", F.col("crash_id")).alias("crash_id"))


@query("reconciliation_outcomes", f"""WITH {STAGED} SELECT CAST(year(dt) AS INT) AS year, outcome, count(*) AS records, count(CASE WHEN how <> 'none' THEN 1 END) AS matched,
 count(CASE WHEN outcome = 'historical_identity_unmatched' AND (rep_ok = 1 OR calc_ok = 1) THEN 1 END) AS unmatched_with_valid_location FROM r_out GROUP BY 1, 2""")
def reconciliation_outcomes(spark, d):
    return R.reconciliation_outcomes(actions(spark, d))


@query("apply_reconciliation", f"""WITH {STAGED} SELECT crash_date, count(*) AS crashes, count(bike) AS bikes, count(CASE WHEN sev <> 'injury_unknown' THEN 1 END) AS rated FROM (
  SELECT CAST(dt AS VARCHAR) AS crash_date, CASE WHEN idn % 7 = 0 THEN 1 WHEN bike IS NULL AND idn % 7 = 1 THEN 1 WHEN bike THEN 1 END AS bike, severity AS sev FROM r_out WHERE outcome = 'updated'
  UNION ALL SELECT CAST(dt AS VARCHAR), CASE WHEN bike THEN 1 END, severity FROM r_out WHERE outcome = 'inserted'
  UNION ALL SELECT CAST(CASE WHEN idn % 24 = 8 THEN dt + 1 ELSE dt END AS VARCHAR), CASE WHEN idn % 7 IN (0, 1) THEN 1 END, 'injury_unknown' FROM r_out, range(2) t(g)
    WHERE outcome <> 'updated' AND (how = 'both' OR (how <> 'none' AND g = 0))) x GROUP BY 1""")
def apply_reconciliation(spark, d):
    s = staged(spark, d)
    state = J.run_reconciliation(s, known_crashes(spark, d, s), muni_polygons(spark, d), apply_to=new_folder(spark, "checks-table")).state
    return state.groupBy(F.col("crash_date").cast("string").alias("crash_date")).agg(
        F.count("*").alias("crashes"), F.count("bike_involved").alias("bikes"),
        F.count_if(F.col("severity") != "injury_unknown").alias("rated"))


@query("dry_run_reconciliation", f"WITH {STAGED} SELECT outcome, count(*) AS records FROM r_out GROUP BY 1")
def dry_run_reconciliation(spark, d):
    s = staged(spark, d)
    run = J.run_reconciliation(s, known_crashes(spark, d, s), muni_polygons(spark, d))
    return run.actions.groupBy("outcome").agg(F.count("*").alias("records"))


@query("reconciliation_report", f"""WITH {STAGED} SELECT 'outcome' AS counter, CAST(year(dt) AS INT) AS year, outcome AS name, count(*) AS records FROM r_out GROUP BY ALL
UNION ALL SELECT 'matched', CAST(year(dt) AS INT), NULL, count(*) FROM r_out WHERE how <> 'none' GROUP BY ALL
UNION ALL SELECT 'unmatched_with_valid_location', CAST(year(dt) AS INT), NULL, count(*) FROM r_out WHERE outcome = 'historical_identity_unmatched' AND (rep_ok = 1 OR calc_ok = 1) GROUP BY ALL
UNION ALL SELECT 'location', NULL, CASE WHEN rep_ok = 1 THEN 'dashboard_current' WHEN calc_ok = 1 THEN 'dashboard_calculated' WHEN idn % 2 = 0 THEN 'reported' ELSE 'historical_validated' END,
  count(*) FROM r_out WHERE outcome IN ('updated', 'inserted') GROUP BY ALL
UNION ALL SELECT 'conflict', NULL, conflict, count(*) FROM (SELECT unnest(conflicts) AS conflict FROM r_out) c GROUP BY ALL""")
def reconciliation_report(spark, d):
    return R.reconciliation_report(actions(spark, d))


# --- upserts and enrichment ----------------------------------------------------------------------
_OLD = """SELECT CONCAT('NJDOT:', CAST(o_orderkey AS STRING)) AS external_id, CASE WHEN o_orderkey % 5 = 0 THEN CONCAT('D', CAST(o_orderkey AS STRING)) ELSE NULL END AS dashboard_id,
 'property_damage' AS severity, o_orderkey % 3 = 0 AS ped_involved, CASE o_orderkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END AS bike_involved,
 CAST(o_orderkey % 2 AS INT) AS total_killed, CAST(1 AS INT) AS total_injured, CAST(NULL AS INT) AS pedestrians_killed, CAST(0 AS INT) AS pedestrians_injured,
 CAST(o_orderdate AS DATE) AS crash_date, CAST(o_custkey % 25 AS INT) AS muni_id FROM orders WHERE o_orderkey % 10 < 7"""
_NEW = """SELECT CONCAT('NJDOT:', CAST(o_orderkey AS STRING)) AS external_id, CASE WHEN o_orderkey % 2 = 0 THEN 'fatal' ELSE 'injury_unknown' END AS severity,
 o_orderkey % 7 = 0 AS ped_involved, CASE WHEN o_orderkey % 6 = 0 THEN TRUE ELSE NULL END AS bike_involved, CAST(NULL AS INT) AS total_killed, CAST(o_orderkey % 4 AS INT) AS total_injured,
 CAST(1 AS INT) AS pedestrians_killed, CAST(NULL AS INT) AS pedestrians_injured, CAST(o_orderdate AS DATE) AS crash_date, CAST(3 AS INT) AS muni_id FROM orders WHERE o_orderkey % 10 > 3"""


def old_new(spark, d):
    return view(spark, d, "orders", _OLD), view(spark, d, "orders", _NEW)


_HIT = "o.external_id IS NOT NULL AND n.external_id IS NOT NULL AND o.dashboard_id IS NULL"


@query("upsert_crashes", f"""SELECT COALESCE(o.external_id, n.external_id) AS external_id, CASE WHEN o.external_id IS NULL OR {_HIT} THEN n.severity ELSE o.severity END AS severity,
 CASE WHEN o.external_id IS NULL OR {_HIT} THEN n.ped_involved ELSE o.ped_involved END AS ped_involved,
 CASE WHEN o.external_id IS NULL THEN n.bike_involved WHEN {_HIT} THEN COALESCE(o.bike_involved, n.bike_involved) ELSE o.bike_involved END AS bike_involved,
 CASE WHEN o.external_id IS NULL OR {_HIT} THEN n.total_injured ELSE o.total_injured END AS total_injured, COALESCE(o.muni_id, n.muni_id) AS muni_id,
 CASE WHEN o.external_id IS NULL THEN 'inserted' WHEN {_HIT} THEN 'updated' WHEN n.external_id IS NOT NULL THEN 'skipped' ELSE 'kept' END AS action
FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.external_id = n.external_id""")
def upsert_crashes(spark, d):
    return U.upsert_crashes(*old_new(spark, d)).select(
        "external_id", "severity", "ped_involved", "bike_involved", "total_injured", "muni_id", "action")


@query("enrich_casualties", f"""SELECT o.external_id, CASE WHEN {_HIT} THEN n.severity ELSE o.severity END AS severity, CASE WHEN {_HIT} THEN o.ped_involved OR n.ped_involved ELSE o.ped_involved END AS ped_involved,
 CASE WHEN {_HIT} THEN COALESCE(o.bike_involved, n.bike_involved) ELSE o.bike_involved END AS bike_involved, o.total_killed,
 CASE WHEN {_HIT} THEN n.total_injured ELSE o.total_injured END AS total_injured, CASE WHEN {_HIT} THEN 1 END AS pedestrians_killed, 0 AS pedestrians_injured
FROM ({_OLD}) o LEFT JOIN ({_NEW}) n ON o.external_id = n.external_id""")
def enrich_casualties(spark, d):
    return U.enrich_casualties(*old_new(spark, d))[0].drop("dashboard_id", "crash_date", "muni_id")


@query("enrich_casualties_missing", f"SELECT external_id, 'existing_crash_missing' AS reason FROM ({_NEW}) n WHERE external_id NOT IN (SELECT external_id FROM ({_OLD}) o WHERE dashboard_id IS NULL)")
def enrich_casualties_missing(spark, d):
    return U.enrich_casualties(*old_new(spark, d))[1].select("external_id", "reason")


def evidence(spark, d):
    return view(spark, d, "orders", _NEW).filter("severity = 'fatal'").join(munis(spark, d).select("muni_id", "county"), "muni_id").select(
        "external_id", F.year("crash_date").alias("year"), "county")


_EVID = f"(SELECT DISTINCT external_id, year(crash_date) AS year, county FROM ({_NEW}) n JOIN t_muni USING (muni_id) WHERE severity = 'fatal')"


@query("enrich_bicycle", f"""SELECT o.external_id, e.external_id IS NOT NULL AS matched, CASE WHEN e.external_id IS NOT NULL THEN TRUE ELSE bike_involved END AS bike_involved
FROM ({_OLD}) o JOIN t_muni m USING (muni_id) LEFT JOIN {_EVID} e ON e.external_id = o.external_id AND e.year = year(o.crash_date) AND upper(e.county) = upper(m.county)""")
def enrich_bicycle(spark, d):
    return U.enrich_bicycle(old_new(spark, d)[0], evidence(spark, d), munis(spark, d)).select("external_id", "matched", "bike_involved")


@query("bicycle_counters", f"""SELECT count(e.external_id) AS matched, count(CASE WHEN e.external_id IS NOT NULL AND bike_involved IS NOT TRUE THEN 1 END) AS updated,
 count(CASE WHEN e.external_id IS NOT NULL AND bike_involved THEN 1 END) AS already_known, count(CASE WHEN e.external_id IS NOT NULL AND bike_involved = FALSE THEN 1 END) AS conflicting_false,
 (SELECT count(*) FROM {_EVID} v) - count(e.external_id) AS unmatched
FROM ({_OLD}) o JOIN t_muni m USING (muni_id) LEFT JOIN {_EVID} e ON e.external_id = o.external_id AND e.year = year(o.crash_date) AND upper(e.county) = upper(m.county)""")
def bicycle_counters(spark, d):
    ev = evidence(spark, d)
    return U.bicycle_counters(U.enrich_bicycle(old_new(spark, d)[0], ev, munis(spark, d)), ev)


@query("companion_totals", f"""SELECT year, county, count(*) AS source_rows, count(CASE WHEN bicycle THEN 1 END) AS source_person_rows, count(DISTINCT CASE WHEN bicycle THEN external_id END) AS source_crashes
FROM (SELECT external_id || k AS external_id, year, county, k % 2 = 0 AS bicycle FROM {_EVID} e, range(0, 3) t(k), range(0, 2) t2(j)) p GROUP BY 1, 2""")
def companion_totals(spark, d):
    rows = evidence(spark, d).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(1))))
    return L.companion_totals(rows.withColumns({"external_id": F.concat("external_id", F.col("k").cast("string")), "bicycle": F.col("k") % 2 == 0}))


@query("companion_report", f"""WITH c AS (SELECT CAST(year AS INT) AS year, county, count(*) AS n FROM {_EVID} e GROUP BY ALL)
SELECT year, count(*) AS archives, CAST(sum(3 * n) AS BIGINT) AS source_rows, CAST(sum(2 * n) AS BIGINT) AS source_person_rows, CAST(sum(n) AS BIGINT) AS source_crashes, CAST(sum(n % 5) AS BIGINT) AS matched,
 CAST(sum(n % 3) AS BIGINT) AS updated, CAST(sum(n % 2) AS BIGINT) AS already_known, CAST(sum(n % 7) AS BIGINT) AS unmatched, CAST(0 AS BIGINT) AS conflicting_false
FROM c GROUP BY GROUPING SETS ((year), ())""")
def companion_report(spark, d):
    n = F.col("n")
    counts = evidence(spark, d).groupBy(F.col("year").cast("int").alias("year"), "county").agg(F.count(F.lit(1)).alias("n"))
    values = dict(zip(L.COMPANION_COUNTERS, (3 * n, 2 * n, n, n % 5, n % 3, n % 2, n % 7, n * 0)))
    return L.companion_report(counts.select("year", "county", *[v.cast("bigint").alias(c) for c, v in values.items()]))


@query("unmatched_ids", f"SELECT external_id FROM ({_NEW}) n EXCEPT SELECT external_id FROM ({_OLD}) o")
def unmatched_ids(spark, d):
    old, new = old_new(spark, d)
    return U.unmatched_ids(new, old)


@query("union_ids", f"SELECT external_id FROM ({_NEW}) n UNION SELECT external_id FROM ({_OLD}) o")
def union_ids(spark, d):
    return U.union_ids(*old_new(spark, d))


@query("insert_if_absent", f"""SELECT external_id, severity FROM ({_OLD}) o UNION ALL SELECT external_id, severity FROM ({_NEW}) n
WHERE external_id NOT IN (SELECT external_id FROM ({_OLD}) o)""")
def insert_if_absent(spark, d):
    old, new = old_new(spark, d)
    return U.insert_if_absent(old, new, ["external_id"]).select("external_id", "severity")


_TR = "SELECT tract_id, muni_id, svi_percentile, CAST(7 AS DOUBLE) AS pct_below_poverty FROM t_tract WHERE muni_id % 3 <> 0"


@query("upsert_tracts", f"""SELECT COALESCE(o.tract_id, n.tract_id) AS tract_id, CASE WHEN o.tract_id IS NOT NULL THEN o.muni_id END AS muni_id,
 CASE WHEN n.tract_id IS NOT NULL THEN n.svi_percentile ELSE o.svi_percentile END AS svi_percentile, o.pct_below_poverty,
 CASE WHEN o.tract_id IS NULL THEN 'inserted' WHEN n.tract_id IS NULL THEN 'kept' ELSE 'updated' END AS action
FROM ({_TR}) o FULL JOIN (SELECT tract_id, svi_percentile + 1 AS svi_percentile FROM t_tract WHERE muni_id % 5 <> 0) n ON n.tract_id = o.tract_id""")
def upsert_tracts(spark, d):
    new = view(spark, d, "t_tract").filter("muni_id % 5 <> 0").select("tract_id", (F.col("svi_percentile") + 1).alias("svi_percentile"))
    return U.upsert_tracts(view(spark, d, "t_tract", _TR), new)


@query("upsert_municipalities", """SELECT 'c' || muni_id AS muni_code, CASE WHEN muni_id % 2 = 0 OR muni_id % 3 = 0 THEN 'new ' || name ELSE name END AS name,
 CASE WHEN muni_id % 3 = 0 THEN NULL ELSE muni_id END AS muni_id, CASE WHEN muni_id % 3 = 0 THEN 'inserted' WHEN muni_id % 2 = 0 THEN 'updated' ELSE 'kept' END AS action FROM t_muni""")
def upsert_municipalities(spark, d):
    m = munis(spark, d).select(F.concat(F.lit("c"), F.col("muni_id").cast("string")).alias("muni_code"), "name", "muni_id")
    new = m.filter("muni_id % 2 = 0 OR muni_id % 3 = 0").select("muni_code", F.concat(F.lit("new "), "name").alias("name"))
    return U.upsert_municipalities(m.filter("muni_id % 3 <> 0"), new)


@query("upsert_roads", """SELECT segment_id, CASE WHEN segment_id % 2 = 0 THEN 'renamed' ELSE road_name END AS road_name, CASE WHEN segment_id % 2 = 0 THEN 'updated' ELSE 'kept' END AS action FROM t_road
UNION ALL SELECT -segment_id, 'fresh', 'inserted' FROM t_road WHERE segment_id % 10 = 0""")
def upsert_roads(spark, d):
    old = stored_segments(spark, d).select("source_id", "segment_id", "road_name")
    new = old.filter("segment_id % 2 = 0").select("source_id", "segment_id", F.lit("renamed").alias("road_name")).unionByName(
        old.filter("segment_id % 10 = 0").select(F.concat("source_id", F.lit("N")).alias("source_id"), (-F.col("segment_id")).alias("segment_id"), F.lit("fresh").alias("road_name")))
    return U.upsert_roads(old, new).select("segment_id", "road_name", "action")


# --- legacy files, tracts, census ---------------------------------------------------------------------
_LEGACY = """SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN 'n/a' WHEN o_orderkey % 29 = 0 THEN '2001-04-05 junk' WHEN o_orderkey % 3 = 0 THEN CONCAT(LPAD(CAST(1 + o_orderkey % 12 AS STRING), 2, '0'), '/05/2001 08:15') ELSE CONCAT('2001-', LPAD(CAST(1 + o_orderkey % 12 AS STRING), 2, '0'), '-05') END AS DATE_,
 CASE o_custkey % 6 WHEN 0 THEN 'Fatality' WHEN 1 THEN 'Incapacitating' WHEN 2 THEN 'possible injury' WHEN 3 THEN 'PDO' WHEN 4 THEN NULL ELSE 'strange' END AS SEVERITY,
 CAST(CAST(38 + o_custkey % 5 AS DOUBLE) AS STRING) AS LAT, CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE '-74.5' END AS LONG_,
 CASE o_orderkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'y' WHEN 2 THEN NULL ELSE 'no' END AS PEDESTRIAN FROM orders"""


@query("standardize_legacy_crashes", f"""SELECT o_orderkey, '2001-' || lpad(CAST(1 + o_orderkey % 12 AS VARCHAR), 2, '0') || '-05' AS crash_date, CASE lower(SEVERITY) WHEN 'fatality' THEN 'fatal' WHEN 'incapacitating' THEN 'serious_injury' WHEN 'possible injury' THEN 'minor_injury'
 ELSE 'property_damage' END AS severity, COALESCE(lower(PEDESTRIAN) IN ('yes', 'true', '1', 'y'), FALSE) AS ped_involved, 'medium' AS geocode_quality
FROM ({_LEGACY}) l WHERE DATE_ NOT IN ('n/a', '2001-04-05 junk') AND LONG_ <> '' AND CAST(LAT AS DOUBLE) BETWEEN 38.5 AND 41.5""")
def standardize_legacy_crashes(spark, d):
    raw = view(spark, d, "orders", _LEGACY).withColumnsRenamed({"DATE_": "DATE", "LONG_": "LONG"})
    return C.standardize_legacy_crashes(raw).select(
        "o_orderkey", F.col("crash_date").cast("string").alias("crash_date"), "severity", "ped_involved", "geocode_quality")


@query("legacy_drops", f"""SELECT CASE WHEN DATE_ IN ('n/a', '2001-04-05 junk') THEN 'date' WHEN LONG_ = '' THEN 'coordinates' ELSE 'bounds' END AS reason, count(*) AS records
FROM ({_LEGACY}) l WHERE DATE_ IN ('n/a', '2001-04-05 junk') OR LONG_ = '' OR NOT CAST(LAT AS DOUBLE) BETWEEN 38.5 AND 41.5 GROUP BY ALL""")
def legacy_drops(spark, d):
    return C.legacy_drops(view(spark, d, "orders", _LEGACY).withColumnsRenamed({"DATE_": "DATE", "LONG_": "LONG"}))


_SVI = """SELECT c_custkey, CASE WHEN c_custkey % 31 = 0 THEN 'PA' ELSE 'NJ' END AS ST_ABBR,
 CASE WHEN c_custkey % 37 = 0 THEN '3400' ELSE CONCAT('34', LPAD(CAST(c_custkey AS STRING), 9, '0')) END AS FIPS,
 CASE WHEN c_custkey % 41 = 0 THEN 'Point' ELSE 'Polygon' END AS geometry_type,
 CASE WHEN c_custkey % 43 = 0 THEN '-999' WHEN c_custkey % 47 = 0 THEN '1.5' WHEN c_custkey % 53 = 0 THEN '' ELSE CAST(CAST(c_custkey % 1000 AS DOUBLE) / 1000 AS STRING) END AS RPL_THEMES,
 CASE WHEN c_custkey % 59 = 0 THEN '12.5' ELSE CAST(c_custkey % 7000 AS STRING) END AS E_TOTPOP, CASE WHEN c_custkey % 61 = 0 THEN 'x' ELSE '12.25' END AS EP_NOVEH, '-999' AS EP_MINRTY FROM customer"""


@query("normalize_svi", f"""SELECT FIPS AS tract_id, substr(FIPS, 3, 3) AS county_fips, CAST(E_TOTPOP AS BIGINT) AS total_population, CAST(EP_NOVEH AS DOUBLE) AS pct_no_vehicle,
 CASE WHEN RPL_THEMES IN ('-999', '') THEN NULL ELSE round(CAST(RPL_THEMES AS DOUBLE) * 100, 6) END AS svi_percentile FROM ({_SVI}) s
WHERE ST_ABBR = 'NJ' AND length(FIPS) = 11 AND geometry_type = 'Polygon' AND RPL_THEMES <> '1.5' AND E_TOTPOP <> '12.5' AND EP_NOVEH <> 'x'""")
def normalize_svi(spark, d):
    return C.normalize_svi(svi_rows(spark, d))[0].select("tract_id", "county_fips", "total_population", "pct_no_vehicle", "svi_percentile")


def svi_rows(spark, d):
    one = S.box_rings(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    return view(spark, d, "customer", _SVI).withColumn("rings", one)


@query("normalize_svi_rejects", f"""SELECT CASE WHEN ST_ABBR <> 'NJ' THEN 'state' WHEN length(FIPS) <> 11 THEN 'tract_id' WHEN geometry_type <> 'Polygon' THEN 'geometry' WHEN RPL_THEMES = '1.5' THEN 'svi_percentile'
 WHEN E_TOTPOP = '12.5' THEN 'total_population' WHEN EP_NOVEH = 'x' THEN 'pct_no_vehicle' END AS reason, count(*) AS n FROM ({_SVI}) s GROUP BY 1 HAVING reason IS NOT NULL""")
def normalize_svi_rejects(spark, d):
    return C.normalize_svi(svi_rows(spark, d))[1].groupBy("reason").agg(F.count("*").alias("n"))


@query("optional_number", f"""SELECT c_custkey, CASE WHEN RPL_THEMES NOT IN ('-999', '', '1.5') THEN CAST(RPL_THEMES AS DOUBLE) END AS value, RPL_THEMES = '1.5' AS bad, E_TOTPOP = '12.5' AS bad_integer FROM ({_SVI}) s""")
def optional_number(spark, d):
    value, bad = N.optional_number(F.col("RPL_THEMES"), 0, 1)
    return view(spark, d, "customer", _SVI).select("c_custkey", value.alias("value"), bad.alias("bad"),
                                                   N.optional_number(F.col("E_TOTPOP"), 0, integer=True)[1].alias("bad_integer"))


_CENSUS = """SELECT CAST(c_custkey AS STRING) AS tract_id, CASE WHEN c_custkey % 17 = 0 THEN 'null' ELSE CAST(1000 + c_custkey % 90 AS STRING) END AS B01003_001E,
 CAST(c_custkey % 60 AS STRING) AS B17001_002E, CAST(c_custkey % 13 AS STRING) AS B08201_002E, CASE WHEN c_custkey % 19 = 0 THEN '0' ELSE CAST(400 + c_custkey % 7 AS STRING) END AS B08201_001E,
 CAST(1000 AS STRING) AS B02001_001E, CAST(c_custkey % 800 AS STRING) AS B02001_002E FROM customer"""
INDEX = f"""
v_raw AS (SELECT tract_id, COALESCE(CAST(B17001_002E AS DOUBLE) / TRY_CAST(B01003_001E AS DOUBLE) * 100, 0) AS p, COALESCE(CAST(B08201_002E AS DOUBLE) / NULLIF(CAST(B08201_001E AS DOUBLE), 0) * 100, 0) AS v,
  COALESCE((CAST(B02001_001E AS DOUBLE) - CAST(B02001_002E AS DOUBLE)) / CAST(B02001_001E AS DOUBLE) * 100, 0) AS m FROM ({_CENSUS}) c),
v_norm AS (SELECT *, p / max(p) OVER () * 100 AS pn, v / max(v) OVER () * 100 AS vn, m / max(m) OVER () * 100 AS mn FROM v_raw),
v_score AS (SELECT *, (0.0 + pn + vn + mn) / 3 AS score FROM v_norm),
v_rank AS (SELECT *, rank() OVER (ORDER BY score) AS r, count(*) OVER (PARTITION BY score) AS ties, count(*) OVER () AS n FROM v_score)"""


def census(spark, d):
    return view(spark, d, "customer", _CENSUS)


@query("vulnerability_index", f"""WITH {INDEX} SELECT tract_id, round(pn, 6) AS pct_below_poverty_norm, round(vn, 6) AS pct_no_vehicle_norm, round(mn, 6) AS pct_minority_norm, round(score, 6) AS svi_score,
 round((r + (ties - 1) / 2) / n * 100 + 1e-10, 6) AS svi_percentile FROM v_rank""")
def vulnerability_index(spark, d):
    return E.vulnerability_index(census(spark, d)).select(
        "tract_id", *[F.round(c, 6).alias(c) for c in ("pct_below_poverty_norm", "pct_no_vehicle_norm", "pct_minority_norm", "svi_score")],
        F.round(F.col("svi_percentile") + 1e-10, 6).alias("svi_percentile"))


@query("percentile_rank_avg", """WITH r AS (SELECT s_suppkey, s_suppkey % 40 AS v, rank() OVER (ORDER BY s_suppkey % 40) AS r, count(*) OVER (PARTITION BY s_suppkey % 40) AS t, count(*) OVER () AS n FROM supplier)
SELECT s_suppkey, round((r + (t - 1) / 2) / n * 100 + 1e-10, 8) AS percentile FROM r""")
def percentile_rank_avg(spark, d):
    df = view(spark, d, "supplier", "SELECT s_suppkey, s_suppkey % 40 AS v FROM supplier")
    return E.percentile_rank_avg(df, "v").select("s_suppkey", F.round(F.col("percentile") + 1e-10, 8).alias("percentile"))


@query("max_normalize", "SELECT s_suppkey, round(s_acctbal / max(s_acctbal) OVER () * 100 + 1e-10, 8) AS s_acctbal_norm FROM supplier")
def max_normalize(spark, d):
    df = view(spark, d, "supplier", "SELECT s_suppkey, s_acctbal FROM supplier")
    return E.max_normalize(df, ["s_acctbal"]).select("s_suppkey", F.round(F.col("s_acctbal_norm") + 1e-10, 8).alias("s_acctbal_norm"))


@query("merge_demographics", f"SELECT t.tract_id, c.B17001_002E AS poor FROM (SELECT CAST(s_suppkey * 20 AS VARCHAR) AS tract_id FROM supplier) t LEFT JOIN ({_CENSUS}) c USING (tract_id)")
def merge_demographics(spark, d):
    left = view(spark, d, "supplier", "SELECT CAST(s_suppkey * 20 AS STRING) AS tract_id FROM supplier")
    return E.merge_demographics(left, census(spark, d)).select("tract_id", F.col("B17001_002E").alias("poor"))


def drawn_tracts(spark, d):
    """Tracts whose outline crosses itself, has a hole inside or through the shell, folds back, or vanishes, by their number."""
    box = S.ring_extent(F.col("rings"))
    x0, y0, x1, y1 = (box[c] for c in ("x0", "y0", "x1", "y1"))
    w, h = (x1 - x0) / 4, (y1 - y0) / 4
    n = F.col("tract_id").cast("long") % 1000000000
    inner = lambda dx: S.line((x0 + w + dx, y0 + h), (x1 - w + dx, y0 + h), (x1 - w + dx, y1 - h), (x0 + w + dx, y1 - h), (x0 + w + dx, y0 + h))
    shell = F.col("rings")[0]
    rings = (F.when(n % 11 == 0, F.array(S.line((x0, y0), (x1, y1), (x1, y0), (x0, y1), (x0, y0)))).when(n % 13 == 0, F.array(shell, inner(2 * w)))
             .when(n % 17 == 0, F.array(shell, inner(F.lit(0.0)))).when(n % 19 == 0, F.array(S.line((x0, y0), (x1, y0), (x1, y1), (x1, y0), (x0, y0))))
             .when(n % 23 == 0, F.array(S.line((x0, y0), (x0, y0), (x0, y0), (x0, y0)))).otherwise(F.col("rings")))
    return tracts(spark, d).select("tract_id", rings.alias("rings"), F.when(n % 7 == 0, 3424).otherwise(4326).alias("srid"))


_DRAWN = """CASE WHEN n % 11 = 0 THEN 'self_intersection' WHEN n % 13 = 0 THEN 'ring_crossing' WHEN n % 17 = 0 THEN NULL WHEN n % 19 = 0 THEN 'self_intersection' WHEN n % 23 = 0 THEN {empty} END"""


@query("geometry_audit", f"""SELECT count({_DRAWN.format(empty='NULL')}) AS invalid_geometries, count(CASE WHEN n % 7 = 0 THEN 1 END) AS other_srid
FROM (SELECT CAST(tract_id AS BIGINT) % 1000000000 AS n FROM t_tract) t""")
def geometry_audit(spark, d):
    return P.geometry_audit(drawn_tracts(spark, d), srid="srid")


@query("repair_polygon", f"""SELECT tract_id, {_DRAWN.format(empty="'empty_geometry'")} AS reason FROM (SELECT tract_id, CAST(tract_id AS BIGINT) % 1000000000 AS n FROM t_tract) t""")
def repair_polygon(spark, d):
    good, bad = P.repair_polygon(drawn_tracts(spark, d))
    return good.select("tract_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("tract_id", "reason"))


# Quarter degrees, so that both engines write the same digits.
_QUARTERS = """SELECT s_suppkey, CAST(s_suppkey % 300 AS DOUBLE) / CAST(4 AS DOUBLE) - CAST(75 AS DOUBLE) AS x, CAST(s_suppkey % 30 AS DOUBLE) / CAST(4 AS DOUBLE) AS y FROM supplier"""


def _wkt_box(size, shift):
    corners = [(shift, shift), (shift + size, shift), (shift + size, shift + size), (shift, shift + size), (shift, shift)]
    return "'(' || " + " || ', ' || ".join(f"CAST(x + {dx} AS DOUBLE) || ' ' || CAST(y + {dy} AS DOUBLE)" for dx, dy in corners) + " || ')'"


@query("multipolygon_wkt", f"""SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'MULTIPOLYGON ((' || {_wkt_box(8, 0)} || ', ' || {_wkt_box(2, 1)} || ')' ||
 CASE WHEN s_suppkey % 2 = 0 THEN ', (' || {_wkt_box(1, 20)} || ')' ELSE '' END || ')' END AS wkt FROM ({_QUARTERS}) q""")
def multipolygon_wkt(spark, d):
    def box(size, shift):
        x, y = F.col("x") + shift, F.col("y") + shift
        return S.line((x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y))

    first, far = F.array(box(8, 0), box(2, 1)), F.array(box(1, 20))
    broken = F.array(F.slice(box(8, 0), 1, 4))                     # an open ring
    shape = F.when(F.col("s_suppkey") % 5 == 0, F.array(broken)).when(F.col("s_suppkey") % 2 == 0, F.array(first, far)).otherwise(F.array(first))
    return view(spark, d, "supplier", _QUARTERS).select("s_suppkey", S.to_multipolygon_wkt(shape).alias("wkt"))
