"""Filters, municipality summaries, evidence of stored results, freshness, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.screening import PERIOD, Y1, Y2, crashes, roads, tracts
from checks.views import view
from hazardgrid import fixed_values as V
from hazardgrid.functions import numbers as N
from hazardgrid.functions import spatial as S
from hazardgrid.functions import text as T
from hazardgrid.operators import evidence as E
from hazardgrid.operators import filters as D
from hazardgrid.operators import freshness as M
from hazardgrid.operators import segments as G
from hazardgrid.operators import summaries as U
from hazardgrid.sinks import exports as X

LIST = lambda c: F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",")


def cases(spark, d):
    return view(spark, d, "t_case")


def meta_cases(spark, d):
    """Stored crashes with dashboard metadata built from the view's marker columns."""
    kind = F.col("meta_kind")
    conflicts = (F.when(kind == 1, F.array(F.lit("rating_with_fatal_evidence"), F.lit("x")))
                 .when(kind == 2, F.array(F.lit("bicycle_flag"))).otherwise(F.array().cast("array<string>")))
    meta = F.when(F.col("meta_source").isNotNull(), F.struct(
        F.col("meta_source").alias("source"), F.lit(1).alias("schema_version"),
        F.struct(F.concat(F.lit("  "), "road_name", F.lit(" ")).alias("streetname"),
                 F.lit("Rain").alias("Weather Condition")).alias("raw"),
        conflicts.alias("conflicts"),
        F.struct(F.lit("src").alias("source_url"), F.lit(None).cast("string").alias("retrieved_at")).alias("provenance"),
        F.lit("dashboard_current").alias("location_method")))
    return cases(spark, d).withColumn("source_metadata", meta)


def munis(spark, d):
    return view(spark, d, "t_muni")


def muni_polygons(spark, d):
    return munis(spark, d).withColumn("rings", S.box_rings(
        F.col("x0"), F.col("y0"), F.col("x0") + 0.3, F.col("y0") + 0.4))


def results(spark, d):
    return view(spark, d, "t_result")


def analyses(spark, d):
    return view(spark, d, "t_analysis")


# --- filters -----------------------------------------------------------------------

@query("filter_period", f"SELECT crash_id, CAST(crash_date AS VARCHAR) AS crash_date FROM t_case WHERE {PERIOD}")
def filter_period(spark, d):
    return D.filter_period(cases(spark, d), Y1, Y2).select("crash_id", F.col("crash_date").cast("string").alias("crash_date"))


@query("filter_crashes", f"""SELECT crash_id FROM t_case
WHERE muni_id = 7 AND severity = 'minor_injury' AND ped_involved AND bike_involved AND {PERIOD}""")
def filter_crashes(spark, d):
    return D.filter_crashes(cases(spark, d), muni_id=7, y1=Y1, y2=Y2, severity="minor_injury",
                            ped_only=True, bike_only=True).select("crash_id")


@query("filter_hin_type", """SELECT hin_id, 'general' AS kind FROM t_result WHERE is_significant
UNION ALL SELECT hin_id, 'pedestrian' FROM t_result WHERE is_significant AND is_ped_hin
UNION ALL SELECT hin_id, 'bicycle' FROM t_result WHERE is_significant AND is_bike_hin""")
def filter_hin_type(spark, d):
    r = results(spark, d)
    out = None
    for kind in ("general", "pedestrian", "bicycle"):
        one = D.filter_hin_type(r, kind).select("hin_id", F.lit(kind).alias("kind"))
        out = one if out is None else out.unionByName(one)
    return out


@query("filter_county_like", "SELECT muni_id, county FROM t_muni WHERE county ILIKE '%meri%'")
def filter_county_like(spark, d):
    return D.filter_county_like(munis(spark, d), "meri").select("muni_id", "county")


@query("filter_bounds", """SELECT crash_id FROM t_crash
WHERE lon BETWEEN -75.6 AND -73.9 AND lat BETWEEN 38.9 AND 39.5""")
def filter_bounds(spark, d):
    return D.filter_bounds(crashes(spark, d), (-75.6, 38.9, -73.9, 39.5)).select("crash_id")


@query("filter_year_range", """SELECT id_cr, CAST(year AS BIGINT) BETWEEN 2019 AND 2023 AS kept, count(*) AS n FROM t_dash GROUP BY 1, 2""")
def filter_year_range(spark, d):
    kept, excluded = D.filter_year_range(view(spark, d, "t_dash"), 2019, 2023, "year")
    return kept.select("id_cr", F.lit(True).alias("kept")).unionByName(
        excluded.select("id_cr", F.lit(False).alias("kept"))).groupBy("id_cr", "kept").agg(F.count("*").alias("n"))


_OSM = """SELECT p_partkey, CASE p_size % 11 WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk' WHEN 2 THEN 'primary' WHEN 3 THEN 'secondary'
 WHEN 4 THEN 'tertiary' WHEN 5 THEN 'residential' WHEN 6 THEN 'unclassified' WHEN 7 THEN 'living_street'
 WHEN 8 THEN 'footway' WHEN 9 THEN 'path' ELSE NULL END AS highway FROM part"""


@query("filter_road_types", f"""SELECT p_partkey, highway FROM ({_OSM}) r WHERE highway IN
 ('motorway','trunk','primary','secondary','tertiary','residential','unclassified','living_street')""")
def filter_road_types(spark, d):
    return D.filter_road_types(view(spark, d, "part", _OSM))


@query("osm_road_class", f"""SELECT p_partkey, CASE WHEN highway IN ('motorway','trunk','primary') THEN 'arterial'
 WHEN highway IN ('secondary','tertiary') THEN 'collector' ELSE 'local' END AS road_class FROM ({_OSM}) r""")
def osm_road_class(spark, d):
    from hazardgrid.operators.validation import classify_osm_roads
    return classify_osm_roads(view(spark, d, "part", _OSM)).select("p_partkey", "road_class")


@query("filter_eligible_segments", "SELECT segment_id FROM t_road WHERE length_miles >= 0.01")
def filter_eligible_segments(spark, d):
    return D.filter_eligible_segments(view(spark, d, "t_road")).select("segment_id")


_POINTS = """SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN CAST('NaN' AS DOUBLE) ELSE c_acctbal / 10 - 300 END AS lon,
 CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal / 50 - 80 END AS lat FROM customer"""


@query("valid_map_points", f"""SELECT c_custkey FROM ({_POINTS}) p
WHERE NOT isnan(lon) AND abs(lon) <= 180 AND abs(lat) <= 90""")
def valid_map_points(spark, d):
    return D.valid_map_points(view(spark, d, "customer", _POINTS)).select("c_custkey")


# --- segment-level aggregates --------------------------------------------------------
_SEV = ", ".join(f"count(CASE WHEN severity = '{s}' THEN 1 END) AS {s}_crashes" for s in V.SEVERITIES)


@query("segment_crash_stats", f"""SELECT segment_id, count(*) AS total_crashes, {_SEV},
 count(CASE WHEN ped_involved THEN 1 END) AS ped_crashes, count(CASE WHEN bike_involved THEN 1 END) AS bike_crashes,
 CAST(sum(CASE severity WHEN 'fatal' THEN 10 WHEN 'serious_injury' THEN 5 WHEN 'minor_injury' THEN 3
   WHEN 'possible_injury' THEN 3 WHEN 'property_damage' THEN 1 ELSE 1 END) AS BIGINT) AS severity_score
FROM t_case WHERE {PERIOD} AND segment_id IS NOT NULL GROUP BY segment_id""")
def segment_crash_stats(spark, d):
    return G.segment_crash_stats(cases(spark, d), Y1, Y2)


@query("segment_stats_stored", f"""SELECT r.muni_id, r.segment_id, r.length_miles, r.road_class, count(c.crash_id) AS total_crashes,
 {", ".join(f"count(CASE WHEN c.severity = '{s}' THEN 1 END) AS {s}_crashes" for s in V.SEVERITIES if s != "injury_unknown")},
 count(CASE WHEN c.ped_involved THEN 1 END) AS ped_crashes, count(CASE WHEN c.bike_involved THEN 1 END) AS bike_crashes,
 CAST(COALESCE(sum(CASE c.severity WHEN 'fatal' THEN 10 WHEN 'serious_injury' THEN 5 WHEN 'minor_injury' THEN 3
   WHEN 'possible_injury' THEN 3 WHEN 'injury_unknown' THEN 3 WHEN 'property_damage' THEN 1
   ELSE CASE WHEN c.crash_id IS NULL THEN 0 ELSE 1 END END), 0) AS BIGINT) AS severity_score
FROM t_road r LEFT JOIN t_case c ON c.segment_id = r.segment_id AND {PERIOD.replace("crash_date", "c.crash_date")}
GROUP BY 1, 2, 3, 4""")
def segment_stats_stored(spark, d):
    return G.segment_stats(view(spark, d, "t_road"), cases(spark, d), Y1, Y2)


@query("severity_weight", """SELECT severity, CASE severity WHEN 'fatal' THEN 10 WHEN 'serious_injury' THEN 5 WHEN 'minor_injury' THEN 3
 WHEN 'possible_injury' THEN 3 WHEN 'property_damage' THEN 1 ELSE 1 END AS weight,
 CASE WHEN severity = 'towed' THEN 'other' ELSE severity END AS category, count(*) AS crashes FROM t_case GROUP BY 1, 2, 3""")
def severity_weight(spark, d):
    return cases(spark, d).groupBy(
        "severity", T.severity_weight(F.col("severity")).alias("weight"),
        T.severity_category(F.col("severity")).alias("category")).agg(F.count("*").alias("crashes"))


@query("rate_band", """SELECT hin_id, CASE WHEN crash_rate > 10 THEN 'high' WHEN crash_rate > 5 THEN 'medium' ELSE 'low' END AS band FROM t_result""")
def rate_band(spark, d):
    return results(spark, d).select("hin_id", T.rate_band(F.col("crash_rate")).alias("band"))


@query("share_pct", """SELECT hin_id, CASE WHEN crash_count_fatal = 0 THEN NULL
 ELSE round(100.0 * crash_count_total / crash_count_fatal, 6) END AS pct FROM t_result""")
def share_pct(spark, d):
    return results(spark, d).select("hin_id", F.round(
        N.share_pct(F.col("crash_count_total"), F.col("crash_count_fatal")), 6).alias("pct"))


# --- municipality summaries ---------------------------------------------------------
_CAS = ", ".join(f"CASE WHEN count(*) = count({c}) THEN CAST(sum({c}) AS BIGINT) END AS {c}" for c in V.CASUALTY_COLUMNS)
_SUMMARY = f"""SELECT muni_id, count(*) AS total_crashes, {_SEV}, count(CASE WHEN ped_involved THEN 1 END) AS ped_crashes,
 count(CASE WHEN bike_involved THEN 1 END) AS bike_crashes,
 count(CASE WHEN bike_involved IS NULL THEN 1 END) AS bike_involvement_unknown_crashes, {_CAS},
 {" AND ".join(f"count(*) = count({c})" for c in V.CASUALTY_COLUMNS)} AS casualty_counts_complete,
 count(segment_id) AS crashes_with_segments FROM t_case WHERE {PERIOD} GROUP BY muni_id"""
_FILLED = ", ".join([f"COALESCE(s.{c}, 0) AS {c}" for c in U.SUMMARY_COUNTS] + [f"s.{c}" for c in V.CASUALTY_COLUMNS])


@query("municipality_summary", f"""SELECT m.muni_id, {_FILLED}, COALESCE(s.casualty_counts_complete, FALSE) AS casualty_counts_complete
FROM t_muni m LEFT JOIN ({_SUMMARY}) s ON s.muni_id = m.muni_id""")
def municipality_summary(spark, d):
    return U.municipality_summary(cases(spark, d), munis(spark, d), Y1, Y2)


@query("severity_percentages", f"""SELECT muni_id, total_crashes, severity, crashes, round(100 * crashes / total_crashes + 1e-10, 8) AS pct FROM (
 {" UNION ALL ".join(f"SELECT muni_id, count(*) AS total_crashes, '{s}' AS severity, count(CASE WHEN severity = '{s}' THEN 1 END) AS crashes FROM t_case WHERE {PERIOD} GROUP BY muni_id" for s in V.SEVERITIES)}) p""")
def severity_percentages(spark, d):
    return U.severity_percentages(municipality_summary(spark, d)).withColumn("pct", F.round(F.col("pct") + 1e-10, 8))


@query("geocode_counts", f"""SELECT muni_id, COALESCE(geocode_quality, 'unknown') AS method, count(*) AS crashes
FROM t_case WHERE {PERIOD} GROUP BY 1, 2""")
def geocode_counts(spark, d):
    return U.geocode_counts(cases(spark, d), Y1, Y2)


@query("fill_unknown_label", f"""SELECT muni_id, COALESCE(NULLIF(trim(geocode_quality), ''), 'unknown') AS method, count(*) AS crashes
FROM t_case WHERE {PERIOD} GROUP BY 1, 2""")
def fill_unknown_label(spark, d):
    return U.location_methods(cases(spark, d), Y1, Y2)


@query("location_order", f"""SELECT muni_id, COALESCE(NULLIF(trim(geocode_quality), ''), 'unknown') AS method, count(*) AS crashes
FROM t_case WHERE {PERIOD} GROUP BY 1, 2 ORDER BY muni_id, crashes DESC, method""")
def location_order(spark, d):
    return U.location_order(fill_unknown_label(spark, d))


@query("location_breakdown", f"""SELECT muni_id, CASE WHEN geocode_quality IN ('reported', 'route_milepost', 'dashboard_current', 'dashboard_calculated')
 THEN geocode_quality ELSE 'other' END AS method, count(*) AS crashes FROM t_case WHERE {PERIOD} GROUP BY 1, 2""")
def location_breakdown(spark, d):
    return U.location_breakdown(geocode_counts(spark, d))


@query("dashboard_coverage", f"""SELECT muni_id, count(*) AS total_crashes,
 count(CASE WHEN meta_source = 'njdot_dashboard' THEN 1 END) AS dashboard_crashes,
 count(CASE WHEN meta_source = 'njdot_dashboard' AND meta_kind = 1 THEN 1 END) AS dashboard_severity_conflict_crashes,
 count(CASE WHEN meta_source = 'njdot_dashboard' AND meta_kind IN (1, 2) THEN 1 END) AS dashboard_conflict_crashes
FROM t_case WHERE {PERIOD} GROUP BY muni_id""")
def dashboard_coverage(spark, d):
    return U.dashboard_coverage(meta_cases(spark, d), Y1, Y2)


@query("dashboard_details", """SELECT crash_id, CASE WHEN o THEN 'NJDOT dashboard' END AS source_name, CASE WHEN o THEN dashboard_id END AS dashboard_id,
 CASE WHEN o THEN trim(road_name) END AS source_street_name, CASE WHEN o THEN 'Rain' END AS weather,
 CASE WHEN o THEN 'dashboard_current' END AS location_method, CASE WHEN o THEN meta_kind = 1 END AS severity_conflict,
 CASE WHEN o THEN meta_kind IN (1, 2) END AS source_conflict
FROM (SELECT *, meta_source = 'njdot_dashboard' AS o FROM t_case) t""")
def dashboard_details(spark, d):
    from hazardgrid.operators.validation import dashboard_details as details
    return details(meta_cases(spark, d)).select(
        "crash_id", "source_name", "dashboard_id", "source_street_name", "weather", "location_method",
        "severity_conflict", "source_conflict")


_YEARS = "SELECT muni_id, CAST(year(crash_date) AS INT) AS year, count(*) AS n FROM t_case GROUP BY 1, 2"


@query("coverage_by_year", f"""SELECT muni_id, string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) AS available_years,
 string_agg(CAST(n AS VARCHAR), ',' ORDER BY year) AS crash_counts, CAST(sum(n) AS BIGINT) AS total_crashes FROM ({_YEARS}) y GROUP BY muni_id""")
def coverage_by_year(spark, d):
    return U.coverage_by_year(cases(spark, d)).withColumns({"available_years": LIST("available_years"), "crash_counts": LIST("crash_counts")})


@query("missing_years", f"""SELECT m.muni_id, (SELECT string_agg(CAST(g AS VARCHAR), ',' ORDER BY g) FROM range(1993, 2004) t(g)
   WHERE g NOT IN (SELECT year FROM ({_YEARS}) y WHERE y.muni_id = m.muni_id)) AS missing_years,
 (SELECT CAST(COALESCE(sum(n), 0) AS BIGINT) FROM ({_YEARS}) y WHERE y.muni_id = m.muni_id AND year BETWEEN 1993 AND 2003) AS range_crashes
FROM t_muni m""")
def missing_years(spark, d):
    return U.missing_years(U.coverage_by_year(cases(spark, d)), 1993, 2003).select(
        "muni_id", LIST("missing_years").alias("missing_years"), "range_crashes")


_SPAN = "(SELECT * FROM t_case WHERE year(crash_date) + muni_id % 3 <> 1998 AND (muni_id % 2 = 0 OR year(crash_date) < 2000))"


@query("default_year_range", f"""WITH y AS (SELECT DISTINCT muni_id, CAST(year(crash_date) AS INT) AS year FROM {_SPAN} c),
i AS (SELECT muni_id, year, year - row_number() OVER (PARTITION BY muni_id ORDER BY year) AS island, max(year) OVER (PARTITION BY muni_id) AS top FROM y),
l AS (SELECT muni_id, max(island) AS island FROM i GROUP BY muni_id)
SELECT i.muni_id, CAST(min(year) AS INT) AS start_year, CAST(max(top) AS INT) AS end_year FROM i JOIN l ON l.muni_id = i.muni_id AND l.island = i.island
WHERE top - year < 5 GROUP BY i.muni_id""")
def default_year_range(spark, d):
    return U.default_year_range(view(spark, d, "t_case", f"SELECT * FROM {_SPAN} c"))


@query("year_set_compare", f"""SELECT a.muni_id, a.y = b.y AS same_years, array_to_string(list_sort(list_intersect(a.y, b.y)), ',') AS common_years FROM
 (SELECT muni_id, list_sort(list(DISTINCT CAST(year(crash_date) AS INT))) AS y FROM t_case GROUP BY muni_id) a JOIN
 (SELECT muni_id, list_sort(list(DISTINCT CAST(year(crash_date) AS INT))) AS y FROM {_SPAN} c GROUP BY muni_id) b USING (muni_id)""")
def year_set_compare(spark, d):
    def years(df):
        return U.coverage_by_year(df).select("muni_id", F.col("available_years").alias("years"))
    some = view(spark, d, "t_case", f"SELECT * FROM {_SPAN} c")
    return U.year_set_compare(years(cases(spark, d)), years(some)).select("muni_id", "same_years", LIST("common_years").alias("common_years"))


_DETAIL_TOTALS = """SELECT muni_id, count(*) AS n, CASE WHEN count(*) = count(total_killed) THEN CAST(sum(total_killed) AS BIGINT) END AS k,
 CASE WHEN count(*) = count(total_injured) THEN CAST(sum(total_injured) AS BIGINT) END AS i FROM t_case GROUP BY muni_id"""


@query("municipality_detail", f"""SELECT m.muni_id, m.name, m.county, c.n AS total_crashes, c.k AS total_fatalities, c.i AS total_injuries,
 round(r.miles, 6) AS road_miles, a.latest_analysis FROM t_muni m JOIN ({_DETAIL_TOTALS}) c USING (muni_id)
JOIN (SELECT muni_id, sum(length_miles) AS miles FROM t_road GROUP BY muni_id) r USING (muni_id)
LEFT JOIN (SELECT muni_id, max(CAST(end_year AS VARCHAR) || '-07-01') AS latest_analysis FROM t_analysis GROUP BY muni_id) a USING (muni_id)""")
def municipality_detail(spark, d):
    runs = analyses(spark, d).withColumn("created_at", F.concat(F.col("end_year").cast("string"), F.lit("-07-01")))
    return U.municipality_detail(cases(spark, d), munis(spark, d), view(spark, d, "t_road"), runs).withColumn(
        "road_miles", F.round("road_miles", 6))


@query("list_municipalities", "SELECT muni_id, name, county FROM t_muni ORDER BY name")
def list_municipalities(spark, d):
    return U.list_municipalities(munis(spark, d).select("muni_id", "name", "county"))


@query("class_distribution", "SELECT road_class, count(*) AS roads FROM t_road GROUP BY road_class")
def class_distribution(spark, d):
    return U.class_distribution(view(spark, d, "t_road"))


@query("county_year_coverage", """SELECT county, CAST(year(crash_date) AS INT) AS year, count(*) AS crashes, count(DISTINCT muni_id) AS municipalities
FROM t_case JOIN t_muni USING (muni_id) GROUP BY 1, 2""")
def county_year_coverage(spark, d):
    return U.county_year_coverage(cases(spark, d), munis(spark, d))


@query("svi_availability", """SELECT m.muni_id, count(t.svi_percentile) AS ranked_tracts, count(t.svi_percentile) > 0 AS svi_available,
 COALESCE(array_to_string(list_sort(list(DISTINCT t.source_year) FILTER (WHERE t.source_year IS NOT NULL)), ','), '') AS svi_years
FROM t_muni m LEFT JOIN t_tract t ON t.tx0 <= m.x0 + 0.3 AND t.tx1 >= m.x0 AND t.ty0 <= m.y0 + 0.4 AND t.ty1 >= m.y0 GROUP BY m.muni_id""")
def svi_availability(spark, d):
    return U.svi_availability(tracts(spark, d), muni_polygons(spark, d)).withColumn("svi_years", LIST("svi_years"))


@query("feature_extent", """SELECT round(least(min(lon), min(x1), min(x2)), 9) AS min_lon, round(least(min(lat), min(y)), 9) AS min_lat,
 round(greatest(max(lon), max(x1), max(x2)), 9) AS max_lon, round(greatest(max(lat), max(y)), 9) AS max_lat
FROM (SELECT lon, lat FROM t_crash) c, (SELECT min(x1) x1, max(x2) x2, min(y) y FROM t_road UNION ALL SELECT max(x1), min(x2), max(y) FROM t_road) r""")
def feature_extent(spark, d):
    e = U.feature_extent(crashes(spark, d), roads(spark, d))
    return e.select(*[F.round(c, 9).alias(c) for c in e.columns])


# --- evidence of stored results --------------------------------------------------------
PICK = """
p_pick AS (SELECT * FROM (
  SELECT h.*, r.length_miles, r.road_name, a.muni_id, row_number() OVER (PARTITION BY h.analysis_id, h.segment_id ORDER BY hin_id DESC) AS rn
  FROM t_result h JOIN t_road r USING (segment_id) JOIN t_analysis a ON a.analysis_id = h.analysis_id AND a.muni_id = r.muni_id
  WHERE h.is_significant) q WHERE rn = 1)"""


def selected(spark, d):
    return E.latest_result_per_segment(results(spark, d), view(spark, d, "t_road"), analyses(spark, d))


@query("hin_join_roads", "SELECT h.hin_id, r.road_name, r.length_miles FROM t_result h JOIN t_road r USING (segment_id)")
def hin_join_roads(spark, d):
    return E.hin_join_roads(results(spark, d), view(spark, d, "t_road")).select("hin_id", "road_name", "length_miles")


@query("latest_result_per_segment", f"WITH {PICK} SELECT analysis_id, segment_id, hin_id, crash_rate FROM p_pick")
def latest_result_per_segment(spark, d):
    return selected(spark, d).select("analysis_id", "segment_id", "hin_id", "crash_rate")


@query("top_segments_stored", f"""WITH {PICK} SELECT analysis_id, segment_id, crash_rate, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY crash_rate DESC, segment_id) AS rank FROM p_pick) t WHERE rank <= 10""")
def top_segments_stored(spark, d):
    return E.top_segments(selected(spark, d)).select("analysis_id", "segment_id", "crash_rate", "rank")


@query("flag_membership", f"""WITH {PICK} SELECT crash_id,
 EXISTS (SELECT 1 FROM p_pick p WHERE p.segment_id = c.segment_id AND p.muni_id = c.muni_id) AS selected,
 EXISTS (SELECT 1 FROM t_road r WHERE r.segment_id = c.segment_id AND r.muni_id = c.muni_id) AS assigned FROM t_case c""")
def flag_membership(spark, d):
    return E.flag_membership(cases(spark, d), selected(spark, d), view(spark, d, "t_road")).select("crash_id", "selected", "assigned")


_NUM = {"loaded_road_miles", "eligible_road_miles", "selected_miles", "known_miles", "high_vulnerability_miles", "unknown_miles",
        "road_share_pct", "crash_share_pct", "assigned_share_pct"}


@query("network_totals", f"""WITH {PICK},
r AS (SELECT muni_id, sum(length_miles) AS loaded_road_miles, sum(CASE WHEN length_miles >= 0.01 THEN length_miles END) AS eligible_road_miles FROM t_road GROUP BY 1),
n AS (SELECT muni_id, sum(length_miles) AS selected_miles, count(*) AS selected_segments,
  COALESCE(sum(CASE WHEN in_vulnerable_tract IS NOT NULL THEN length_miles END), 0) AS known_miles,
  COALESCE(sum(CASE WHEN in_vulnerable_tract THEN length_miles END), 0) AS high_vulnerability_miles,
  COALESCE(sum(CASE WHEN in_vulnerable_tract IS NULL THEN length_miles END), 0) AS unknown_miles,
  count(in_vulnerable_tract) AS known_segments, count(*) - count(in_vulnerable_tract) AS unknown_segments FROM p_pick GROUP BY 1),
f AS (SELECT c.*, p.segment_id IS NOT NULL AS sel FROM t_case c LEFT JOIN p_pick p ON p.segment_id = c.segment_id AND p.muni_id = c.muni_id WHERE {PERIOD}),
k AS (SELECT muni_id, count(*) AS loaded_crashes, count(segment_id) AS assigned_crashes, count(CASE WHEN sel THEN 1 END) AS selected_crashes,
  count(CASE WHEN sel AND severity = 'fatal' THEN 1 END) AS selected_fatal_crashes,
  count(CASE WHEN sel AND severity = 'serious_injury' THEN 1 END) AS selected_serious_injury_crashes,
  count(CASE WHEN sel AND severity = 'possible_injury' THEN 1 END) AS selected_possible_injury_crashes,
  CASE WHEN count(CASE WHEN sel THEN total_killed END) = count(CASE WHEN sel THEN 1 END) THEN CAST(sum(CASE WHEN sel THEN total_killed END) AS BIGINT) END AS selected_killed,
  CASE WHEN count(CASE WHEN sel THEN total_injured END) = count(CASE WHEN sel THEN 1 END) THEN CAST(sum(CASE WHEN sel THEN total_injured END) AS BIGINT) END AS selected_injured
  FROM f GROUP BY 1)
SELECT muni_id, round(loaded_road_miles + 1e-10, 8) AS loaded_road_miles, round(eligible_road_miles + 1e-10, 8) AS eligible_road_miles,
 round(selected_miles + 1e-10, 8) AS selected_miles, selected_segments, round(known_miles + 1e-10, 8) AS known_miles,
 round(high_vulnerability_miles + 1e-10, 8) AS high_vulnerability_miles, round(unknown_miles + 1e-10, 8) AS unknown_miles, known_segments, unknown_segments,
 loaded_crashes, assigned_crashes, selected_crashes, selected_fatal_crashes, selected_serious_injury_crashes, selected_possible_injury_crashes,
 selected_killed, selected_injured, round(100 * selected_miles / eligible_road_miles + 1e-10, 8) AS road_share_pct,
 round(100 * selected_crashes / loaded_crashes + 1e-10, 8) AS crash_share_pct, round(100 * selected_crashes / assigned_crashes + 1e-10, 8) AS assigned_share_pct
FROM r JOIN n USING (muni_id) JOIN k USING (muni_id)""")
def network_totals(spark, d):
    df = E.network_totals(cases(spark, d), selected(spark, d), view(spark, d, "t_road"), Y1, Y2)
    return df.withColumns({c: F.round(F.col(c) + 1e-10, 8) for c in _NUM})


@query("annual_evidence", """WITH cal AS (SELECT muni_id, CAST(g AS INT) AS year FROM t_muni, range(1993, 1998) t(g)),
c AS (SELECT muni_id, CAST(year(crash_date) AS INT) AS year, count(*) AS total_crashes,
  count(CASE WHEN severity = 'fatal' THEN 1 END) AS fatal_crashes, count(CASE WHEN severity = 'serious_injury' THEN 1 END) AS serious_injury_crashes,
  count(CASE WHEN severity = 'possible_injury' THEN 1 END) AS possible_injury_crashes, count(CASE WHEN severity = 'injury_unknown' THEN 1 END) AS injury_unknown_crashes,
  count(CASE WHEN ped_involved THEN 1 END) AS ped_crashes, count(CASE WHEN bike_involved THEN 1 END) AS bike_crashes,
  count(CASE WHEN bike_involved IS NULL THEN 1 END) AS bike_unknown,
  CASE WHEN count(*) = count(total_killed) THEN CAST(sum(total_killed) AS BIGINT) END AS total_killed,
  CASE WHEN count(*) = count(total_injured) THEN CAST(sum(total_injured) AS BIGINT) END AS total_injured FROM t_case GROUP BY 1, 2)
SELECT muni_id, year, COALESCE(total_crashes, 0) AS total_crashes, COALESCE(fatal_crashes, 0) AS fatal_crashes,
 COALESCE(serious_injury_crashes, 0) AS serious_injury_crashes, COALESCE(possible_injury_crashes, 0) AS possible_injury_crashes,
 COALESCE(injury_unknown_crashes, 0) AS injury_unknown_crashes, COALESCE(ped_crashes, 0) AS ped_crashes, COALESCE(bike_crashes, 0) AS bike_crashes,
 COALESCE(bike_unknown, 0) AS bike_unknown, total_killed, total_injured FROM cal LEFT JOIN c USING (muni_id, year)""")
def annual_evidence(spark, d):
    return E.annual_evidence(cases(spark, d), munis(spark, d), 1993, 1997)


CORRIDORS = PICK + f""",
p_unk AS (SELECT segment_id, count(*) AS n FROM t_case WHERE {PERIOD} AND severity = 'injury_unknown' GROUP BY 1),
p_cor AS (SELECT p.analysis_id, corridor_id, min(COALESCE(NULLIF(trim(corridor_name), ''), NULLIF(trim(road_name), ''), 'Unnamed road')) AS name,
  count(*) AS segment_count, sum(length_miles) AS miles, CAST(COALESCE(sum(crash_count_total), 0) AS BIGINT) AS crashes,
  CAST(COALESCE(sum(crash_count_fatal), 0) AS BIGINT) AS fatal_crashes, CAST(COALESCE(sum(crash_count_serious_injury), 0) AS BIGINT) AS serious_injury_crashes,
  CAST(COALESCE(sum(crash_count_possible_injury), 0) AS BIGINT) AS possible_injury_crashes, CAST(COALESCE(sum(n), 0) AS BIGINT) AS injury_unknown_crashes,
  min(p.segment_id) AS first_segment_id
  FROM p_pick p LEFT JOIN p_unk u ON u.segment_id = p.segment_id
  GROUP BY p.analysis_id, corridor_id, CASE WHEN corridor_id IS NULL THEN p.segment_id END)"""


def corridors(spark, d):
    return E.corridor_evidence(selected(spark, d), cases(spark, d), Y1, Y2)


@query("corridor_evidence", f"""WITH {CORRIDORS} SELECT analysis_id, corridor_id, name, segment_count, round(miles + 1e-10, 8) AS miles, crashes, fatal_crashes,
 serious_injury_crashes, possible_injury_crashes, injury_unknown_crashes, first_segment_id, round(crashes / (miles * 4) + 1e-10, 8) AS rate FROM p_cor""")
def corridor_evidence(spark, d):
    return corridors(spark, d).withColumns({c: F.round(F.col(c) + 1e-10, 8) for c in ("miles", "rate")})


@query("corridor_members", f"""WITH {PICK} SELECT analysis_id, corridor_id, segment_id,
 min(segment_id) OVER (PARTITION BY analysis_id, corridor_id, CASE WHEN corridor_id IS NULL THEN segment_id END) AS first_segment_id FROM p_pick""")
def corridor_members(spark, d):
    return E.corridor_members(selected(spark, d))


@query("top_corridors", f"""WITH {CORRIDORS} SELECT analysis_id, corridor_id, first_segment_id, crashes, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY crashes DESC, corridor_id IS NULL, COALESCE(corridor_id, first_segment_id)) AS rank FROM p_cor) t
WHERE rank <= 10""")
def top_corridors(spark, d):
    return E.top_corridors(corridors(spark, d)).select("analysis_id", "corridor_id", "first_segment_id", "crashes", "rank")


@query("analysis_summary", """SELECT a.analysis_id, (SELECT count(*) FROM t_case c WHERE c.muni_id = a.muni_id AND year(crash_date) BETWEEN start_year AND end_year) AS total_crashes,
 (SELECT CASE WHEN count(*) = count(total_killed) THEN CAST(COALESCE(sum(total_killed), 0) AS BIGINT) END FROM t_case c WHERE c.muni_id = a.muni_id AND year(crash_date) BETWEEN start_year AND end_year) AS total_fatalities,
 (SELECT CASE WHEN count(*) = count(total_injured) THEN CAST(COALESCE(sum(total_injured), 0) AS BIGINT) END FROM t_case c WHERE c.muni_id = a.muni_id AND year(crash_date) BETWEEN start_year AND end_year) AS total_injuries,
 (SELECT count(*) FROM t_result h WHERE h.analysis_id = a.analysis_id AND is_significant) AS hin_segment_count,
 (SELECT round(COALESCE(sum(length_miles), 0) + 1e-10, 8) FROM t_result h JOIN t_road r USING (segment_id) WHERE h.analysis_id = a.analysis_id AND is_significant) AS hin_miles
FROM t_analysis a""")
def analysis_summary(spark, d):
    return E.analysis_summary(cases(spark, d), results(spark, d), view(spark, d, "t_road"), analyses(spark, d)).withColumn(
        "hin_miles", F.round(F.col("hin_miles") + 1e-10, 8))


@query("report_summary", f"""SELECT a.analysis_id, s.muni_id, s.total_crashes, s.fatal_crashes, s.total_killed, s.casualty_counts_complete,
 round(n.m + 1e-10, 8) AS hin_miles, n.k AS hin_corridors, round(n.v + 1e-10, 8) AS vulnerable_tract_percentage
FROM t_analysis a JOIN ({_SUMMARY}) s USING (muni_id) JOIN (
  SELECT analysis_id, sum(length_miles) AS m, count(DISTINCT NULLIF(corridor_id, 0)) AS k,
    100 * count(CASE WHEN in_vulnerable_tract THEN 1 END) / NULLIF(count(in_vulnerable_tract), 0) AS v
  FROM t_result JOIN t_road USING (segment_id) WHERE is_significant GROUP BY analysis_id) n ON n.analysis_id = a.analysis_id""")
def report_summary(spark, d):
    df = E.report_summary(cases(spark, d), munis(spark, d), results(spark, d), view(spark, d, "t_road"), analyses(spark, d), Y1, Y2)
    return df.select("analysis_id", "muni_id", "total_crashes", "fatal_crashes", "total_killed", "casualty_counts_complete",
                     F.round(F.col("hin_miles") + 1e-10, 8).alias("hin_miles"), "hin_corridors",
                     F.round(F.col("vulnerable_tract_percentage") + 1e-10, 8).alias("vulnerable_tract_percentage"))


@query("data_quality", f"""SELECT m.muni_id, 'count-poisson-v3' AS method_version,
 count(CASE WHEN severity = 'injury_unknown' THEN 1 END) = 0 AND count(CASE WHEN meta_source = 'njdot_dashboard' AND meta_kind = 1 THEN 1 END) = 0 AS injury_detail_available,
 count(CASE WHEN bike_involved IS NULL THEN 1 END) = 0 AS bicycle_data_available,
 {" AND ".join(f"count(*) = count({c})" for c in V.CASUALTY_COLUMNS)} AS casualty_counts_complete,
 count(CASE WHEN meta_source = 'njdot_dashboard' THEN 1 END) AS dashboard_crashes,
 count(CASE WHEN meta_source = 'njdot_dashboard' AND meta_kind IN (1, 2) THEN 1 END) AS dashboard_conflict_crashes
FROM t_muni m JOIN t_case c USING (muni_id) WHERE {PERIOD} GROUP BY m.muni_id""")
def data_quality(spark, d):
    return E.data_quality(meta_cases(spark, d), muni_polygons(spark, d), tracts(spark, d), Y1, Y2).select(
        "muni_id", "method_version", "injury_detail_available", "bicycle_data_available", "casualty_counts_complete",
        "dashboard_crashes", "dashboard_conflict_crashes")


@query("map_layers", f"""WITH {PICK},
p_top AS (SELECT segment_id, CAST(rank AS INT) AS label FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY crash_rate DESC, segment_id) AS rank FROM p_pick) t WHERE rank <= 10)
SELECT 'boundary' AS layer, muni_id, NULL AS segment_id, NULL AS label FROM t_muni
UNION ALL SELECT 'road', muni_id, segment_id, NULL FROM t_road
UNION ALL SELECT 'selected', r.muni_id, r.segment_id, t.label FROM t_road r JOIN (SELECT DISTINCT segment_id FROM p_pick) p USING (segment_id) LEFT JOIN p_top t USING (segment_id)""")
def map_layers(spark, d):
    shapes = roads(spark, d).withColumn("geometry", S.line_geojson(F.col("pts")))
    outlines = munis(spark, d).withColumn("geometry", S.point_geojson(F.col("x0"), F.col("y0")))
    return E.map_layers(selected(spark, d), shapes, outlines).drop("geometry")


# --- freshness -------------------------------------------------------------------------

@query("assess_freshness", f"""SELECT analysis_id, muni_id, CASE WHEN status <> 'completed' THEN 'ready' WHEN n = 0 THEN 'no_data'
  WHEN y < end_year - start_year + 1 THEN 'missing_years' WHEN muni_id % 9 = 4 THEN 'stale'
  WHEN input_version IS NULL OR input_version <> 'v1' THEN 'stale' ELSE 'ready' END AS data_status, n AS current_total_crashes
FROM (SELECT a.*, COALESCE(CAST(sum(CASE WHEN c.year BETWEEN start_year AND end_year THEN c.n END) AS BIGINT), 0) AS n,
    count(CASE WHEN c.year BETWEEN start_year AND end_year THEN 1 END) AS y FROM t_analysis a LEFT JOIN ({_YEARS}) c ON c.muni_id = a.muni_id GROUP BY ALL) t""")
def assess_freshness(spark, d):
    loaded = analyses(spark, d).join(U.yearly_counts(cases(spark, d)), "muni_id", "left").groupBy(
        "analysis_id", "muni_id", "start_year", "end_year", "status", "input_version").agg(F.coalesce(F.sum(F.when(
            F.col("year").between(F.col("start_year"), F.col("end_year")), F.col("crashes"))), F.lit(0)).alias("total_crashes"))
    stored = loaded.withColumn("total_crashes", F.col("total_crashes") + F.when(F.col("muni_id") % 9 == 4, 1).otherwise(0))
    return M.assess_freshness(stored, cases(spark, d), "v1").select("analysis_id", "muni_id", "data_status", "current_total_crashes")


@query("require_years", f"""SELECT muni_id, string_agg(CAST(g AS VARCHAR), ',' ORDER BY g) AS missing_years
FROM t_muni m, range(1994, 2003) t(g) WHERE g NOT IN (SELECT year FROM ({_YEARS}) y WHERE y.muni_id = m.muni_id) GROUP BY muni_id""")
def require_years(spark, d):
    return M.unavailable_years(cases(spark, d), munis(spark, d), 1994, 2002).select("muni_id", LIST("missing_years").alias("missing_years"))


@query("crash_counts_by_year", """SELECT year, before, after, year BETWEEN 1998 AND 1999 OR before = after AS allowed FROM (
 SELECT CAST(year(crash_date) AS INT) AS year, count(*) AS before, count(CASE WHEN year(crash_date) NOT IN (1997, 1999) OR muni_id <> 3 THEN 1 END) AS after
 FROM t_case GROUP BY 1) t""")
def crash_counts_by_year(spark, d):
    before = cases(spark, d)
    after = before.filter(~F.year("crash_date").isin(1997, 1999) | (F.col("muni_id") != 3))
    return M.crash_counts_by_year(before, after, (1998, 1999))


def _digest_sql(columns, dataset=None):
    values = " || ',' || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in sorted(columns))
    halves = " || '-' || ".join(f"CAST(coalesce(sum(CAST('0x' || substr(m, {at}, 15) AS BIGINT)), 0) AS VARCHAR)" for at in (1, 16))
    name = f"'{dataset}' AS dataset, " if dataset else ""
    return f"SELECT {name}count(*) AS rows, {halves} AS digest FROM (SELECT md5({values}) AS m FROM t_case) r"


_CASE_COLUMNS = ("crash_id", "muni_id", "segment_id", "crash_date", "severity", "ped_involved", "bike_involved", "total_killed")


@query("dataset_fingerprint", _digest_sql([c for c in _CASE_COLUMNS if c != "segment_id"], "crashes"))
def dataset_fingerprint(spark, d):
    columns = [c for c in _CASE_COLUMNS if c != "segment_id"]
    return M.dataset_fingerprint("crashes", cases(spark, d), columns)


@query("row_fingerprint", _digest_sql([c for c in _CASE_COLUMNS if c != "bike_involved"]))
def row_fingerprint(spark, d):
    return M.row_fingerprint(cases(spark, d).select(*_CASE_COLUMNS), exclude=("bike_involved",))


_LOADS = """SELECT p_brand, count(*) AS source_count, count(*) - CASE WHEN min(p_partkey) % 7 = 1 THEN 1 ELSE 0 END AS fetched,
 count(CASE WHEN p_size > 49 AND p_partkey % 5 = 0 THEN 1 END) AS rejected_features, count(CASE WHEN p_size = 1 AND p_partkey % 11 = 0 THEN 1 END) AS analysis_path_rejections,
 count(CASE WHEN p_size = 2 AND p_partkey % 13 = 0 THEN 1 END) AS reference_path_rejections, count(*) AS routes, count(*) AS analysis_segments,
 count(CASE WHEN p_size = 3 AND p_partkey % 17 = 0 THEN 1 END) AS paths_without_municipality FROM part GROUP BY p_brand"""


@query("network_coverage_flags", f"""SELECT p_brand, a AS analysis_coverage_complete, r AS reference_coverage_complete,
 NOT (a AND r) AND fetched = source_count AS partial_coverage_accepted, CASE WHEN (a AND r) OR fetched = source_count THEN 0 ELSE 3 END AS exit_code
FROM (SELECT *, fetched = source_count AND rejected_features = 0 AND analysis_path_rejections = 0 AND paths_without_municipality = 0 AS a,
  fetched = source_count AND rejected_features = 0 AND analysis_path_rejections = 0 AND reference_path_rejections = 0 AS r FROM ({_LOADS}) l) t""")
def network_coverage_flags(spark, d):
    return M.network_coverage_flags(view(spark, d, "part", _LOADS), allow_partial=True).select(
        "p_brand", "analysis_coverage_complete", "reference_coverage_complete", "partial_coverage_accepted", "exit_code")


# --- exports ---------------------------------------------------------------------------

def export_cases(spark, d):
    return meta_cases(spark, d).withColumn("lon", F.col("segment_id") / 1000.0).withColumn("lat", F.lit(40.5))


@query("export_csv_crashes", f"""SELECT crash_id, CAST(crash_date AS VARCHAR) AS date, severity, ped_involved, bike_involved, total_killed,
 CASE WHEN ltrim(road_name)[1] IN ('=', '+', '-', '@') THEN '''' || road_name ELSE road_name END AS road_name, geocode_quality, segment_id / 1000 AS longitude
FROM t_case WHERE {PERIOD}""")
def export_csv_crashes(spark, d):
    features = X.crash_features(export_cases(spark, d), y1=Y1, y2=Y2)
    return X.export_csv(features, "crashes").select(
        "crash_id", "date", "severity", "ped_involved", "bike_involved", "total_killed", "road_name", "geocode_quality", "longitude")


@query("export_csv_segments", """SELECT hin_id, segment_id, r.road_name, crash_count_total AS crash_count, crash_rate, severity_score, corridor_name,
 in_vulnerable_tract, crash_count_possible_injury FROM t_result h JOIN t_road r USING (segment_id) WHERE is_significant""")
def export_csv_segments(spark, d):
    return X.export_csv(X.hin_features(results(spark, d), roads(spark, d)), "hin_segments")


@query("csv_formula_guard", """SELECT crash_id, CASE WHEN ltrim(road_name)[1] IN ('=', '+', '-', '@') THEN '''' || road_name ELSE road_name END AS cell FROM t_case""")
def csv_formula_guard(spark, d):
    return cases(spark, d).select("crash_id", T.csv_formula_guard(F.col("road_name")).alias("cell"))


@query("crash_geojson", f"""SELECT crash_id, CAST(crash_date AS VARCHAR) AS date, severity, CAST(ped_involved AS VARCHAR) AS ped_involved, CAST(bike_involved AS VARCHAR) AS bike_involved, total_killed, road_name, geocode_quality,
 dashboard_id IS NOT NULL AS dashboard, segment_id / 1000 AS lon, 40.5::DOUBLE AS lat FROM t_case WHERE {PERIOD} AND ped_involved""")
def crash_geojson(spark, d):
    f = X.crash_geojson(export_cases(spark, d), y1=Y1, y2=Y2, ped_only=True)
    p = lambda name: F.get_json_object("feature", f"$.properties.{name}")
    at = lambda i: F.get_json_object("feature", f"$.geometry.coordinates[{i}]").try_cast("double")
    return f.select("crash_id", *[p(c).alias(c) for c in ("date", "severity", "ped_involved", "bike_involved", "road_name", "geocode_quality")],
                    p("total_killed").try_cast("int").alias("total_killed"), p("source_name").isNotNull().alias("dashboard"), at(0).alias("lon"), at(1).alias("lat"))


@query("hin_geojson", """SELECT h.hin_id, h.segment_id, r.road_name, h.crash_rate, round(x2, 6) AS end_lon
FROM t_result h JOIN t_road r USING (segment_id) WHERE is_significant AND is_ped_hin""")
def hin_geojson(spark, d):
    f = X.hin_geojson(results(spark, d), roads(spark, d), "pedestrian")
    p = lambda name: F.get_json_object("feature", f"$.{name}")
    return f.select("hin_id", p("properties.segment_id").cast("long").alias("segment_id"), p("properties.road_name").alias("road_name"),
                    p("properties.crash_rate").cast("double").alias("crash_rate"),
                    F.round(p("geometry.coordinates[1][0]").cast("double"), 6).alias("end_lon"))
