"""Input views over the supplied tables; the same SQL text runs in Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    "t_muni": """
SELECT CAST(n_nationkey AS INT) AS muni_id, n_name AS name, r_name AS county,
       CAST(-75.5 + 0.3 * (n_nationkey % 5) AS DOUBLE) AS x0,
       CAST(39.0 + 0.4 * FLOOR(n_nationkey / 5) AS DOUBLE) AS y0
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "t_road": """
SELECT CAST(p.p_partkey + 1 AS BIGINT) AS segment_id, m.muni_id,
       CASE WHEN rr % 5 = 0 THEN NULL
            ELSE CONCAT('R', CAST(m.muni_id AS STRING), '_', CAST(rr AS STRING)) END AS sri,
       CONCAT('Route ', CAST(rr AS STRING)) AS road_name,
       CASE p_size % 4 WHEN 0 THEN 'arterial' WHEN 1 THEN 'collector' WHEN 2 THEN 'local'
            ELSE 'unclassified' END AS road_class,
       CASE WHEN p_size % 17 = 0 THEN CAST(0.005 AS DOUBLE)
            ELSE CAST(0.05 AS DOUBLE) + CAST(p_size AS DOUBLE) / CAST(500 AS DOUBLE) END AS length_miles,
       m.x0 + CAST(0.01 AS DOUBLE) + CAST(0.0019 AS DOUBLE) * ii
            + CASE WHEN ii = 3 THEN CAST(0.00003 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS x1,
       m.x0 + CAST(0.01 AS DOUBLE) + CAST(0.0019 AS DOUBLE) * (ii + 1) AS x2,
       m.y0 + CAST(0.01 AS DOUBLE) + CAST(0.0019 AS DOUBLE) * rr AS y
FROM (SELECT *, CAST(FLOOR(FLOOR(p_partkey / 25) / 4) AS INT) AS rr,
                CAST(FLOOR(p_partkey / 25) AS INT) % 4 AS ii FROM part) p
JOIN t_muni m ON m.muni_id = p.p_partkey % 25""",
    # Crashes with coordinates, not yet assigned to a segment.
    "t_crash": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, r.muni_id,
       CONCAT(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-',
              CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS crash_id,
       CAST(l_shipdate AS DATE) AS crash_date,
       CASE WHEN l_quantity >= 50 THEN 'fatal' WHEN l_quantity >= 47 THEN 'serious_injury'
            WHEN l_quantity >= 40 THEN 'minor_injury' WHEN l_quantity >= 32 THEN 'possible_injury'
            WHEN l_quantity >= 26 THEN 'injury_unknown' ELSE 'property_damage' END AS severity,
       l_tax >= CAST(0.07 AS DOUBLE) AS ped_involved,
       CASE WHEN l_discount = CAST(0.05 AS DOUBLE) THEN NULL
            ELSE l_discount >= CAST(0.09 AS DOUBLE) END AS bike_involved,
       CASE WHEN l_suppkey % 11 = 0 THEN NULL WHEN l_quantity >= 50 THEN 1 ELSE 0 END AS total_killed,
       r.x1 + (r.x2 - r.x1) * l_quantity / CAST(50 AS DOUBLE) AS lon,
       r.y + ((l_suppkey % 13) - 6) * CAST(0.0001 AS DOUBLE) AS lat
FROM lineitem JOIN t_road r ON r.segment_id = l_partkey + 1""",
    # Crashes as stored: assigned to a segment or not, with casualties and ids.
    "t_case": """
SELECT CONCAT(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-',
              CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS crash_id,
       CAST(l_partkey % 25 AS INT) AS muni_id,
       CASE WHEN l_suppkey % 9 = 4 THEN NULL ELSE CAST(l_partkey + 1 AS BIGINT) END AS segment_id,
       CAST(l_shipdate AS DATE) AS crash_date,
       CASE WHEN l_quantity >= 50 THEN 'fatal' WHEN l_quantity >= 47 THEN 'serious_injury'
            WHEN l_quantity >= 40 THEN 'minor_injury' WHEN l_quantity >= 32 THEN 'possible_injury'
            WHEN l_quantity >= 26 THEN 'injury_unknown' WHEN l_quantity = 7 THEN 'towed'
            ELSE 'property_damage' END AS severity,
       l_tax >= CAST(0.07 AS DOUBLE) AS ped_involved,
       CASE WHEN l_discount = CAST(0.05 AS DOUBLE) AND l_partkey % 2 = 0 THEN NULL
            ELSE l_discount >= CAST(0.09 AS DOUBLE) END AS bike_involved,
       CASE WHEN l_partkey % 25 = 3 AND l_suppkey % 11 = 0 THEN NULL
            WHEN l_quantity >= 50 THEN 1 ELSE 0 END AS total_killed,
       CASE WHEN l_partkey % 5 = 1 AND l_suppkey % 7 = 0 THEN NULL
            ELSE CAST(l_linenumber % 3 AS INT) END AS total_injured,
       CASE WHEN l_quantity >= 50 AND l_tax >= CAST(0.07 AS DOUBLE) THEN 1 ELSE 0 END AS pedestrians_killed,
       CASE WHEN l_partkey % 25 = 8 AND l_linenumber = 7 THEN NULL ELSE 0 END AS pedestrians_injured,
       CASE l_suppkey % 6 WHEN 0 THEN 'reported' WHEN 1 THEN 'route_milepost'
            WHEN 2 THEN 'dashboard_current' WHEN 3 THEN ' ' WHEN 4 THEN NULL
            ELSE 'manual' END AS geocode_quality,
       CASE WHEN l_linenumber % 4 = 0 THEN NULL
            ELSE CONCAT(' =Road ', CAST(l_partkey % 40 AS STRING)) END AS road_name,
       CASE WHEN l_suppkey % 8 = 1 THEN CONCAT('D', CAST(l_orderkey AS STRING), '-',
              CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING)) ELSE NULL END AS dashboard_id,
       CASE l_suppkey % 8 WHEN 1 THEN 'njdot_dashboard' WHEN 2 THEN 'other' ELSE NULL END AS meta_source,
       CASE WHEN l_suppkey % 8 = 1 THEN l_linenumber % 4 ELSE 0 END AS meta_kind
FROM lineitem""",
    "t_tract": """
SELECT CONCAT('34', LPAD(CAST(s_suppkey AS STRING), 9, '0')) AS tract_id, m.muni_id,
       CASE WHEN s_suppkey % 10 = 3 THEN NULL
            ELSE ROUND((s_acctbal + CAST(1000 AS DOUBLE)) / CAST(110 AS DOUBLE), 4) END AS svi_percentile,
       m.x0 AS tx0, m.x0 + CAST(0.3 AS DOUBLE) AS tx1,
       m.y0 + CAST(0.004 AS DOUBLE) * FLOOR(s_suppkey / 25) AS ty0,
       m.y0 + CAST(0.004 AS DOUBLE) * (FLOOR(s_suppkey / 25) + 10) AS ty1,
       CASE WHEN s_suppkey % 6 = 5 THEN NULL ELSE CAST(2018 + s_suppkey % 3 AS INT) END AS source_year
FROM supplier JOIN t_muni m ON m.muni_id = s_suppkey % 25""",
    # Stored screening results: duplicates, unselected rows, missing corridors.
    "t_result": """
SELECT CAST(p_partkey * 2 + dup AS BIGINT) AS hin_id,
       CASE WHEN p_partkey % 11 = 5 THEN 2000 ELSE 1000 END + CAST(p_partkey % 25 AS INT) AS analysis_id,
       CAST(p_partkey + 1 AS BIGINT) AS segment_id,
       (p_size + dup) % 3 <> 0 AS is_significant,
       (p_size + dup) % 3 <> 0 AND p_size % 2 = 0 AS is_ped_hin,
       (p_size + dup) % 3 <> 0 AND p_size % 5 = 0 AS is_bike_hin,
       CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(FLOOR(p_partkey / 100) AS INT) END AS corridor_id,
       CASE WHEN p_size % 4 = 0 OR p_size % 9 = 1 THEN NULL
            ELSE CONCAT('Corridor ', p_brand) END AS corridor_name,
       CAST(p_size + dup AS INT) AS crash_count_total,
       CAST(p_size % 3 AS INT) AS crash_count_fatal,
       CAST(p_size % 4 AS INT) AS crash_count_serious_injury,
       CASE WHEN p_size % 6 = 0 THEN NULL ELSE CAST(p_size % 5 AS INT) END AS crash_count_possible_injury,
       CAST(p_size * 3 AS INT) AS severity_score,
       CAST(p_size AS DOUBLE) / CAST(4 AS DOUBLE) AS crash_rate,
       CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN TRUE ELSE FALSE END AS in_vulnerable_tract
FROM (SELECT *, 0 AS dup FROM part UNION ALL SELECT *, 1 AS dup FROM part WHERE p_partkey % 7 = 0) p""",
    "t_analysis": """
SELECT 1000 + CAST(n_nationkey AS INT) AS analysis_id, CAST(n_nationkey AS INT) AS muni_id,
       CASE WHEN n_nationkey % 6 = 2 THEN 1993 ELSE 1996 END AS start_year,
       CASE WHEN n_nationkey % 6 = 3 THEN 2002 ELSE 1999 END AS end_year,
       CASE WHEN n_nationkey % 7 = 1 THEN 'running' ELSE 'completed' END AS status,
       CASE WHEN n_nationkey % 8 = 5 THEN NULL WHEN n_nationkey % 8 = 6 THEN 'v0' ELSE 'v1' END AS input_version
FROM nation""",
    # Raw archive rows (text as published), dirty by modulus.
    "t_archive": """
SELECT CONCAT('file', CAST(o_orderkey % 7 AS STRING)) AS archive,
       CAST(o_orderkey AS BIGINT) AS line,
       CASE WHEN o_orderkey % 97 = 0 THEN ' '
            WHEN o_orderkey % 31 = 0 THEN CONCAT('2022', LPAD(CAST(o_orderkey AS STRING), 44, '7'))
            ELSE CONCAT('2022-', CAST(FLOOR(o_orderkey / 2) AS BIGINT)) END AS id,
       CASE o_custkey % 23 WHEN 0 THEN 'cape may' WHEN 1 THEN 'Nowhere' WHEN 2 THEN ' MERCER '
            WHEN 3 THEN 'Essex' ELSE 'Mercer' END AS county_name,
       CASE o_custkey % 9 WHEN 0 THEN 'West Windsor Twp' WHEN 1 THEN 'princeton boro.' WHEN 2 THEN 'Orange City'
            WHEN 3 THEN '..' WHEN 4 THEN 'Lower Alloways Crk Twp' ELSE CONCAT('Nation ', CAST(o_custkey % 25 AS STRING)) END AS municipality_name,
       CASE WHEN o_orderkey % 41 = 0 THEN '13/14/2022' WHEN o_orderkey % 43 = 0 THEN '2022-03-14'
            WHEN o_orderkey % 37 = 0 THEN '3/4/2021'
            ELSE CONCAT(CAST(1 + o_orderkey % 12 AS STRING), '/', LPAD(CAST(1 + o_orderkey % 28 AS STRING), 2, '0'), '/2022') END AS crash_date,
       CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE '0815' END AS crash_time,
       CASE o_orderstatus WHEN 'F' THEN 'f' WHEN 'O' THEN 'I' WHEN 'P' THEN ' P ' ELSE 'X' END AS severity,
       CASE WHEN o_orderkey % 53 = 0 THEN 'many' WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_orderkey % 2 AS STRING) END AS total_killed,
       CASE WHEN o_orderkey % 59 = 0 THEN '-1' ELSE CAST(o_orderkey % 4 AS STRING) END AS total_injured,
       CASE WHEN o_orderkey % 61 = 0 THEN '1.5' WHEN o_orderkey % 3 = 0 THEN '1' ELSE '0' END AS pedestrians_killed,
       CASE WHEN o_orderkey % 67 = 0 THEN 'x' WHEN o_orderkey % 4 = 0 THEN '' ELSE '0' END AS pedestrians_injured,
       CASE WHEN o_orderkey % 4 = 1 THEN '' ELSE ' US 1 ' END AS crash_location,
       'RT 9' AS route,
       CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE CONCAT(' r', CAST(o_custkey % 25 AS STRING), '_', CAST(o_orderkey % 8 AS STRING)) END AS sri_std_rte_identifier,
       CASE WHEN o_orderkey % 29 = 0 THEN 'abc' WHEN o_orderkey % 11 = 0 THEN '' ELSE CAST(CAST(o_orderkey % 400 AS DOUBLE) / 1000 AS STRING) END AS milepost,
       CASE WHEN o_orderkey % 14 = 0 THEN '' WHEN o_orderkey % 17 = 0 THEN 'north' WHEN o_orderkey % 19 = 0 THEN '10.5'
            ELSE CAST(39.0 + CAST(o_custkey % 200 AS DOUBLE) / 100 AS STRING) END AS latitude,
       CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN CAST(74.0 + CAST(o_custkey % 140 AS DOUBLE) / 100 AS STRING)
            ELSE CAST(-74.0 - CAST(o_custkey % 140 AS DOUBLE) / 100 AS STRING) END AS longitude,
       'DAYLIGHT' AS light_condition
FROM orders""",
    # Municipality labels that the archive rows are matched against.
    "t_label": """
SELECT CAST(n_nationkey AS INT) AS muni_id,
       CASE WHEN n_nationkey = 24 THEN 'nation  23' ELSE CONCAT('Nation ', CAST(n_nationkey AS STRING)) END AS name,
       CASE WHEN n_nationkey % 5 = 4 THEN 'ESSEX' ELSE 'Mercer' END AS county,
       CASE WHEN n_nationkey = 7 THEN '' WHEN n_nationkey = 8 THEN '12345'
            ELSE CONCAT(' ', CAST(1100 + n_nationkey AS STRING)) END AS muni_code
FROM nation""",
    # Raw dashboard rows (text as exported), dirty by modulus.
    "t_dash": """
SELECT CAST(o_orderkey AS BIGINT) AS line, CASE WHEN o_orderkey % 101 = 0 THEN 'x1' WHEN o_orderkey % 13 = 0 THEN CAST(CAST(FLOOR(o_orderkey / 26) * 26 AS BIGINT) AS STRING)
            ELSE CAST(o_orderkey AS STRING) END AS id_cr,
       CASE WHEN o_orderkey % 71 = 0 THEN ' ' WHEN o_orderkey % 17 = 0 THEN 'AB-17' ELSE CONCAT('AB-', CAST(o_orderkey AS STRING)) END AS casenumber,
       CASE WHEN o_custkey % 5 = 4 THEN 'Essex' WHEN o_custkey % 103 = 0 THEN 'Atlantis' ELSE 'Mercer' END AS county,
       CASE WHEN o_orderkey % 47 = 0 THEN CONCAT('Nation ', CAST(o_custkey % 25 AS STRING), ', Camden')
            WHEN o_orderkey % 2 = 0 THEN CONCAT('Nation ', CAST(o_custkey % 25 AS STRING), CASE WHEN o_custkey % 5 = 4 THEN ', Essex' ELSE ', Mercer' END)
            ELSE CONCAT('Nation ', CAST(o_custkey % 25 AS STRING)) END AS municipality,
       CASE WHEN o_orderkey % 83 = 0 THEN '2022-13-01'
            ELSE CONCAT(CAST(2018 + o_orderkey % 8 AS STRING), '-', LPAD(CAST(1 + o_orderkey % 12 AS STRING), 2, '0'), '-', LPAD(CAST(1 + o_orderkey % 28 AS STRING), 2, '0')) END AS dateofcrash,
       CASE WHEN o_orderkey % 79 = 0 THEN '2001' ELSE CAST(2018 + o_orderkey % 8 AS STRING) END AS year,
       CASE WHEN o_orderkey % 73 = 0 THEN 'soon' WHEN o_orderkey % 89 = 0 THEN '2022-01-31T09:15:00.000' WHEN o_orderkey % 3 = 0 THEN ''
            ELSE CONCAT(CAST(2018 + o_orderkey % 8 AS STRING), '-', LPAD(CAST(1 + o_orderkey % 12 AS STRING), 2, '0'), '-', LPAD(CAST(1 + o_orderkey % 28 AS STRING), 2, '0'), 'T09:15:00.000') END AS crash_at,
       CASE o_custkey % 9 WHEN 0 THEN 'Fatal Injury (K)' WHEN 1 THEN 'Suspected Serious Injury (A)' WHEN 2 THEN 'B' WHEN 3 THEN 'Possible Injury (C)'
            WHEN 4 THEN 'No Apparent Injury (O)' WHEN 5 THEN 'Unknown' WHEN 6 THEN '' ELSE 'O' END AS rating,
       CASE o_custkey % 7 WHEN 0 THEN '["Pedestrian Involved", "Total Crashes"]' WHEN 1 THEN 'Injury Crashes' WHEN 2 THEN ''
            WHEN 3 THEN '["Bicyclist Involved"]' WHEN 4 THEN CASE WHEN o_orderkey % 107 = 0 THEN '[broken' ELSE '[]' END ELSE '["Total Crashes"]' END AS summary,
       CASE WHEN o_orderkey % 109 = 0 THEN 'two' WHEN o_custkey % 9 = 0 THEN CAST(o_orderkey % 2 AS STRING) WHEN o_orderkey % 23 = 0 THEN '1' WHEN o_orderkey % 6 = 5 THEN '' ELSE '0' END AS fatalitycount,
       CASE WHEN o_orderkey % 113 = 0 THEN '-1' WHEN o_orderkey % 6 = 4 THEN '' ELSE CAST(o_orderkey % 3 AS STRING) END AS injurycount,
       CASE WHEN o_orderkey % 33 = 0 THEN '2' ELSE '0' END AS pedestrianfatalitycount,
       CASE WHEN o_orderkey % 35 = 0 THEN '3' ELSE '' END AS pedestrianinjurycount,
       CASE WHEN o_orderkey % 27 = 0 THEN '1' ELSE '0' END AS crashfatalitycount,
       CASE WHEN o_orderkey % 63 = 0 THEN 'y' ELSE 'N' END AS fatalcrashind,
       CASE WHEN o_custkey % 31 = 0 THEN 'Pedestrian' ELSE 'Rear End' END AS crash_type,
       CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN '{"lon":-80,"lat":40}'
            ELSE CONCAT('{"lon":"', CAST(ROUND(CAST(-75.5 + 0.3 * (o_custkey % 5) + 0.01 * (o_orderkey % 40) AS DOUBLE), 2) AS STRING), '","lat":', CAST(ROUND(CAST(39.0 + 0.4 * FLOOR((o_custkey % 25) / 5) + 0.02 AS DOUBLE), 2) AS STRING), '}') END AS geopoint,
       CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE CONCAT('{"lon":', CAST(ROUND(CAST(-75.5 + 0.3 * (o_custkey % 5) + 0.02 AS DOUBLE), 2) AS STRING), ',"lat":', CAST(ROUND(CAST(39.0 + 0.4 * FLOOR((o_custkey % 25) / 5) + 0.03 AS DOUBLE), 2) AS STRING), '}') END AS geopoint_calculated,
       CASE WHEN o_orderkey % 10 = 0 THEN '40.2' ELSE '' END AS latitude,
       CASE WHEN o_orderkey % 10 = 0 THEN '-74.6' ELSE '' END AS longitude,
       CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ' Main St ' END AS streetname,
       '0000000011__' AS streetsri, 'Clear' AS weather
FROM orders""",
    # Measured routes: one path per (municipality, route), measure = miles so far.
    "t_route": """
SELECT muni_id, rr, CONCAT('R', CAST(muni_id AS STRING), '_', CAST(rr AS STRING)) AS sri,
       CONCAT('NJDOT:', CAST(muni_id * 100000 + rr AS STRING), ':0') AS source_id, x_start, x_end, y,
       CAST(0 AS DOUBLE) AS mp_start, CAST(0.5 AS DOUBLE) AS mp_end
FROM (SELECT muni_id, CAST(FLOOR(FLOOR((segment_id - 1) / 25) / 4) AS INT) AS rr,
             MIN(x1) AS x_start, MAX(x2) AS x_end, MIN(y) AS y
      FROM t_road GROUP BY muni_id, CAST(FLOOR(FLOOR((segment_id - 1) / 25) / 4) AS INT))""",
}


def _needed(sql: str) -> list[str]:
    wanted: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.add(name)
                visit(VIEWS[name])
    visit(sql)
    return [name for name in VIEWS if name in wanted]


def with_views(sql: str) -> str:
    """``sql`` with the views it mentions put in front as common table expressions."""
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in _needed(sql)]
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        rest = body[5:]
        recursive = rest[:10].upper() == "RECURSIVE "
        rest = rest[10:] if recursive else rest
        head = "WITH RECURSIVE " if recursive else "WITH "
        return head + ",\n".join(parts + [rest]) if parts else body
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


_SCHEMAS: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table; its schema is read from the file once."""
    path = f"{sf_dir}/{name}.parquet"
    key = (path, name)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def view(spark: SparkSession, sf_dir: str, name: str, sql: str | None = None) -> DataFrame:
    """A view (or a select over views) as a DataFrame."""
    text = with_views(sql or f"SELECT * FROM {name}")
    for base in BASE_TABLES:
        if re.search(rf"\b{base}\b", text):
            table(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(text)
