"""Registered queries against their oracles on the small tables, and plan checks."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from checks import screening
from checks.compare import compare
from checks.views import BASE_TABLES

SF = "/root/testdata/sf0.001"
# A spread over all operator families; `python -m checks.compare` runs every query.
NAMES = (
    "segment_stats_stored", "municipality_summary", "annual_evidence", "network_totals", "corridor_evidence", "top_corridors",
    "coverage_by_year", "default_year_range", "assess_freshness", "export_csv_crashes", "hin_geojson", "prepare_crash", "match_municipality",
    "validate_export", "upsert_crashes", "enrich_bicycle", "incompatible_changes", "parse_road_feature", "normalize_svi", "vulnerability_index",
    "first_intersecting_tract", "endpoint_adjacency", "collapse_route_points", "standardize_legacy_crashes",
)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, name):
    assert compare(spark, con, name, SF, entry.queries(), entry.oracle_sql()).startswith("ok")


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 130
    assert entry.entry(spark).columns[:2] == ["muni_id", "segment_id"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_period_filter_reaches_the_scan_and_columns_are_pruned(spark, tmp_path):
    from hazardgrid.operators.filters import filter_period
    stored = screening.view(spark, SF, "t_case")
    stored.write.parquet(str(tmp_path / "c"))
    text = plan(filter_period(spark.read.parquet(str(tmp_path / "c")), 1996, 1999).select("crash_id"))
    assert "GreaterThanOrEqual(crash_date" in text and "LessThan(crash_date" in text
    schema = re.search(r"ReadSchema: (struct<.*?>)", text).group(1)
    assert "severity" not in schema


def test_snapping_shuffles_crashes_at_most_once_and_runs_no_python(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = screening.crashes(spark, SF)
        base = plan(stored).count("Exchange hashpartitioning")
        text = plan(screening.N.snap_crashes(stored, screening.roads(spark, SF)))
        roads = plan(screening.roads(spark, SF)).count("Exchange hashpartitioning")
        # One for the crashes, two to build the index on top of what the road view needs.
        assert text.count("Exchange hashpartitioning") == base + roads + 3
        assert "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
