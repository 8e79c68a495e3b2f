"""Municipality summaries, coverage and small report tables.

Everything is one conditional aggregation per input; groups are combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hazardgrid import fixed_values as V
from hazardgrid.functions.text import fill_unknown_label
from hazardgrid.operators.boundaries import tracts_touching_boundary
from hazardgrid.operators.filters import filter_period
from hazardgrid.operators.segments import complete_sum, count_where, severity_counts

SUMMARY_COUNTS = (
    "total_crashes", *(f"{s}_crashes" for s in V.SEVERITIES), "ped_crashes", "bike_crashes",
    "bike_involvement_unknown_crashes", "crashes_with_segments",
)


def _crash_measures() -> list[Column]:
    complete = F.lit(True)
    for c in V.CASUALTY_COLUMNS:
        complete = complete & (F.count(F.lit(1)) == F.count(c))
    return [
        F.count(F.lit(1)).alias("total_crashes"), *severity_counts(),
        count_where(F.col("ped_involved")).alias("ped_crashes"),
        count_where(F.col("bike_involved")).alias("bike_crashes"),
        count_where(F.col("bike_involved").isNull()).alias("bike_involvement_unknown_crashes"),
        *[complete_sum(c).alias(c) for c in V.CASUALTY_COLUMNS],
        complete.alias("casualty_counts_complete"),
        F.count("segment_id").alias("crashes_with_segments"),
    ]


def municipality_summary(crashes: DataFrame, munis: DataFrame, y1: int | None = None,
                         y2: int | None = None) -> DataFrame:
    """One row per municipality; without crashes the casualties stay unknown."""
    counted = filter_period(crashes, y1, y2).groupBy("muni_id").agg(*_crash_measures())
    return munis.select("muni_id").join(counted, "muni_id", "left").select(
        "muni_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in SUMMARY_COUNTS], *V.CASUALTY_COLUMNS,
        F.coalesce("casualty_counts_complete", F.lit(False)).alias("casualty_counts_complete"))


def severity_percentages(summary: DataFrame) -> DataFrame:
    """Count and share per severity, 0 when there are no crashes."""
    stack = ", ".join(f"'{s}', {s}_crashes" for s in V.SEVERITIES)
    return summary.select(
        "muni_id", "total_crashes", F.expr(f"stack({len(V.SEVERITIES)}, {stack}) AS (severity, crashes)"),
    ).withColumn("pct", F.when(F.col("total_crashes") > 0, F.col("crashes") / F.col("total_crashes") * 100).otherwise(0.0))


def svi_availability(tracts: DataFrame, munis: DataFrame) -> DataFrame:
    """Ranked tracts and their source years per municipality met."""
    met = tracts_touching_boundary(tracts, munis)
    joined = met.join(tracts.select("tract_id", "svi_percentile", "source_year"), "tract_id")
    counted = joined.groupBy("muni_id").agg(
        F.count("svi_percentile").alias("ranked_tracts"),
        F.sort_array(F.collect_set("source_year")).alias("svi_years"))
    return munis.select("muni_id").join(counted, "muni_id", "left").select(
        "muni_id", F.coalesce("ranked_tracts", F.lit(0)).alias("ranked_tracts"),
        (F.coalesce("ranked_tracts", F.lit(0)) > 0).alias("svi_available"),
        F.coalesce("svi_years", F.array().cast("array<int>")).alias("svi_years"))


def geocode_counts(crashes: DataFrame, y1: int | None = None, y2: int | None = None) -> DataFrame:
    """Crashes per location method; only a missing method becomes ``unknown``."""
    return filter_period(crashes, y1, y2).groupBy(
        "muni_id", F.coalesce("geocode_quality", F.lit("unknown")).alias("method")).agg(
        F.count(F.lit(1)).alias("crashes"))


def location_methods(crashes: DataFrame, y1: int | None = None, y2: int | None = None) -> DataFrame:
    """As :func:`geocode_counts` with blank methods unknown too."""
    return filter_period(crashes, y1, y2).groupBy(
        "muni_id", fill_unknown_label(F.col("geocode_quality")).alias("method")).agg(
        F.count(F.lit(1)).alias("crashes"))


def location_order(counts: DataFrame) -> DataFrame:
    return counts.orderBy("muni_id", F.desc("crashes"), "method")


def location_breakdown(counts: DataFrame) -> DataFrame:
    """The named methods plus everything else as ``other``."""
    return counts.groupBy(
        "muni_id", F.when(F.col("method").isin(*V.LOCATION_METHODS), F.col("method")).otherwise("other").alias("method"),
    ).agg(F.sum("crashes").alias("crashes"))


def dashboard_coverage(crashes: DataFrame, y1: int | None = None, y2: int | None = None) -> DataFrame:
    """Rows from the dashboard and how many of them carry conflicts.

    ``source_metadata`` is a struct with ``source, schema_version, conflicts``.
    """
    meta = F.col("source_metadata")
    ours = F.coalesce((meta["source"] == V.DASHBOARD_SOURCE)
                      & (meta["schema_version"] == V.DASHBOARD_SCHEMA_VERSION), F.lit(False))
    severity = F.arrays_overlap(meta["conflicts"], F.array(*[F.lit(c) for c in V.SEVERITY_CONFLICTS]))
    return filter_period(crashes, y1, y2).groupBy("muni_id").agg(
        F.count(F.lit(1)).alias("total_crashes"), count_where(ours).alias("dashboard_crashes"),
        count_where(ours & severity).alias("dashboard_severity_conflict_crashes"),
        count_where(ours & (F.size(meta["conflicts"]) > 0)).alias("dashboard_conflict_crashes"))


def crash_year() -> Column:
    return F.year("crash_date").alias("year")


def yearly_counts(crashes: DataFrame) -> DataFrame:
    """Loaded crashes per municipality and year."""
    return crashes.groupBy("muni_id", crash_year()).agg(F.count(F.lit(1)).alias("crashes"))


def coverage_by_year(crashes: DataFrame) -> DataFrame:
    """Available years and counts per municipality (one short array per row)."""
    pair = F.struct("year", "crashes")
    return yearly_counts(crashes).groupBy("muni_id").agg(
        F.sort_array(F.collect_list(pair)).alias("by_year"), F.sum("crashes").alias("total_crashes"),
    ).select(
        "muni_id", F.transform("by_year", lambda p: p["year"]).alias("available_years"),
        F.transform("by_year", lambda p: p["crashes"]).alias("crash_counts"), "total_crashes")


def missing_years(coverage: DataFrame, y1, y2) -> DataFrame:
    """Requested years without crashes and the count inside the range.

    ``y1``/``y2`` are years or Columns, so every municipality can ask for its own.
    """
    y1, y2 = (F.lit(y) if isinstance(y, int) else y for y in (y1, y2))
    wanted = F.sequence(y1, y2)
    pairs = F.arrays_zip("available_years", "crash_counts")
    inside = F.filter(pairs, lambda p: p["available_years"].between(y1, y2))
    return coverage.withColumn("missing_years", F.array_except(wanted, "available_years")).withColumn(
        "range_crashes", F.aggregate(inside, F.lit(0).cast("long"), lambda a, p: a + p["crash_counts"]))


def default_year_range(crashes: DataFrame) -> DataFrame:
    """Preferred span when complete, else the latest unbroken run of at most five years."""
    first, last = V.PREFERRED_YEARS
    years = yearly_counts(crashes).select("muni_id", "year")
    by_muni = Window.partitionBy("muni_id")       # a group is at most the calendar years
    runs = (
        years.withColumn("_island", F.col("year") - F.row_number().over(by_muni.orderBy("year")))
        .withColumn("_newest", F.max("year").over(by_muni))
        .withColumn("_latest", F.max("_island").over(by_muni))
    )
    return runs.groupBy("muni_id").agg(
        F.max("_newest").alias("_end"),
        F.min(F.when((F.col("_island") == F.col("_latest"))
                     & (F.col("_newest") - F.col("year") < V.MAX_DEFAULT_YEARS), F.col("year"))).alias("_start"),
        count_where(F.col("year").between(first, last)).alias("_preferred"),
    ).select(
        "muni_id",
        F.when(F.col("_preferred") == last - first + 1, F.lit(first)).otherwise(F.col("_start")).alias("start_year"),
        F.when(F.col("_preferred") == last - first + 1, F.lit(last)).otherwise(F.col("_end")).alias("end_year"))


def year_set_compare(left: DataFrame, right: DataFrame, key: str = "muni_id") -> DataFrame:
    """Equality and overlap of two year sets per key (columns ``years``)."""
    joined = left.select(key, F.col("years").alias("_l")).join(right.select(key, F.col("years").alias("_r")), key, "full")
    empty = F.array().cast("array<int>")
    a, b = F.coalesce("_l", empty), F.coalesce("_r", empty)
    return joined.select(
        key,
        ((F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)).alias("same_years"),
        F.sort_array(F.array_intersect(a, b)).alias("common_years"),
        F.sort_array(F.array_except(a, b)).alias("only_left"))


def municipality_detail(crashes: DataFrame, munis: DataFrame, roads: DataFrame, analyses: DataFrame) -> DataFrame:
    """Totals over the loaded span, road miles and the latest analysis."""
    summary = municipality_summary(crashes, munis).select("muni_id", "total_crashes", "total_killed", "total_injured")
    miles = roads.groupBy("muni_id").agg(F.sum("length_miles").alias("road_miles"))
    latest = analyses.groupBy("muni_id").agg(F.max("created_at").alias("latest_analysis"))
    return (
        munis.select("muni_id", "name", "county").join(summary, "muni_id").join(miles, "muni_id", "left")
        .join(latest, "muni_id", "left")
        .withColumn("road_miles", F.coalesce("road_miles", F.lit(0.0)))
        .withColumnsRenamed({"total_killed": "total_fatalities", "total_injured": "total_injuries"})
    )


def list_municipalities(munis: DataFrame) -> DataFrame:
    return munis.orderBy("name")


def class_distribution(roads: DataFrame) -> DataFrame:
    return roads.groupBy("road_class").agg(F.count(F.lit(1)).alias("roads"))


def county_year_coverage(crashes: DataFrame, munis: DataFrame) -> DataFrame:
    """Crashes and distinct municipalities per county and year."""
    return yearly_counts(crashes).join(munis.select("muni_id", "county"), "muni_id").groupBy("county", "year").agg(
        F.sum("crashes").alias("crashes"), F.count_distinct("muni_id").alias("municipalities"))


def feature_extent(points: DataFrame, lines: DataFrame) -> DataFrame:
    """Extent of all valid vertices of a point layer (lon, lat) and a path layer (pts)."""
    xy = points.select(F.col("lon").alias("x"), F.col("lat").alias("y")).unionByName(
        lines.select(F.explode("pts").alias("p")).select("p.x", "p.y"))
    valid = (F.abs("x") <= 180) & (F.abs("y") <= 90)
    return xy.filter(valid).agg(
        F.min("x").alias("min_lon"), F.min("y").alias("min_lat"),
        F.max("x").alias("max_lon"), F.max("y").alias("max_lat"))
