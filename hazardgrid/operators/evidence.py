"""Report evidence of stored screening results, all analyses at once.

Stored results may repeat a segment; the newest wins and crash counts are never
multiplied by joining the raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hazardgrid import fixed_values as V
from hazardgrid.functions.numbers import share_pct
from hazardgrid.operators.filters import filter_period
from hazardgrid.operators.segments import complete_sum, count_where, severity_counts
from hazardgrid.operators.summaries import (
    crash_year, dashboard_coverage, geocode_counts, municipality_summary, svi_availability,
)


def hin_join_roads(results: DataFrame, roads: DataFrame) -> DataFrame:
    return results.join(roads.select("segment_id", "muni_id", "road_name", "sri", "length_miles"), "segment_id")


def latest_result_per_segment(results: DataFrame, roads: DataFrame, analyses: DataFrame) -> DataFrame:
    """Newest significant result per segment of the analysed municipality."""
    scoped = hin_join_roads(results.filter(F.col("is_significant")), roads).join(
        analyses.select("analysis_id", "muni_id"), ["analysis_id", "muni_id"])
    newest = F.max_by(F.struct(*[F.col(c) for c in scoped.columns]), "hin_id")
    return scoped.groupBy("analysis_id", "segment_id").agg(newest.alias("r")).select("r.*")


def top_segments(selected: DataFrame, k: int = 10, per: str | None = "analysis_id") -> DataFrame:
    """Highest crash rates, lowest segment id on a tie; per analysis or overall."""
    order = [F.desc("crash_rate"), F.asc("segment_id")]
    if per is None:
        return selected.orderBy(*order).limit(k)
    rank = F.row_number().over(Window.partitionBy(per).orderBy(*order))
    return selected.withColumn("rank", rank).filter(F.col("rank") <= k)


def flag_membership(crashes: DataFrame, selected: DataFrame, roads: DataFrame) -> DataFrame:
    """Add ``selected`` and ``assigned`` without multiplying crashes."""
    picked = selected.select("muni_id", "segment_id").distinct().withColumn("_s", F.lit(True))
    own = roads.select("muni_id", "segment_id").distinct().withColumn("_a", F.lit(True))
    marks = own.join(picked, ["muni_id", "segment_id"], "full")
    return crashes.join(marks, ["muni_id", "segment_id"], "left").withColumn(
        "selected", F.coalesce("_s", F.lit(False))).withColumn("assigned", F.coalesce("_a", F.lit(False))).drop("_s", "_a")


def network_totals(crashes: DataFrame, selected: DataFrame, roads: DataFrame, y1: int, y2: int) -> DataFrame:
    """Road, selection and crash totals with their shares, per municipality."""
    miles = F.col("length_miles")
    road_totals = roads.groupBy("muni_id").agg(
        F.sum("length_miles").alias("loaded_road_miles"),
        F.coalesce(F.sum(F.when(miles >= V.MIN_SEGMENT_MILES, miles)), F.lit(0.0)).alias("eligible_road_miles"))
    vulnerable = F.col("in_vulnerable_tract")

    def miles_where(test):
        return F.coalesce(F.sum(F.when(test, miles)), F.lit(0.0))

    network = selected.groupBy("muni_id").agg(
        F.sum("length_miles").alias("selected_miles"), F.count(F.lit(1)).alias("selected_segments"),
        miles_where(vulnerable.isNotNull()).alias("known_miles"),
        miles_where(vulnerable).alias("high_vulnerability_miles"),
        miles_where(vulnerable.isNull()).alias("unknown_miles"),
        count_where(vulnerable.isNotNull()).alias("known_segments"),
        count_where(vulnerable.isNull()).alias("unknown_segments"))
    picked = F.col("selected")
    flagged = flag_membership(filter_period(crashes, y1, y2), selected, roads)
    crash_totals = flagged.groupBy("muni_id").agg(
        F.count(F.lit(1)).alias("loaded_crashes"), count_where(F.col("assigned")).alias("assigned_crashes"),
        count_where(picked).alias("selected_crashes"),
        *[count_where(picked & (F.col("severity") == s)).alias(f"selected_{s}_crashes")
          for s in ("fatal", "serious_injury", "possible_injury")],
        complete_sum("total_killed", picked).alias("selected_killed"),
        complete_sum("total_injured", picked).alias("selected_injured"))
    joined = road_totals.join(network, "muni_id", "left").join(crash_totals, "muni_id", "left")
    unknown = ("selected_killed", "selected_injured")
    zero = [c for c in joined.columns if c not in ("muni_id", *unknown)]
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})
    return filled.withColumns({
        "road_share_pct": share_pct(F.col("selected_miles"), F.col("eligible_road_miles")),
        "crash_share_pct": share_pct(F.col("selected_crashes"), F.col("loaded_crashes")),
        "assigned_share_pct": share_pct(F.col("selected_crashes"), F.col("assigned_crashes")),
    })


ANNUAL_COUNTS = (
    "total_crashes", "fatal_crashes", "serious_injury_crashes", "possible_injury_crashes",
    "injury_unknown_crashes", "ped_crashes", "bike_crashes", "bike_unknown",
)


def annual_evidence(crashes: DataFrame, munis: DataFrame, y1: int, y2: int) -> DataFrame:
    """Per municipality and year; gap years have zero counts and unknown casualties."""
    counted = filter_period(crashes, y1, y2).groupBy("muni_id", crash_year()).agg(
        F.count(F.lit(1)).alias("total_crashes"),
        *severity_counts(("fatal", "serious_injury", "possible_injury", "injury_unknown")),
        complete_sum("total_killed").alias("total_killed"), complete_sum("total_injured").alias("total_injured"),
        count_where(F.col("ped_involved")).alias("ped_crashes"),
        count_where(F.col("bike_involved")).alias("bike_crashes"),
        count_where(F.col("bike_involved").isNull()).alias("bike_unknown"))
    calendar = munis.select("muni_id", F.explode(F.sequence(F.lit(y1), F.lit(y2))).alias("year"))
    return calendar.join(counted, ["muni_id", "year"], "left").select(
        "muni_id", "year", *[F.coalesce(c, F.lit(0)).alias(c) for c in ANNUAL_COUNTS], "total_killed", "total_injured")


def corridor_evidence(selected: DataFrame, crashes: DataFrame, y1: int, y2: int) -> DataFrame:
    """One row per corridor, or per segment without one.

    The member list is :func:`corridor_members`: rows instead of an array, so a
    corridor can have any number of segments.
    """
    unknown = filter_period(crashes, y1, y2).filter(
        (F.col("severity") == "injury_unknown") & F.col("segment_id").isNotNull(),
    ).groupBy("segment_id").agg(F.count(F.lit(1)).alias("_unknown"))
    label = F.coalesce(F.nullif(F.trim("corridor_name"), F.lit("")), F.nullif(F.trim("road_name"), F.lit("")), F.lit("Unnamed road"))

    def total(col):
        return F.coalesce(F.sum(col), F.lit(0)).cast("long")

    grouped = selected.join(unknown, "segment_id", "left").groupBy(
        "analysis_id", "corridor_id", F.when(F.col("corridor_id").isNull(), F.col("segment_id")).alias("_alone"),
    ).agg(
        F.min(label).alias("name"), F.count(F.lit(1)).alias("segment_count"), F.sum("length_miles").alias("miles"),
        total("crash_count_total").alias("crashes"), total("crash_count_fatal").alias("fatal_crashes"),
        total("crash_count_serious_injury").alias("serious_injury_crashes"),
        total("crash_count_possible_injury").alias("possible_injury_crashes"),
        total("_unknown").alias("injury_unknown_crashes"), F.min("segment_id").alias("first_segment_id"))
    return grouped.drop("_alone").withColumn("rate", F.try_divide(F.col("crashes"), F.col("miles") * (y2 - y1 + 1)))


def corridor_members(selected: DataFrame) -> DataFrame:
    """``analysis_id, first_segment_id, corridor_id, segment_id`` of every corridor member."""
    alone = F.when(F.col("corridor_id").isNull(), F.col("segment_id"))
    firsts = selected.groupBy("analysis_id", "corridor_id", alone.alias("_alone")).agg(F.min("segment_id").alias("first_segment_id"))
    left = selected.select("analysis_id", "corridor_id", "segment_id", alone.alias("_alone"))
    same = [left[c].eqNullSafe(firsts[c]) for c in ("corridor_id", "_alone")]
    return left.join(firsts, [left["analysis_id"] == firsts["analysis_id"], *same]).select(
        left["analysis_id"], "first_segment_id", left["corridor_id"], "segment_id")


def top_corridors(corridors: DataFrame, k: int = 10) -> DataFrame:
    """Most crashes first, corridors before single segments, then the lower id."""
    order = [F.desc("crashes"), F.col("corridor_id").isNull(), F.coalesce(F.col("corridor_id").cast("long"), "first_segment_id")]
    rank = F.row_number().over(Window.partitionBy("analysis_id").orderBy(*order))
    return corridors.withColumn("rank", rank).filter(F.col("rank") <= k)


def analysis_summary(crashes: DataFrame, results: DataFrame, roads: DataFrame, analyses: DataFrame) -> DataFrame:
    """Crash totals and significant network size of every analysis and its period."""
    asked = analyses.select("analysis_id", "muni_id", "start_year", "end_year")
    # Yearly partials first: the crash table is read once, whatever the periods.
    yearly = crashes.groupBy("muni_id", crash_year()).agg(
        F.count(F.lit(1)).alias("n"), F.count("total_killed").alias("nk"), F.count("total_injured").alias("ni"),
        F.sum("total_killed").alias("k"), F.sum("total_injured").alias("i"))
    inside = F.col("year").between(F.col("start_year"), F.col("end_year"))
    totals = asked.join(yearly, "muni_id", "left").groupBy("analysis_id").agg(*[
        F.coalesce(F.sum(F.when(inside, F.col(c))), F.lit(0)).alias(c) for c in ("n", "nk", "ni", "k", "i")])
    network = results.filter(F.col("is_significant")).join(roads.select("segment_id", "length_miles"), "segment_id").groupBy(
        "analysis_id").agg(F.count(F.lit(1)).alias("hin_segment_count"), F.sum("length_miles").alias("hin_miles"))
    return totals.join(network, "analysis_id", "left").select(
        "analysis_id", F.col("n").alias("total_crashes"),
        F.when(F.col("nk") == F.col("n"), F.col("k")).alias("total_fatalities"),
        F.when(F.col("ni") == F.col("n"), F.col("i")).alias("total_injuries"),
        F.coalesce("hin_segment_count", F.lit(0)).alias("hin_segment_count"),
        F.coalesce("hin_miles", F.lit(0.0)).alias("hin_miles"))


def report_summary(crashes: DataFrame, munis: DataFrame, results: DataFrame, roads: DataFrame,
                   analyses: DataFrame, y1: int, y2: int) -> DataFrame:
    """Municipality summary plus network miles, corridors and the vulnerable share.

    The share is taken over segments with a known classification only.
    """
    picked = results.filter(F.col("is_significant")).join(roads.select("segment_id", "length_miles"), "segment_id")
    known = F.col("in_vulnerable_tract").isNotNull()
    network = picked.groupBy("analysis_id").agg(
        F.sum("length_miles").alias("hin_miles"),
        F.count_distinct(F.when(F.col("corridor_id") != 0, F.col("corridor_id"))).alias("hin_corridors"),
        share_pct(count_where(F.col("in_vulnerable_tract")), count_where(known)).alias("vulnerable_tract_percentage"))
    return (
        analyses.select("analysis_id", "muni_id").join(municipality_summary(crashes, munis, y1, y2), "muni_id")
        .join(network, "analysis_id", "left")
        .withColumn("hin_miles", F.coalesce("hin_miles", F.lit(0.0)))
        .withColumn("hin_corridors", F.coalesce("hin_corridors", F.lit(0)))
    )


def data_quality(crashes: DataFrame, munis: DataFrame, tracts: DataFrame, y1: int, y2: int) -> DataFrame:
    """What the loaded records can and cannot say, per municipality."""
    summary = municipality_summary(crashes, munis, y1, y2)
    sources = dashboard_coverage(crashes, y1, y2).drop("total_crashes")
    methods = geocode_counts(crashes, y1, y2).groupBy("muni_id").agg(
        F.sort_array(F.collect_list(F.struct("method", "crashes"))).alias("geocode_counts"))
    svi = svi_availability(tracts, munis).drop("ranked_tracts")
    joined = summary.join(sources, "muni_id", "left").join(methods, "muni_id", "left").join(svi, "muni_id", "left")
    ours, severity, conflicts = (F.coalesce(c, F.lit(0)) for c in (
        "dashboard_crashes", "dashboard_severity_conflict_crashes", "dashboard_conflict_crashes"))
    return joined.select(
        "muni_id", F.lit(V.METHOD_VERSION).alias("method_version"),
        ((F.col("injury_unknown_crashes") == 0) & (severity == 0)).alias("injury_detail_available"),
        (F.col("bike_involvement_unknown_crashes") == 0).alias("bicycle_data_available"),
        "casualty_counts_complete", "svi_available", "svi_years", "geocode_counts",
        ours.alias("dashboard_crashes"), conflicts.alias("dashboard_conflict_crashes"),
        F.when(ours > 0, F.lit(V.DASHBOARD_NOTE)).alias("dashboard_note"), F.lit(V.COVERAGE_NOTE).alias("coverage_note"))


def map_layers(selected: DataFrame, roads: DataFrame, munis: DataFrame, k: int = 10) -> DataFrame:
    """Rows to draw: boundary, every road, each selected segment with its rank label.

    ``roads`` and ``munis`` carry their geometry as GeoJSON text in ``geometry``.
    """
    ranked = top_segments(selected, k).select("segment_id", F.col("rank").alias("label"))
    chosen = selected.select("segment_id").distinct().join(ranked, "segment_id", "left")
    boundary = munis.select(F.lit("boundary").alias("layer"), "muni_id", F.lit(None).cast("long").alias("segment_id"),
                            F.lit(None).cast("int").alias("label"), "geometry")
    lines = roads.select(F.lit("road").alias("layer"), "muni_id", "segment_id", F.lit(None).cast("int").alias("label"), "geometry")
    picks = roads.join(chosen, "segment_id").select(F.lit("selected").alias("layer"), "muni_id", "segment_id", "label", "geometry")
    return boundary.unionByName(lines).unionByName(picks)
