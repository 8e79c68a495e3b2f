"""The network screening as one composed plan over all municipalities at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from hazardgrid import fixed_values as V
from hazardgrid.operators import segments as G
from hazardgrid.operators import snapping as N
from hazardgrid.operators.corridors import group_corridors
from hazardgrid.operators.equity import equity_overlay
from hazardgrid.operators.freshness import dataset_fingerprint, input_version, require_years
from hazardgrid.operators.summaries import municipality_summary
from hazardgrid.session import cut_lineage


def screen_segments(crashes: DataFrame, roads: DataFrame, y1: int, y2: int, *,
                    distance_m: float = V.SNAP_DISTANCE_M,
                    alpha: float = V.SIGNIFICANCE_THRESHOLD) -> DataFrame:
    """Snap, count, compare and test: one row per segment with a length."""
    if y1 > y2:
        raise ValueError("start year must not exceed end year")
    years = y2 - y1 + 1
    snapped = N.snap_crashes(crashes, roads, distance_m=distance_m)
    # The baseline aggregates the statistics and joins them back.  Cutting here, at one
    # row per segment, keeps the crashes from being snapped a second time for that.
    stats = cut_lineage(G.segment_stats(roads, snapped, y1, y2))
    return G.poisson_screen(G.leave_one_out_baseline(stats, years), years, alpha)


@dataclass(frozen=True)
class Analysis:
    """Results per segment and totals per municipality of one run."""

    results: DataFrame
    summary: DataFrame
    input_version: str | None


def current_version(crashes: DataFrame, roads: DataFrame, munis: DataFrame, tracts: DataFrame) -> str:
    """Version text of the inputs; assignments made by a run do not count."""
    assigned = ("segment_id", "snap_distance")
    sources = {
        "crashes": crashes.drop(*assigned), "roads": roads, "boundaries": munis, "svi": tracts}
    prints = None
    for name, df in sources.items():
        one = dataset_fingerprint(name, df, df.columns)
        prints = one if prints is None else prints.unionByName(one)
    return input_version(prints).first()[0]


def run_analysis(crashes: DataFrame, roads: DataFrame, munis: DataFrame, tracts: DataFrame, y1: int, y2: int, *,
                 muni_id: int | None = None, distance_m: float = V.SNAP_DISTANCE_M,
                 alpha: float = V.SIGNIFICANCE_THRESHOLD, check_years: bool = True,
                 check_inputs: bool = False) -> Analysis:
    """Years check, snap, statistics, test, corridors, overlay and totals.

    All municipalities at once, or one.  The tested segments are materialised once,
    because corridors, overlay and totals all start from them.  ``check_inputs``
    compares the input version before and after (two extra scans).
    """
    N.validate_distance(distance_m)
    if muni_id is not None:
        munis, roads, crashes = (df.filter(F.col("muni_id") == muni_id) for df in (munis, roads, crashes))
    if check_years:
        require_years(crashes, munis, y1, y2)
    version = current_version(crashes, roads, munis, tracts) if check_inputs else None
    screened = cut_lineage(screen_segments(crashes, roads, y1, y2, distance_m=distance_m, alpha=alpha))
    results = equity_overlay(group_corridors(screened, roads), roads, tracts)
    if check_inputs and current_version(crashes, roads, munis, tracts) != version:
        raise RuntimeError("source data changed while the analysis ran")
    return Analysis(results, run_totals(crashes, screened, munis, y1, y2), version)


def run_totals(crashes: DataFrame, results: DataFrame, munis: DataFrame, y1: int, y2: int) -> DataFrame:
    """Crash totals and network size per municipality of a run."""
    for name, kind in (("segment_id", "long"), ("total_injured", "int"), ("pedestrians_killed", "int"), ("pedestrians_injured", "int")):
        if name not in crashes.columns:
            crashes = crashes.withColumn(name, F.lit(None).cast(kind))
    totals = municipality_summary(crashes, munis, y1, y2)
    network = results.filter("is_significant").groupBy("muni_id").agg(
        F.count(F.lit(1)).alias("hin_segment_count"), F.sum("length_miles").alias("hin_miles"))
    known = F.col("total_crashes") == 0       # an empty set has complete, zero casualties
    return totals.join(network, "muni_id", "left").select(
        "muni_id", "total_crashes",
        F.when(known, F.lit(0)).otherwise(F.col("total_killed")).alias("total_fatalities"),
        F.when(known, F.lit(0)).otherwise(F.col("total_injured")).alias("total_injuries"),
        F.coalesce("hin_segment_count", F.lit(0)).alias("hin_segment_count"),
        F.coalesce("hin_miles", F.lit(0.0)).alias("hin_miles"))
