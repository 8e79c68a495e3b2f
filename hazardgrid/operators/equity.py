"""Vulnerability overlay and the census vulnerability index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hazardgrid import fixed_values as V
from hazardgrid.operators.boundaries import lines_meeting_polygons
from hazardgrid.operators.ranking import average_rank_pct


def first_intersecting_tract(roads: DataFrame, tracts: DataFrame) -> DataFrame:
    """``segment_id, tract_id, svi_score, svi_percentile`` of the lowest tract id met.

    Of tracts with the same outline only the one with the lowest id can win; outlines are compared by digest, so that no geometry is grouped.
    """
    digests = tracts.select("tract_id", F.sha2(F.to_json("rings"), 256).alias("outline"))
    winners = digests.groupBy("outline").agg(F.min("tract_id").alias("tract_id")).select("tract_id")
    outlines = tracts.join(winners, "tract_id", "left_semi").select(F.struct("tract_id", "svi_score", "svi_percentile").alias("tract"), "rings")
    hits = lines_meeting_polygons(roads.select("segment_id", "pts"), outlines)
    best = hits.groupBy("segment_id").agg(F.min_by("tract", F.col("tract.tract_id")).alias("tract"))
    return roads.select("segment_id").join(best, "segment_id", "left").select("segment_id", "tract.*")


def equity_overlay(results: DataFrame, roads: DataFrame, tracts: DataFrame) -> DataFrame:
    """Set ``avg_svi_score`` and ``in_vulnerable_tract``; without a tract both are NULL.  Only roads of ``results`` are overlaid."""
    asked = roads.join(results.select("segment_id").distinct(), "segment_id", "left_semi")
    found = first_intersecting_tract(asked, tracts).select(
        "segment_id", F.col("svi_score").alias("avg_svi_score"),
        (F.col("svi_percentile") > V.VULNERABLE_PERCENTILE).alias("in_vulnerable_tract"))
    return results.drop("avg_svi_score", "in_vulnerable_tract").join(found, "segment_id", "left")


def merge_demographics(tracts: DataFrame, demographics: DataFrame) -> DataFrame:
    return tracts.join(demographics, "tract_id", "left")


def max_normalize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``<col>_norm`` = col / max * 100; NULL when the maximum is not positive."""
    tops = df.agg(*[F.max(c).alias(f"_max_{c}") for c in columns])
    joined = df.crossJoin(F.broadcast(tops))      # one row
    return joined.withColumns({
        f"{c}_norm": F.when(F.col(f"_max_{c}") > 0, F.coalesce(F.col(c) / F.col(f"_max_{c}") * 100, F.lit(0.0)))
        for c in columns
    }).drop(*[f"_max_{c}" for c in columns])


def percentile_rank_avg(df: DataFrame, col: str, out: str = "percentile") -> DataFrame:
    return average_rank_pct(df, col, out)


def vulnerability_index(df: DataFrame) -> DataFrame:
    """Shares, normalised shares, mean score and percentile of raw census variables."""
    renamed = df.withColumns({
        name: F.expr(f"try_cast(`{code}` AS DOUBLE)") for code, name in V.CENSUS_VARIABLES.items() if code in df.columns})

    def share(part, whole):
        return F.coalesce(F.try_divide(part, whole) * 100, F.lit(0.0))

    shares = ["pct_below_poverty", "pct_no_vehicle", "pct_minority"]
    with_shares = renamed.withColumns({
        "pct_below_poverty": share(F.col("below_poverty"), F.col("total_population")),
        "pct_no_vehicle": share(F.col("no_vehicle_households"), F.col("total_households")),
        "pct_minority": share(F.col("total_race") - F.col("white_alone"), F.col("total_race")),
    })
    scored = max_normalize(with_shares, shares)
    parts = F.array_compact(F.array(*[F.col(f"{c}_norm") for c in shares]))
    mean = F.try_divide(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), F.size(parts))
    scored = scored.withColumn("svi_score", F.coalesce(mean, F.lit(0.0)))
    # Without any usable component there is nothing to rank.
    ranked = average_rank_pct(scored.withColumn("_usable", F.size(parts) > 0), "svi_score", "svi_percentile")
    return ranked.withColumn("svi_percentile", F.when(F.col("_usable"), F.col("svi_percentile")).otherwise(0.0)).drop("_usable")
