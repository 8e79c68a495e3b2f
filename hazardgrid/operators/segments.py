"""Per-segment statistics, leave-one-out baselines and the Poisson screen.

Totals per road class are aggregated (map-side combined) and joined back instead
of computed over a window, so one municipality or class holding a large part of
all segments is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hazardgrid import fixed_values as V
from hazardgrid.functions.poisson import upper_tail
from hazardgrid.functions.text import network_weight, severity_weight
from hazardgrid.operators.filters import filter_period

SEGMENT_COUNTS = (
    "total_crashes", "fatal_crashes", "serious_injury_crashes", "minor_injury_crashes",
    "possible_injury_crashes", "property_damage_crashes", "ped_crashes", "bike_crashes",
    "severity_score",
)


def count_where(test: Column) -> Column:
    return F.count(F.when(test, F.lit(1)))


def severity_counts(labels=V.SEVERITIES) -> list[Column]:
    return [count_where(F.col("severity") == s).alias(f"{s}_crashes") for s in labels]


def complete_sum(col: str, test: Column | None = None) -> Column:
    """Sum that is NULL when any contributing row lacks the value (or there are none)."""
    if test is None:
        return F.when(F.count(F.lit(1)) == F.count(col), F.sum(col))
    value = F.when(test, F.col(col))
    return F.when(count_where(test) == F.count(value), F.sum(value))


def segment_stats(roads: DataFrame, crashes: DataFrame, y1: int, y2: int,
                  muni_id: int | None = None) -> DataFrame:
    """Counts and weighted score of every segment, zero-crash segments included."""
    if muni_id is not None:
        roads = roads.filter(F.col("muni_id") == muni_id)
    known = [s for s in V.SEVERITIES if s != "injury_unknown"]
    per_segment = (
        filter_period(crashes, y1, y2).filter(F.col("segment_id").isNotNull())
        .groupBy("segment_id").agg(
            F.count(F.lit(1)).alias("total_crashes"), *severity_counts(known),
            count_where(F.col("ped_involved")).alias("ped_crashes"),
            count_where(F.col("bike_involved")).alias("bike_crashes"),
            F.sum(network_weight(F.col("severity"))).alias("severity_score"),
        )
    )
    joined = roads.select("muni_id", "segment_id", "length_miles", "road_class").join(
        per_segment, "segment_id", "left")
    return joined.select(
        "muni_id", "segment_id", "length_miles", "road_class",
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in SEGMENT_COUNTS],
    )


def ordered_segments(stats: DataFrame) -> DataFrame:
    return stats.orderBy("segment_id")


def segment_crash_stats(crashes: DataFrame, y1: int, y2: int, segment_id: int | None = None) -> DataFrame:
    """Statistics of single segments; an unknown injury weighs 1 here."""
    crashes = filter_period(crashes, y1, y2)
    measures = [
        F.count(F.lit(1)).alias("total_crashes"), *severity_counts(),
        count_where(F.col("ped_involved")).alias("ped_crashes"),
        count_where(F.col("bike_involved")).alias("bike_crashes"),
        F.coalesce(F.sum(severity_weight(F.col("severity"))), F.lit(0)).alias("severity_score"),
    ]
    if segment_id is not None:
        return crashes.filter(F.col("segment_id") == segment_id).agg(*measures)
    return crashes.filter(F.col("segment_id").isNotNull()).groupBy("segment_id").agg(*measures)


def leave_one_out_baseline(stats: DataFrame, years: int) -> DataFrame:
    """Add ``baseline_rate``: crashes per mile-year of the other segments of the class.

    Only eligible segments take part.  A segment alone in its class falls back to
    the rest of its municipality; alone there too, it has no baseline.  "Alone" is
    decided by counting, because subtracting miles can leave a rounding residue.
    """
    eligible = stats.filter(F.col("length_miles") >= V.MIN_SEGMENT_MILES)
    by_class = eligible.groupBy("muni_id", "road_class").agg(
        F.sum("total_crashes").alias("class_crashes"), F.sum("length_miles").alias("class_miles"),
        F.count(F.lit(1)).alias("class_segments"))
    by_muni = by_class.groupBy("muni_id").agg(
        F.sum("class_crashes").alias("muni_crashes"), F.sum("class_miles").alias("muni_miles"),
        F.sum("class_segments").alias("muni_segments"))
    totals = by_class.join(by_muni, "muni_id").withColumnsRenamed({"muni_id": "_m", "road_class": "_c"})
    joined = stats.join(
        totals, (F.col("muni_id") == F.col("_m")) & F.col("road_class").eqNullSafe(F.col("_c")), "left")
    use_class = F.col("class_segments") > 1
    crashes = F.when(use_class, F.col("class_crashes")).otherwise(F.col("muni_crashes")) - F.col("total_crashes")
    miles = F.when(use_class, F.col("class_miles")).otherwise(F.col("muni_miles")) - F.col("length_miles")
    usable = (F.col("length_miles") >= V.MIN_SEGMENT_MILES) & (F.col("muni_segments") > 1)
    rate = F.when(usable, F.try_divide(crashes.cast("double"), miles * years))
    return joined.select(*stats.columns, rate.alias("baseline_rate"))


def poisson_screen(stats: DataFrame, years: int, alpha: float = V.SIGNIFICANCE_THRESHOLD) -> DataFrame:
    """Rate, expectation, p-value and flags of every segment with a length.

    Expects ``baseline_rate`` from :func:`leave_one_out_baseline`.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("significance threshold must lie between 0 and 1")
    exposure = F.col("length_miles") * years
    eligible = F.col("length_miles") >= V.MIN_SEGMENT_MILES
    expected = F.when(eligible & F.col("baseline_rate").isNotNull(), F.col("baseline_rate") * exposure)
    tested = (
        stats.filter(F.col("length_miles") > 0)
        .withColumn("crash_rate", F.col("total_crashes") / exposure)
        .withColumn("expected_crashes", F.coalesce(expected, F.lit(0.0)))
        .withColumn("p_value", F.when(
            F.col("expected_crashes") > 0, upper_tail(F.col("total_crashes"), F.col("expected_crashes")),
        ).otherwise(F.lit(1.0)))
        .withColumn("is_significant", (F.col("p_value") < alpha)
                    & (F.col("total_crashes") >= V.MIN_SIGNIFICANT_CRASHES))
    )
    return (
        tested.withColumn("is_general_hin", F.col("is_significant"))
        .withColumn("is_ped_hin", F.col("is_significant") & (F.col("ped_crashes") >= V.MIN_INVOLVED_CRASHES))
        .withColumn("is_bike_hin", F.col("is_significant") & (F.col("bike_crashes") >= V.MIN_INVOLVED_CRASHES))
    )
