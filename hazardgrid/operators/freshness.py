"""Dataset versions, freshness of stored analyses and before/after checks."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from hazardgrid import fixed_values as V
from hazardgrid.operators.summaries import coverage_by_year, crash_year, missing_years


class MissingCrashData(ValueError):
    """Requested years without any loaded crash: how many municipalities lack some, and a DataFrame that names them all."""

    def __init__(self, rows: DataFrame, count: int):
        self.rows, self.count = rows, count
        super().__init__(f"{V.MISSING_DATA_MESSAGE} ({count} municipalities)")


def row_fingerprint(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``rows, digest`` of a table's content, independent of row order; equal rows count as often as they occur.

    A row is the MD5 of its values as text, each behind its length (a null has none), in the order of the column names.  The digest adds up both halves of
    the row hashes as decimals: a sum that neither overflows nor sorts, and that any engine with MD5 can compute.
    """
    cols = sorted(c for c in df.columns if c not in exclude)

    def value(c):
        text = F.col(f"`{c}`")
        text = (F.to_json(F.struct(text)) if isinstance(df.schema[c].dataType, (ArrayType, MapType, StructType)) else text.cast("string"))
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    row = F.md5(F.concat_ws(",", *[value(c) for c in cols]).cast("binary"))

    def half(start):
        return F.coalesce(F.sum(F.conv(F.substring(row, start, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").cast("string")

    return df.agg(F.count(F.lit(1)).alias("rows"), F.concat(half(1), F.lit("-"), half(16)).alias("digest"))


def dataset_fingerprint(dataset: str, df: DataFrame, columns: list[str]) -> DataFrame:
    """Version of a dataset from its source columns (assignments left out)."""
    return row_fingerprint(df.select(*columns)).select(
        F.lit(dataset).alias("dataset"), "rows", "digest")


def method_fingerprint() -> str:
    """Digest of everything in the method that changes results."""
    method = {
        "version": V.METHOD_VERSION, "weights": V.SEVERITY_WEIGHTS,
        "minimum_segment_miles": V.MIN_SEGMENT_MILES,
        "corridor_endpoint_tolerance_meters": V.CORRIDOR_TOLERANCE_M,
    }
    return hashlib.sha256(json.dumps(method, sort_keys=True).encode()).hexdigest()


def input_version(fingerprints: DataFrame) -> DataFrame:
    """One text naming the state of all four datasets and the method."""
    parts = F.sort_array(F.collect_list(F.concat_ws(":", "dataset", F.col("rows").cast("string"), "digest")))
    return fingerprints.agg(F.concat_ws(";", parts, F.lit(f"method:{method_fingerprint()}")).alias("input_version"))


def assess_freshness(analyses: DataFrame, crashes: DataFrame, current_version: str) -> DataFrame:
    """``data_status`` of each analysis against what is loaded now."""
    coverage = coverage_by_year(crashes).drop("total_crashes")
    asked = analyses.join(coverage, "muni_id", "left").withColumns({
        "available_years": F.coalesce("available_years", F.array().cast("array<int>")),
        "crash_counts": F.coalesce("crash_counts", F.array().cast("array<bigint>"))})
    judged = missing_years(asked, F.col("start_year"), F.col("end_year"))
    status = (
        F.when(F.col("status") != "completed", "ready")
        .when(F.col("range_crashes") == 0, "no_data")
        .when(F.size("missing_years") > 0, "missing_years")
        .when(~F.col("total_crashes").eqNullSafe(F.col("range_crashes")), "stale")
        .when(~F.col("input_version").eqNullSafe(F.lit(current_version)), "stale")
        .otherwise("ready"))
    message = F.expr("data_status")
    notes = {"no_data": V.NO_DATA_MESSAGE, "missing_years": V.MISSING_DATA_MESSAGE, "stale": V.STALE_DATA_MESSAGE}
    text = F.lit(None).cast("string")
    for key, note in notes.items():
        text = F.when(message == key, F.lit(note)).otherwise(text)
    return judged.withColumn("data_status", status).withColumn("data_message", text).select(
        "analysis_id", "muni_id", "data_status", "data_message", "available_years", "missing_years",
        F.col("range_crashes").alias("current_total_crashes"))


def unavailable_years(crashes: DataFrame, munis: DataFrame, y1: int, y2: int) -> DataFrame:
    """Municipalities that lack requested years, with the missing and available ones."""
    coverage = munis.select("muni_id").join(coverage_by_year(crashes), "muni_id", "left").withColumns({
        "available_years": F.coalesce("available_years", F.array().cast("array<int>")),
        "crash_counts": F.coalesce("crash_counts", F.array().cast("array<bigint>"))})
    return missing_years(coverage, y1, y2).filter(F.size("missing_years") > 0).select(
        "muni_id", "missing_years", "available_years")


def require_years(crashes: DataFrame, munis: DataFrame, y1: int, y2: int) -> None:
    """Raise before any work when a requested year has no crashes."""
    lacking = unavailable_years(crashes, munis, y1, y2)
    count = lacking.count()
    if count:
        raise MissingCrashData(lacking, count)


def crash_counts_by_year(before: DataFrame, after: DataFrame, scope: tuple[int, int] = V.DASHBOARD_YEARS) -> DataFrame:
    """Counts per year before and after a write; years out of scope must not change."""
    def count(df, name):
        return df.groupBy(crash_year()).agg(F.count(F.lit(1)).alias(name))
    joined = count(before, "before").join(count(after, "after"), "year", "full").select(
        "year", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return joined.withColumn("allowed", F.col("year").between(*scope) | (F.col("before") == F.col("after")))


def network_coverage_flags(report: DataFrame, allow_partial: bool = False) -> DataFrame:
    """Completeness flags and exit code of road load reports (one row per load)."""
    c = F.col
    source = (c("source_count") > 0) & (c("fetched") == c("source_count"))
    rejected = (c("rejected_features") > 0) | (c("analysis_path_rejections") > 0)
    analysis = source & (c("analysis_segments") > 0) & ~(rejected | (c("paths_without_municipality") > 0))
    reference = source & (c("routes") > 0) & ~(rejected | (c("reference_path_rejections") > 0))
    partial = ~(analysis & reference) & F.lit(allow_partial) & (c("fetched") == c("source_count")) & (c("analysis_segments") > 0)
    return report.withColumn("analysis_coverage_complete", analysis).withColumn(
        "reference_coverage_complete", reference).withColumn("partial_coverage_accepted", partial).withColumn(
        "exit_code", F.when((analysis & reference) | partial, 0).otherwise(3))
