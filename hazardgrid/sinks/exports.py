"""GeoJSON, CSV and manifest outputs, written in parallel by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hazardgrid import fixed_values as V
from hazardgrid.functions import spatial as S
from hazardgrid.functions.text import csv_formula_guard
from hazardgrid.operators.filters import filter_crashes, filter_hin_type
from hazardgrid.operators.validation import dashboard_details

_KEEP_NULLS = {"ignoreNullFields": "false"}
CRASH_PROPERTIES = (
    "crash_id", "date", "time", "light_condition", "external_id", "route_number", "severity",
    "ped_involved", "bike_involved", "total_killed", "total_injured", "pedestrians_killed",
    "pedestrians_injured", "road_name", "geocode_quality",
)
SEGMENT_PROPERTIES = (
    "hin_id", "segment_id", "road_name", "crash_count", "crash_count_possible_injury",
    "crash_rate", "severity_score", "corridor_name", "in_vulnerable_tract",
)


def _column_or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def crash_features(crashes: DataFrame, **filters) -> DataFrame:
    """Filtered crashes with the feature properties as columns plus ``lon, lat``."""
    df = filter_crashes(crashes, **filters)
    details = []
    if "source_metadata" in df.columns:
        df = dashboard_details(df)
        details = [c for c in V.DETAIL_EXPORT_COLUMNS]
    df = df.withColumn("date", F.col("crash_date").cast("string")).withColumn("time", _column_or_null(df, "crash_time"))
    base = [_column_or_null(df, c).alias(c) for c in CRASH_PROPERTIES]
    return df.select(*base, *details, "lon", "lat")


def _feature(geometry: Column, properties: Column) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")), _KEEP_NULLS)


def crash_geojson(crashes: DataFrame, **filters) -> DataFrame:
    """One GeoJSON point feature per row in ``feature``; unknown values stay null."""
    df = crash_features(crashes, **filters)
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    properties = F.struct(*[F.col(c) for c in df.columns if c not in ("lon", "lat")])
    return df.select("crash_id", _feature(geometry, properties).alias("feature"))


def hin_features(results: DataFrame, roads: DataFrame, kind: str = "general", crashes: DataFrame | None = None) -> DataFrame:
    """Significant results of one kind with the feature properties as columns plus ``pts``.

    The bicycle network needs the ``crashes`` behind the results, and is refused while the involvement of any of them is unknown.
    """
    unknown = 0
    if kind == "bicycle":
        if crashes is None:
            raise ValueError("the bicycle network needs the crashes of the analysis")
        unknown = crashes.filter(F.col("bike_involved").isNull()).limit(1).count()
    joined = filter_hin_type(results, kind, unknown).join(roads.select("segment_id", "road_name", "pts"), "segment_id")
    return joined.withColumn("crash_count", F.col("crash_count_total")).select(*SEGMENT_PROPERTIES, "pts")


def hin_geojson(results: DataFrame, roads: DataFrame, kind: str = "general", crashes: DataFrame | None = None) -> DataFrame:
    df = hin_features(results, roads, kind, crashes)
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform(
        "pts", lambda p: F.array(p["x"], p["y"])).alias("coordinates"))
    return df.select("hin_id", _feature(geometry, F.struct(*SEGMENT_PROPERTIES)).alias("feature"))


def export_csv(features: DataFrame, kind: str) -> DataFrame:
    """Columns of a CSV export in their fixed order, formula-like text guarded."""
    if kind == "crashes":
        renamed = features.withColumnsRenamed({"lon": "longitude", "lat": "latitude"})
        names = (*V.CRASH_EXPORT_COLUMNS, *[c for c in V.DETAIL_EXPORT_COLUMNS if c in features.columns])
    elif kind == "hin_segments":
        renamed, names = features, V.SEGMENT_EXPORT_COLUMNS
    else:
        raise ValueError(f"unknown export: {kind}")
    types = dict(renamed.dtypes)
    return renamed.select(*[csv_formula_guard(F.col(c)).alias(c) if types[c] == "string" else F.col(c) for c in names])


def write_csv(export: DataFrame, path: str) -> None:
    export.write.mode("errorifexists").csv(path, header=True, nullValue="", emptyValue="")


def write_features(features: DataFrame, path: str, single_collection: bool = False) -> None:
    """Newline-delimited features, or one FeatureCollection document when asked for.

    The single document is for outputs of one municipality; it is written by one
    task, streaming.
    """
    if not single_collection:
        features.select("feature").write.mode("errorifexists").text(path)
        return

    def wrap(batches):
        import pandas as pd
        sep = '{"type":"FeatureCollection","features":['
        for batch in batches:
            lines = []
            for f in batch["feature"]:
                lines.append(sep + f)
                sep = ","
            if lines:
                yield pd.DataFrame({"value": lines})
        yield pd.DataFrame({"value": ["]}" if sep == "," else sep + "]}"]})

    features.select("feature").coalesce(1).mapInPandas(wrap, "value string").write.mode("errorifexists").text(path)


def write_run_report(report: DataFrame, path: str) -> None:
    """A report (:func:`hazardgrid.operators.loads.run_report`, one row) as one JSON line.

    Spark writes below a temporary name and renames when the job commits, so the folder appears complete or not at all.
    """
    report.coalesce(1).write.mode("errorifexists").json(path, ignoreNullFields=False)
