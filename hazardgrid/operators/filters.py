"""Row filters.  All are plain predicates, so Catalyst pushes them to the scan."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from hazardgrid import fixed_values as V
from hazardgrid.functions.numbers import finite, inside_bounds
from hazardgrid.functions.text import normalize_municipality


def in_period(y1: int | None, y2: int | None, col: str = "crash_date") -> Column:
    """Half-open date range of whole years; either end may be open."""
    test = F.lit(True)
    if y1 is not None:
        test = test & (F.col(col) >= F.lit(date(y1, 1, 1)))
    if y2 is not None:
        test = test & (F.col(col) < F.lit(date(y2 + 1, 1, 1)))
    return test


def filter_period(df: DataFrame, y1: int | None = None, y2: int | None = None,
                  col: str = "crash_date") -> DataFrame:
    """Rows of the period; a ``year`` partition column is pruned as well."""
    df = df.filter(in_period(y1, y2, col))
    if "year" in df.columns:
        df = df.filter((F.lit(True) if y1 is None else F.col("year") >= y1)
                       & (F.lit(True) if y2 is None else F.col("year") <= y2))
    return df


def filter_crashes(df: DataFrame, *, muni_id: int | None = None, y1: int | None = None,
                   y2: int | None = None, severity: str | None = None,
                   ped_only: bool = False, bike_only: bool = False) -> DataFrame:
    df = filter_period(df, y1, y2)
    if muni_id is not None:
        df = df.filter(F.col("muni_id") == muni_id)
    if severity:
        df = df.filter(F.col("severity") == severity)
    if ped_only:
        df = df.filter(F.col("ped_involved"))
    if bike_only:
        df = df.filter(F.col("bike_involved"))
    return df


def filter_hin_type(results: DataFrame, kind: str = "general",
                    unknown_involvement: int = 0) -> DataFrame:
    """Significant results of one kind; bicycle needs complete involvement data."""
    if kind not in ("general", "pedestrian", "bicycle"):
        raise ValueError(f"unknown network type: {kind}")
    if kind == "bicycle" and unknown_involvement:
        raise ValueError("bicycle network is unavailable while involvement is unknown")
    results = results.filter(F.col("is_significant"))
    if kind == "pedestrian":
        results = results.filter(F.col("is_ped_hin"))
    elif kind == "bicycle":
        results = results.filter(F.col("is_bike_hin"))
    return results


def filter_county_like(munis: DataFrame, text: str | None) -> DataFrame:
    """Case-insensitive substring of the county name."""
    return munis if not text else munis.filter(F.col("county").ilike(f"%{text}%"))


def filter_bounds(df: DataFrame, bounds=V.STATE_BOUNDS, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return df.filter(inside_bounds(F.col(lon), F.col(lat), bounds))


def filter_year_range(df: DataFrame, y1: int, y2: int, year: str = "Year") -> tuple[DataFrame, DataFrame]:
    """``(kept, excluded)`` rows of an export; a year that is not digits aborts the job."""
    text = F.trim(F.col(year))
    checked = df.withColumn("_year", F.when(text.rlike(r"^\d+$"), text.try_cast("long")).otherwise(
        F.raise_error(F.concat(F.lit("invalid year: "), F.coalesce(text, F.lit("NULL"))))))
    inside = F.col("_year").between(y1, y2)
    return checked.filter(inside).drop("_year"), checked.filter(~inside).drop("_year")


def filter_road_types(df: DataFrame) -> DataFrame:
    """Relevant road types by ``highway``, else ``fclass``, else everything."""
    for name in ("highway", "fclass"):
        if name in df.columns:
            return df.filter(F.col(name).isin(*V.OSM_ROAD_CLASS))
    return df


def filter_eligible_segments(df: DataFrame) -> DataFrame:
    return df.filter(F.col("length_miles") >= V.MIN_SEGMENT_MILES)


def municipality_filter_reason(requested_name: str | None, requested_id: int | None,
                               name: Column, muni_id: Column) -> Column:
    """Reject reason of a run restricted to one municipality, NULL for kept rows."""
    reason = F.lit(None).cast("string")
    if requested_id is not None:
        reason = F.when(muni_id != requested_id, "muni_id_mismatch")
    if requested_name:
        reason = F.when(name != normalize_municipality(F.lit(requested_name)),
                        "municipality_filter").otherwise(reason)
    return reason


def filter_municipality_name(df: DataFrame, name: str | None, muni_id: int | None = None,
                             ) -> tuple[DataFrame, DataFrame]:
    """``(kept, rejects)`` by normalised name and then by id."""
    tagged = df.withColumn("reason", municipality_filter_reason(
        name, muni_id, F.col("municipality_name"), F.col("muni_id")))
    return tagged.filter(F.col("reason").isNull()).drop("reason"), tagged.filter(F.col("reason").isNotNull())


def valid_map_points(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return df.filter((F.abs(finite(F.col(lon))) <= 180) & (F.abs(finite(F.col(lat))) <= 90))
