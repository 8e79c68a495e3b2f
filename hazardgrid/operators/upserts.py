"""Inserts and updates as joins that give a new table state.

Nothing is changed in place: each function reads the old state and returns the
new one, to be written to a new snapshot folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hazardgrid import fixed_values as V
from hazardgrid.operators.sketches import bloom_filter, keep_possible


def merge(existing: DataFrame, incoming: DataFrame, key: list[str], update: dict[str, Column],
          allowed: Column | None = None) -> DataFrame:
    """Full outer merge on ``key``.

    ``update`` maps a column to its value for matched rows, written in terms of
    ``old.x`` and ``new.x``; other columns keep the old value.  Matched rows where
    ``allowed`` is not true stay as they are.  New rows take the incoming values.
    The result has the columns of ``existing`` plus ``action``.  A key with a null equals
    no other: such rows are kept or inserted beside the join, however many they are.
    """
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key))
    old = existing.filter(whole).withColumn("_old", F.lit(True)).alias("old")
    new = incoming.filter(whole).withColumn("_new", F.lit(True)).alias("new")
    joined = old.join(new, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in key], "full")
    has_old, has_new = F.col("old._old").isNotNull(), F.col("new._new").isNotNull()
    touched = has_old & has_new & (F.coalesce(allowed, F.lit(False)) if allowed is not None else F.lit(True))
    out = []
    for c in existing.columns:
        fresh = F.col(f"new.{c}") if c in incoming.columns else F.lit(None)
        value = F.when(touched, update[c]).otherwise(F.col(f"old.{c}")) if c in update else F.col(f"old.{c}")
        out.append(F.when(has_old, value).otherwise(fresh).alias(c))
    action = F.when(~has_old, "inserted").when(touched, "updated").when(has_new, "skipped").otherwise("kept")
    fresh = incoming.filter(~whole).select(*[F.col(c) if c in incoming.columns else F.lit(None).cast(existing.schema[c].dataType).alias(c) for c in existing.columns])
    return joined.select(*out, action.alias("action")).unionByName(
        existing.filter(~whole).withColumn("action", F.lit("kept"))).unionByName(fresh.withColumn("action", F.lit("inserted")))


def upsert_crashes(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Archive load: refresh severity, flags and counts of known crashes, add new ones.

    Location and date stay; bicycle evidence stays; dashboard crashes stay whole.
    """
    refreshed = ("severity", "ped_involved", *V.CASUALTY_COLUMNS)
    update = {c: F.col(f"new.{c}") for c in refreshed}
    update["bike_involved"] = F.coalesce(F.col("old.bike_involved"), F.col("new.bike_involved"))
    return merge(existing, incoming, ["external_id"], update, allowed=F.col("old.dashboard_id").isNull())


def touched_years(existing: DataFrame, incoming: DataFrame, key: str = "external_id", date: str = "crash_date") -> DataFrame:
    """``year`` of all rows that a merge on ``key`` writes: those of the incoming rows, and of stored rows of one of their keys.

    Reads two columns of ``existing``; a Bloom filter leaves little of them for the join.
    """
    possible = keep_possible(existing.select(key, date), {key: bloom_filter(incoming, key)})
    stored = possible.join(incoming.select(key), key, "left_semi")
    return stored.select(F.year(date).alias("year")).unionByName(incoming.select(F.year(date).alias("year"))).distinct()


def upsert_municipalities(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    replaced = [c for c in existing.columns if c in incoming.columns and c not in ("muni_code", "muni_id")]
    return merge(existing, incoming, ["muni_code"], {c: F.col(f"new.{c}") for c in replaced})


def upsert_tracts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace source columns by tract; municipality and poverty share stay untouched."""
    kept = ("tract_id", "muni_id", "pct_below_poverty")
    replaced = [c for c in existing.columns if c in incoming.columns and c not in kept]
    return merge(existing, incoming, ["tract_id"], {c: F.col(f"new.{c}") for c in replaced})


def upsert_roads(existing: DataFrame, staged: DataFrame) -> DataFrame:
    """Replace by source id; run only after the refresh guards pass."""
    replaced = [c for c in existing.columns if c in staged.columns and c not in ("source_id", "segment_id")]
    return merge(existing, staged, ["source_id"], {c: F.col(f"new.{c}") for c in replaced})


def check_affected(state: DataFrame, expected: int) -> DataFrame:
    """The state without ``action``; fails when not exactly ``expected`` rows changed."""
    changed = state.filter(F.col("action").isin("inserted", "updated")).count()
    if changed != expected:
        raise RuntimeError(f"affected {changed} rows, expected {expected}")
    return state.drop("action")


def insert_if_absent(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Existing rows plus new ones whose key is unknown; of equal new keys the row that sorts lowest.

    A key with a null is never equal to another: such rows are all inserted, and they take no part in the shuffle.
    """
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in key))
    row = F.struct(*[F.col(c) for c in new.columns])
    fresh = (
        new.filter(whole).groupBy(*key).agg(F.min(row).alias("_row")).select("_row.*")
        .join(existing.select(*key).filter(whole).distinct(), key, "left_anti").select(*new.columns)
    )
    return existing.unionByName(fresh, allowMissingColumns=True).unionByName(new.filter(~whole), allowMissingColumns=True)


def legacy_crash_key() -> Column:
    """Given id, else ``date_lat_lon``."""
    return F.coalesce("external_id", F.concat_ws(
        "_", F.col("crash_date").cast("string"), F.col("latitude").cast("string"), F.col("longitude").cast("string")))


def enrich_bicycle(crashes: DataFrame, evidence: DataFrame, munis: DataFrame) -> DataFrame:
    """Set ``bike_involved`` where a person row of the same county and year says so.

    ``evidence`` has ``external_id, year, county``.  Adds ``matched`` and ``prior``.
    """
    ids = evidence.select("external_id", F.col("year").alias("_year"), F.upper("county").alias("_county")).distinct().withColumn("_hit", F.lit(True))
    home = munis.select("muni_id", F.upper("county").alias("_county"))
    joined = crashes.withColumn("_year", F.year("crash_date")).join(home, "muni_id", "left").join(
        ids, ["external_id", "_year", "_county"], "left")
    hit = F.coalesce("_hit", F.lit(False))
    return joined.withColumn("prior", F.col("bike_involved")).withColumn("matched", hit).withColumn(
        "bike_involved", F.when(hit, F.lit(True)).otherwise(F.col("bike_involved"))).drop("_county", "_hit", "_year")


def bicycle_counters(enriched: DataFrame, evidence: DataFrame) -> DataFrame:
    """Matched, updated, already known, contradicting and unmatched evidence ids."""
    hit, prior = F.col("matched"), F.col("prior")
    seen = enriched.agg(
        F.count_if(hit).alias("matched"), F.count_if(hit & ~F.coalesce(prior, F.lit(False))).alias("updated"),
        F.count_if(hit & F.coalesce(prior, F.lit(False))).alias("already_known"),
        F.count_if(hit & (prior == F.lit(False))).alias("conflicting_false"))
    asked = evidence.select("external_id", "year", "county").distinct().agg(F.count(F.lit(1)).alias("_ids"))
    return seen.crossJoin(F.broadcast(asked)).withColumn("unmatched", F.col("_ids") - F.col("matched")).drop("_ids")


def enrich_casualties(crashes: DataFrame, prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(crashes refreshed from archive rows, rejects)`` without touching locations."""
    cols = ("severity", "ped_involved", "bike_involved", *V.CASUALTY_COLUMNS)
    new = prepared.select("external_id", *[F.col(c).alias(f"_{c}") for c in cols], F.lit(True).alias("_new"))
    joined = crashes.join(new, "external_id", "left")
    hit = F.coalesce(F.col("_new") & F.col("dashboard_id").isNull(), F.lit(False))
    # A logical OR in which unknown stays unknown unless the other side is true.
    values = {
        "severity": F.col("_severity"), "ped_involved": F.col("ped_involved") | F.col("_ped_involved"),
        "bike_involved": F.coalesce("bike_involved", "_bike_involved"),
        **{c: F.coalesce(f"_{c}", c) for c in V.CASUALTY_COLUMNS}}
    refreshed = joined.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}).select(*crashes.columns)
    known = crashes.filter(F.col("dashboard_id").isNull()).select("external_id")
    missing = prepared.join(known, "external_id", "left_anti").withColumn("reason", F.lit("existing_crash_missing"))
    return refreshed, missing


def unmatched_ids(requested: DataFrame, matched: DataFrame, key: str = "external_id") -> DataFrame:
    return requested.select(key).distinct().join(matched.select(key), key, "left_anti")


def union_ids(*frames: DataFrame, key: str = "external_id") -> DataFrame:
    out = frames[0].select(key)
    for f in frames[1:]:
        out = out.unionByName(f.select(key))
    return out.distinct()


# --- road refresh guards ---------------------------------------------------------

def path_prefix(source_id: Column) -> Column:
    """The path part of a segment id: its first three colon-separated fields."""
    return F.substring_index(source_id, ":", 3)


def snapshot_omissions(routes: DataFrame, segments: DataFrame, seen: DataFrame) -> DataFrame:
    """Existing routes and segment paths missing from a new snapshot's path ids."""
    ours = F.col("source_id").startswith(f"{V.SOURCE_PREFIX}:")
    have = seen.select(F.col("source_id").alias("path_id")).distinct()
    lost_routes = routes.filter(ours).select(F.lit("route").alias("kind"), "source_id", F.col("source_id").alias("path_id"))
    lost_segments = segments.filter(ours).select(F.lit("segment").alias("kind"), "source_id", path_prefix(F.col("source_id")).alias("path_id"))
    return lost_routes.unionByName(lost_segments).join(have, "path_id", "left_anti").select("kind", "source_id")


def incompatible_changes(existing: DataFrame, staged: DataFrame, attributes: list[str],
                         length: str | None = "length_miles", geometry: str = "pts") -> DataFrame:
    """Rows of one id whose attributes, length or geometry differ, as ``source_id, problem``."""
    new = staged.select("source_id", *[F.col(c).alias(f"_{c}") for c in [*attributes, *([length] if length else []), geometry]])
    joined = existing.join(new, "source_id")
    differs = F.lit(False)
    for c in attributes:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    drift = F.coalesce(F.abs(F.col(length) - F.col(f"_{length}")) > V.LENGTH_DRIFT_MILES, F.lit(False)) if length else F.lit(False)
    moved = ~F.col(geometry).eqNullSafe(F.col(f"_{geometry}"))
    return joined.withColumn("problem", F.when(differs, "attributes").when(drift, "length").when(moved, "geometry")).filter(
        F.col("problem").isNotNull()).select("source_id", "problem")


def stale_segments(existing: DataFrame, staged_paths: DataFrame, staged: DataFrame) -> DataFrame:
    """Existing segments of a reloaded path that the new split no longer produces."""
    paths = staged_paths.select(F.col("source_id").alias("_path")).distinct()
    return existing.withColumn("_path", path_prefix(F.col("source_id"))).join(paths, "_path", "left_semi").join(
        staged.select("source_id"), "source_id", "left_anti").select("source_id")


def require_compatible(*problems: DataFrame) -> None:
    """Raise when any guard frame has a row."""
    for frame in problems:
        if not frame.isEmpty():
            raise RuntimeError("road source differs from existing stable ids; load a fresh snapshot")
