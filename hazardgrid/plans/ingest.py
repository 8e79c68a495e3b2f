"""Archive load: validate, match, locate, merge; every record is loaded or accounted for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from hazardgrid.operators.loads import archive_totals, rejection_counts
from hazardgrid.operators.locating import resolve_location
from hazardgrid.operators.snapshots import write_checked
from hazardgrid.operators.upserts import upsert_crashes, upsert_tracts
from hazardgrid.operators.validation import dedupe_last_wins, match_municipality, split_rejects, tag_crash
from hazardgrid.session import cut_lineage

CRASH_TABLE = (
    "external_id string, dashboard_id string, crash_date date, crash_time string, severity string, ped_involved boolean, "
    "bike_involved boolean, total_killed int, total_injured int, pedestrians_killed int, pedestrians_injured int, muni_id int, "
    "road_name string, route_number string, light_condition string, geocode_quality string, lon double, lat double"
)


@dataclass(frozen=True)
class Load:
    """New table state, the rows merged into it, one row per archive, reason counts per archive, and every rejected row with its reason."""

    state: DataFrame
    incoming: DataFrame
    totals: DataFrame
    reasons: DataFrame
    rejected: DataFrame


def load_archives(rows: DataFrame, scan_rejects: DataFrame, existing: DataFrame, munis: DataFrame, routes: DataFrame) -> Load:
    """Merge scanned archive rows into the crash table.

    Each row is checked against its own archive's county and year.  Of rows with one
    external id the last one, by file and line, is used.
    """
    key = ["archive", "line"]
    tagged = cut_lineage(tag_crash(rows, F.col("source_county"), F.col("source_year")))
    good, invalid = split_rejects(tagged)
    matched, unmatched = match_municipality(good, munis)
    located = cut_lineage(resolve_location(matched, routes, munis, key))
    usable = located.filter(F.col("location_reason").isNull())
    names = [f.split()[0] for f in CRASH_TABLE.split(", ")]
    incoming = dedupe_last_wins(
        usable.withColumn("route_number", F.col("sri")).withColumn("dashboard_id", F.lit(None).cast("string")).select(*key, *names),
        "external_id", key)
    known = existing.select("external_id").distinct().withColumn("_known", F.lit(True))
    kept = incoming.select(*key, F.lit(True).alias("_kept"))
    loaded = usable.select(*key, "external_id", "coordinate_issue", "geocode_quality").join(kept, key, "left").join(known, "external_id", "left")
    # A row is loaded when it is new and the one kept; repeats and known ids are duplicates.
    fresh = F.col("_kept").isNotNull() & F.col("_known").isNull()
    parts = [
        loaded.select(*key, F.when(fresh, "loaded").otherwise("duplicate").alias("status"), F.lit(None).cast("string").alias("reason"), "coordinate_issue", "geocode_quality"),
        located.filter(F.col("location_reason").isNotNull()).select(
            *key, F.lit("rejected").alias("status"), F.col("location_reason").alias("reason"), "coordinate_issue", F.lit(None).cast("string").alias("geocode_quality")),
    ]
    for rejects in (invalid, unmatched, scan_rejects):
        parts.append(rejects.select(*key, F.lit("rejected").alias("status"), "reason", F.lit(None).cast("string").alias("coordinate_issue"),
                                    F.lit(None).cast("string").alias("geocode_quality")))
    audit = parts[0]
    for part in parts[1:]:
        audit = audit.unionByName(part)
    incoming = incoming.drop(*key)
    state = upsert_crashes(existing, incoming).drop("action")
    return Load(state, incoming, archive_totals(audit), rejection_counts(audit), audit.filter("status = 'rejected'").select(*key, "reason"))


def empty_crash_table(spark) -> DataFrame:
    return spark.createDataFrame([], CRASH_TABLE)


def load_tracts(incoming: DataFrame, existing: DataFrame, folder: str) -> DataFrame:
    """The tract table with all incoming tracts merged in, written to a new folder; refused unless exactly these were inserted or updated."""
    return write_checked(upsert_tracts(existing, incoming), folder, incoming.count())
