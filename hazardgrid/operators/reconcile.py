"""Conservative reconciliation of dashboard records with stored crashes.

The outcome of a record is a chain of column conditions over one identity join and one coverage join;
no row is looked at from Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hazardgrid import fixed_values as V
from hazardgrid.functions.numbers import inside_bounds
from hazardgrid.operators.boundaries import point_covered
from hazardgrid.operators.sketches import bloom_filter, keep_possible
from hazardgrid.operators.validation import first_reason
from hazardgrid.session import stage

BICYCLE_CONFLICT = "bicycle_flag_conflicts_with_existing_evidence"


def identity_match(staged: DataFrame, crashes: DataFrame) -> DataFrame:
    """Add ``existing`` (struct or NULL) and ``identity_conflict`` to each record; ``staged`` has unique dashboard ids.

    A crash matches by dashboard id or by external id; both matching different crashes is a conflict.  If several crashes share an id, the one
    of the lowest crash id is meant.
    """
    return staged.join(_identities(staged, crashes), "dashboard_id", "left").withColumn(
        "identity_conflict", F.coalesce("identity_conflict", F.lit(False)))


def _identities(staged: DataFrame, crashes: DataFrame) -> DataFrame:
    """``dashboard_id, existing, identity_conflict`` of the records that match a crash.

    Both identities are one join on (kind, id).  A Bloom filter over the export's ids drops nearly all other crashes before it, and rows without an id
    take no part.
    """
    def keyed(dashboard, external, *carried):
        pairs = F.array(F.struct(F.lit("d").alias("kind"), dashboard.alias("id")), F.struct(F.lit("e").alias("kind"), external.alias("id")))
        return F.explode(F.filter(pairs, lambda p: p["id"].isNotNull())).alias("key"), *carried

    filters = {c: bloom_filter(staged.select(c), c) for c in ("dashboard_id", "external_id")}
    row = F.struct(*[F.col(c) for c in crashes.columns]).alias("row")
    possible = keep_possible(crashes, filters).select(*keyed(F.col("dashboard_id"), F.col("external_id"), row))
    asked = staged.select(*keyed(F.col("dashboard_id"), F.col("external_id"), F.col("dashboard_id")))

    def lowest(kind):
        return F.min_by("row", F.when(F.col("key.kind") == kind, F.col("row.crash_id")))

    found = asked.join(possible, "key").groupBy("dashboard_id").agg(lowest("d").alias("_d"), lowest("e").alias("_h"))
    return found.select("dashboard_id", F.coalesce("_d", "_h").alias("existing"), F.coalesce(
        F.col("_d.crash_id") != F.col("_h.crash_id"), F.lit(False)).alias("identity_conflict"))


def _foreign_days(crashes: DataFrame) -> DataFrame:
    """``muni_id, crash_date`` of crashes that are of unknown origin."""
    foreign = F.col("external_id").isNull() | ~F.col("external_id").startswith(f"{V.SOURCE_PREFIX}:")
    return crashes.filter(F.col("dashboard_id").isNull() & foreign).select("muni_id", "crash_date").distinct()


def unknown_source_overlap(matched: DataFrame, crashes: DataFrame) -> DataFrame:
    """Add ``unknown_source_overlap``: a new record meets a same-day crash of unknown origin."""
    days = _foreign_days(crashes).withColumn("_u", F.lit(True))
    return matched.join(days, ["muni_id", "crash_date"], "left").withColumn(
        "unknown_source_overlap", F.col("existing").isNull() & F.coalesce("_u", F.lit(False))).drop("_u")


_POINTS = ("reported_valid", "calculated_valid", "existing_valid")


def match_records(staged: DataFrame, crashes: DataFrame, munis: DataFrame) -> DataFrame:
    """Identity, overlap and the three point checks of every record; ``staged`` has unique dashboard ids.

    Ids, days and points travel as narrow rows of their own: the points of all three kinds meet the municipalities in one join.  The wide record is
    shuffled once, to its facts.
    """
    identities = stage(_identities(staged, crashes), "reconcile-identities")

    def points(rows, which, lon, lat):
        return rows.select("dashboard_id", "muni_id", F.lit(which).alias("which"), lon.alias("lon"), lat.alias("lat")).filter("lon IS NOT NULL AND lat IS NOT NULL")

    old = identities.filter("existing IS NOT NULL").join(staged.select("dashboard_id", "muni_id"), "dashboard_id")
    x, y = F.col("existing.lon"), F.col("existing.lat")
    asked = points(staged, "reported_valid", F.col("reported_point.lon"), F.col("reported_point.lat")).unionByName(
        points(staged, "calculated_valid", F.col("calculated_point.lon"), F.col("calculated_point.lat"))).unionByName(
        points(old.filter(inside_bounds(x, y)), "existing_valid", x, y))
    overlap = staged.select("dashboard_id", "muni_id", "crash_date").join(_foreign_days(crashes), ["muni_id", "crash_date"], "left_semi").select(
        "dashboard_id", F.lit("unknown_source_overlap").alias("fact"))
    facts = point_covered(asked, munis).filter("covered").select("dashboard_id", F.col("which").alias("fact")).unionByName(overlap)
    facts = facts.groupBy("dashboard_id").agg(*[F.bool_or(F.col("fact") == f).alias(f) for f in (*_POINTS, "unknown_source_overlap")])
    joined = staged.join(identities, "dashboard_id", "left").join(facts, "dashboard_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("identity_conflict", *_POINTS, "unknown_source_overlap")}).withColumn(
        "unknown_source_overlap", F.col("unknown_source_overlap") & F.col("existing").isNull())


def _without_provenance(meta: Column) -> Column:
    return F.struct(meta["source"], meta["schema_version"], meta["raw"], meta["conflicts"], meta["location_method"])


def reconcile_dashboard(matched: DataFrame, allow_new: bool = False) -> DataFrame:
    """Outcome and resulting values of every matched record.

    Adds ``outcome``, ``crash_id`` (NULL for new rows) and ``values``, a struct of the
    22 value columns that is NULL unless the outcome is updated or inserted.
    """
    old = F.col("existing")
    has_old = old.isNotNull()
    blocked = first_reason(
        (F.col("identity_conflict"), "dashboard_and_legacy_identity_conflict"),
        (has_old & ((old["crash_date"] != F.col("crash_date")) | ~old["muni_id"].eqNullSafe(F.col("muni_id"))),
         "existing_date_or_municipality_conflict"),
        (has_old & (old["dashboard_id"] != F.col("dashboard_id")), "existing_dashboard_identity_conflict"),
        (~has_old & (F.col("year") <= V.HISTORICAL_LAST_YEAR) & F.lit(not allow_new), "historical_identity_unmatched"),
        (~has_old & F.col("unknown_source_overlap"), "unknown_source_overlap"))
    method = (
        F.when(F.col("reported_valid"), "dashboard_current").when(F.col("calculated_valid"), "dashboard_calculated")
        .when(has_old & F.col("existing_valid"), F.coalesce(F.nullif(old["geocode_quality"], F.lit("")), F.lit("historical_validated"))))

    def axis(name):
        return (F.when(F.col("reported_valid"), F.col("reported_point")[name])
                .when(F.col("calculated_valid"), F.col("calculated_point")[name]).otherwise(old[name]))

    df = matched.withColumns({"_blocked": blocked, "_method": method, "_lon": axis("lon"), "_lat": axis("lat")})
    prior_bike, new_bike = old["bike_involved"], F.col("bike_involved")
    contradiction = has_old & prior_bike.isNotNull() & new_bike.isNotNull() & (prior_bike != new_bike)
    meta = F.col("source_metadata")
    conflicts = F.when(F.coalesce(contradiction, F.lit(False)), F.array_append(meta["conflicts"], F.lit(BICYCLE_CONFLICT))).otherwise(meta["conflicts"])
    df = df.withColumn("_meta", F.struct(
        meta["source"].alias("source"), meta["schema_version"].alias("schema_version"), meta["raw"].alias("raw"),
        conflicts.alias("conflicts"), meta["provenance"].alias("provenance"), F.col("_method").alias("location_method")))
    still = has_old & old["lon"].eqNullSafe(F.col("_lon")) & old["lat"].eqNullSafe(F.col("_lat"))
    same_meta = has_old & old["source_metadata"].isNotNull() & _without_provenance(old["source_metadata"]).eqNullSafe(
        _without_provenance(F.col("_meta")))
    null = F.lit(None)
    values = {
        "dashboard_id": F.col("dashboard_id"),
        "external_id": F.when(has_old, old["external_id"]).otherwise(F.col("external_id")),
        "crash_date": F.col("crash_date"), "crash_time": F.col("crash_time"), "severity": F.col("severity"),
        "ped_involved": F.when(has_old & F.coalesce(old["ped_involved"], F.lit(False)), F.lit(True)).otherwise(F.col("ped_involved")),
        "bike_involved": F.when(has_old & (F.coalesce(prior_bike, F.lit(False)) | new_bike.isNull()), prior_bike).otherwise(new_bike),
        **{c: F.col(c) for c in V.CASUALTY_COLUMNS},
        "muni_id": F.col("muni_id"), "road_name": F.col("road_name"), "route_number": F.col("route_number"),
        "weather_condition": F.col("weather_condition"),
        "light_condition": F.when(has_old, old["light_condition"]).otherwise(null.cast("string")),
        "source_metadata": F.when(same_meta, old["source_metadata"]).otherwise(F.col("_meta")),
        "geocode_quality": F.col("_method"),
        "segment_id": F.when(still, old["segment_id"]), "snap_distance": F.when(still, old["snap_distance"]),
        "longitude": F.col("_lon"), "latitude": F.col("_lat"),
    }
    df = df.withColumn("values", F.struct(*[values[c].alias(c) for c in V.CRASH_VALUE_COLUMNS]))
    stored = {"longitude": "lon", "latitude": "lat"}
    same = F.lit(True)
    for c in V.CRASH_VALUE_COLUMNS:
        same = same & old[stored.get(c, c)].eqNullSafe(F.col("values")[c])
    outcome = (
        F.when(F.col("_blocked").isNotNull(), F.col("_blocked"))
        .when(F.col("_method").isNull(), "location_unresolved")
        .when(has_old & same, "unchanged").when(has_old, "updated").otherwise("inserted"))
    return df.withColumn("outcome", outcome).withColumn("crash_id", old["crash_id"]).withColumn(
        "values", F.when(F.col("outcome").isin("updated", "inserted"), F.col("values"))).drop(
        "_blocked", "_method", "_lon", "_lat", "_meta")


def reconciliation_outcomes(actions: DataFrame) -> DataFrame:
    """Records, matches and unmatched records with a usable point, per year and outcome."""
    usable = F.col("reported_valid") | F.col("calculated_valid")
    return actions.groupBy("year", "outcome").agg(
        F.count(F.lit(1)).alias("records"), F.count("existing").alias("matched"),
        F.count_if((F.col("outcome") == "historical_identity_unmatched") & usable).alias("unmatched_with_valid_location"))


def reconciliation_report(actions: DataFrame) -> DataFrame:
    """All counters of a run as rows ``counter, year, name, records``, from one pass over the actions.

    ``outcome`` and ``matched`` are per year; ``conflict`` counts the records' own conflicts and ``location`` the methods of rows to be written.
    """
    usable = F.col("reported_valid") | F.col("calculated_valid")
    unmatched = (F.col("outcome") == "historical_identity_unmatched") & usable

    def item(counter, name, year=None):
        return F.struct(F.lit(counter).alias("counter"), (F.lit(None) if year is None else year).cast("int").alias("year"), name.cast("string").alias("name"))

    year = F.col("year")
    fixed = F.array(
        item("outcome", F.col("outcome"), year), F.when(F.col("existing").isNotNull(), item("matched", F.lit(None), year)),
        F.when(unmatched, item("unmatched_with_valid_location", F.lit(None), year)),
        F.when(F.col("values").isNotNull(), item("location", F.col("values.geocode_quality"))))
    own = F.transform(F.coalesce(F.col("source_metadata.conflicts"), F.array().cast("array<string>")), lambda c: item("conflict", c))
    return actions.select(F.explode(F.concat(fixed, own)).alias("i")).filter("i IS NOT NULL").groupBy("i.counter", "i.year", "i.name").agg(
        F.count(F.lit(1)).alias("records"))


def changed_years(changed: DataFrame) -> DataFrame:
    """The years that hold the rows to be written, before and after."""
    return changed.select(F.explode(F.array(F.year("values.crash_date"), F.year(F.coalesce("existing.crash_date", "values.crash_date")))).alias("year")).distinct()


def apply_reconciliation(existing: DataFrame, actions: DataFrame) -> DataFrame:
    """New table state with ``action``: untouched rows, updated rows, inserted rows (``crash_id`` NULL)."""
    stored = {"longitude": "lon", "latitude": "lat"}
    back = {stored.get(c, c): c for c in V.CRASH_VALUE_COLUMNS}
    changed = actions.filter(F.col("values").isNotNull())
    updated = changed.filter(F.col("crash_id").isNotNull()).select("crash_id", F.col("values").alias("_v"))
    # Updates meet their crash in one left join; crashes without one stay as they are.
    merged = existing.join(updated, "crash_id", "left").select(*[
        F.when(F.col("_v").isNotNull(), F.col("_v")[back[c]]).otherwise(F.col(c)).alias(c) if c in back else F.col(c)
        for c in existing.columns], F.when(F.col("_v").isNotNull(), "updated").otherwise("kept").alias("action"))
    inserted = changed.filter(F.col("crash_id").isNull()).select(*[
        (F.col("values")[back[c]] if c in back else F.lit(None).cast(existing.schema[c].dataType)).alias(c)
        for c in existing.columns], F.lit("inserted").alias("action"))
    return merged.unionByName(inserted)
