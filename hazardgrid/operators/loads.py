"""Counters of load runs, as rows rather than nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def rejection_counts(tagged: DataFrame, key: str = "archive") -> DataFrame:
    """Per archive and kind: how many records had which reason or location method.

    ``tagged`` may carry ``reason``, ``coordinate_issue`` and ``geocode_quality``.
    """
    kinds = [(k, c) for k, c in (("rejection", "reason"), ("coordinate_issue", "coordinate_issue"),
                                 ("location_method", "geocode_quality")) if c in tagged.columns]
    facts = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in kinds])
    return tagged.select(key, F.explode(facts).alias("f")).filter(F.col("f.value").isNotNull()).groupBy(
        key, F.col("f.kind").alias("kind"), F.col("f.value").alias("value")).agg(F.count(F.lit(1)).alias("records"))


def archive_totals(tagged: DataFrame, key: str = "archive") -> DataFrame:
    """Records, loaded, updated, duplicates and rejected per archive.

    ``status`` of a row is loaded, updated, duplicate or rejected.
    """
    return tagged.groupBy(key).agg(
        F.count(F.lit(1)).alias("records"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("loaded", "updated", "duplicate", "rejected")])


def manifest_totals(archives: DataFrame) -> DataFrame:
    """Run totals over archives (``status`` per archive), the number of archives in each status, and the overall status.

    One failed archive fails the run; it has succeeded when there are archives and all of them have.
    """
    state = F.col("status")
    totals = archives.agg(
        F.count(F.lit(1)).alias("archives"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c if c != "duplicate" else "duplicates") for c in ("records", "loaded", "updated", "duplicate", "rejected")],
        F.when(F.coalesce(F.bool_or(state == "failed"), F.lit(False)), "failed")
        .when(F.coalesce(F.bool_and(state == "succeeded"), F.lit(False)), "succeeded").otherwise("running").alias("status"))
    counts = archives.groupBy("status").agg(F.count(F.lit(1)).alias("n")).agg(
        F.array_sort(F.collect_list(F.struct("status", "n"))).alias("status_counts"))
    # Both sides are one row.
    return totals.join(F.broadcast(counts))


def merged_reasons(counts: DataFrame) -> DataFrame:
    """Reason counts over all archives."""
    return counts.groupBy("kind", "value").agg(F.sum("records").alias("records"))


def run_report(pipeline: str, archives: DataFrame, counts: DataFrame, parameters: dict[str, str | int | None]) -> DataFrame:
    """The report of a load run as one row: pipeline, status, parameters, totals, merged counters and the archives.

    ``archives`` as for :func:`manifest_totals`, ``counts`` as from :func:`rejection_counts`.  A run has at most one archive for each county and year, so
    the report stays small; the records behind it are only counted.
    """
    totals = manifest_totals(archives)
    status = F.col("status")
    merged = merged_reasons(counts).agg(F.array_sort(F.collect_list(F.struct("kind", "value", "records"))).alias("counts"))
    listed = archives.agg(F.array_sort(F.collect_list(F.struct(
        "archive", "status", "records", "loaded", "updated", F.col("duplicate").alias("duplicates"), "rejected"))).alias("archive_reports"))
    given = F.create_map(*[F.lit(v) for k, v in sorted(parameters.items()) for v in (k, None if v is None else str(v))]) if parameters else F.create_map()
    # Three tables of one row.
    return totals.join(F.broadcast(merged)).join(F.broadcast(listed)).select(
        F.lit(pipeline).alias("pipeline"), status, given.cast("map<string,string>").alias("parameters"), F.struct(
            "archives", "records", "loaded", "updated", "duplicates", "rejected", "status_counts").alias("totals"), "counts", F.col("archive_reports").alias("archives"))


def companion_totals(persons: DataFrame, key: tuple[str, ...] = ("year", "county")) -> DataFrame:
    """Person rows, cyclist rows and distinct cyclist crashes per archive."""
    per_crash = persons.groupBy(*key, "external_id").agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if("bicycle").alias("_cyclists"))
    return per_crash.groupBy(*key).agg(
        F.sum("_rows").alias("source_rows"), F.sum("_cyclists").alias("source_person_rows"),
        F.count_if(F.col("_cyclists") > 0).alias("source_crashes"))


COMPANION_COUNTERS = ("source_rows", "source_person_rows", "source_crashes", "matched", "updated", "already_known", "unmatched", "conflicting_false")


def companion_report(archives: DataFrame) -> DataFrame:
    """Counters of companion archives (``year, county`` and ``COMPANION_COUNTERS``) summed per year and, with a null year, over all.

    ``archives`` is the number of archives behind a row.
    """
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COMPANION_COUNTERS]
    per_year = archives.groupBy("year").agg(F.count(F.lit(1)).alias("archives"), *sums)
    return per_year.unionByName(per_year.agg(
        F.lit(None).cast("int").alias("year"), F.coalesce(F.sum("archives"), F.lit(0)).alias("archives"), *sums))
