"""Dashboard reconciliation: compute every outcome, then write all of it or nothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from hazardgrid import fixed_values as V
from hazardgrid.operators import reconcile as R
from hazardgrid.operators import snapshots
from hazardgrid.operators.validation import audit_counts, duplicate_identity_audit, tag_dashboard
from hazardgrid.session import spread_rows, stage


@dataclass(frozen=True)
class Staged:
    """Audited rows, the records fit for matching and the counts per year."""

    audited: DataFrame
    records: DataFrame
    counts: DataFrame


@dataclass(frozen=True)
class Reconciled:
    """Actions of a run, its counters, and the new table state when it was applied."""

    actions: DataFrame
    outcomes: DataFrame
    report: DataFrame
    state: DataFrame | None


def stage_and_audit(raw: DataFrame, munis: DataFrame, **provenance) -> Staged:
    """Validate a whole export (with ``line``) and resolve repeated identities.

    The validated rows are written once, with a digest of their payload; the audit groups narrow rows: ids, line and digest.
    """
    audited = duplicate_identity_audit(tag_dashboard(spread_rows(raw), munis, **provenance))
    records = audited.filter(F.col("reason").isNull() & ~F.col("repeat")).drop("reason", "repeat", "line", "source_year")
    return Staged(audited, records, audit_counts(audited))


def run_reconciliation(records: DataFrame, crashes: DataFrame, munis: DataFrame, *, allow_new: bool = False,
                       apply_to: str | None = None) -> Reconciled:
    """Outcomes of all records; with ``apply_to`` the changes are published there as a snapshot.

    A dry run writes nothing but staged actions.  An applied run merges into ``crashes``, the table at ``apply_to`` (see
    :mod:`hazardgrid.operators.snapshots`) or, if there is none yet, its first content.  Only years that a record touches are written, and the snapshot
    is published only if the counts taken while writing agree: exactly the inserted and updated records changed, years outside the export's scope did
    not, and no row was lost.
    """
    records = stage(records, "dashboard-records")       # several narrow tables are made of it
    actions = stage(R.reconcile_dashboard(R.match_records(records, crashes, munis), allow_new), "dashboard-actions")
    outcomes, report = R.reconciliation_outcomes(actions), R.reconciliation_report(actions)
    if apply_to is None:
        return Reconciled(actions, outcomes, report, None)
    changed = actions.filter(F.col("values").isNotNull())
    if changed.isEmpty():
        return Reconciled(actions, outcomes, report, crashes)       # nothing to write
    spark = crashes.sparkSession
    if snapshots.current(spark, apply_to) is None:
        snapshots.create(crashes, apply_to, "crash_date")
    wanted = {r["outcome"]: r["n"] for r in changed.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
    snapshots.apply_changes(
        spark, apply_to, "crash_date", lambda rows: R.apply_reconciliation(rows, changed), R.changed_years(changed),
        expected={"updated": wanted.get("updated", 0), "inserted": wanted.get("inserted", 0)}, scope=V.DASHBOARD_YEARS)
    return Reconciled(actions, outcomes, report, snapshots.read(spark, apply_to))
