"""Archives loaded as they arrive: each file once, each load a new version of the crash table.

The file source keeps track of what was read.  A micro-batch merges into the version of
the batch before it and publishes its own, so a batch that is run again after a
failure gives the same version instead of merging twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from hazardgrid.operators import snapshots
from hazardgrid.operators.upserts import touched_years, upsert_crashes
from hazardgrid.plans.ingest import empty_crash_table, load_archives
from hazardgrid.session import scratch, stage
from hazardgrid.sources.archives import read_crash_files

FILES = "path string, modificationTime timestamp, length long, content binary"


def load_new_archives(spark: SparkSession, folder: str, root: str, munis: DataFrame, routes: DataFrame,
                      files_per_batch: int = 64) -> StreamingQuery:
    """Load every archive of ``folder`` not loaded before, then stop.

    The crash table is at ``root/crashes`` (:mod:`hazardgrid.operators.snapshots`; a batch writes the years that it touches), totals, reasons and rejected
    rows of each batch at ``root/manifest``, ``root/reasons`` and ``root/rejected``, progress at ``root/progress``.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).load(folder)

    crashes = f"{root}/crashes"

    def load(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        # Version 1 is the empty table; batch n publishes version n + 2 on top of version n + 1.
        if snapshots.current(session, crashes) is None:
            snapshots.create(empty_crash_table(session), crashes, "crash_date")
        base = batch_id + 1
        with scratch(session):          # all that this batch leaves behind is written below
            result = load_archives(*read_crash_files(batch), snapshots.read(session, crashes, base), munis, routes)
            incoming = stage(result.incoming, "archive-incoming")
            if snapshots.current(session, crashes) == base:
                snapshots.apply_changes(session, crashes, "crash_date", lambda old: upsert_crashes(old, incoming),
                                        touched_years(snapshots.read(session, crashes, base), incoming), base=base)
            for name, frame in (("manifest", result.totals), ("reasons", result.reasons), ("rejected", result.rejected)):
                frame.write.mode("overwrite").json(f"{root}/{name}/batch_{batch_id:08d}")

    return (
        files.writeStream.foreachBatch(load).option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True).start()
    )
