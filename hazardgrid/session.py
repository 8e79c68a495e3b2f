"""Session helpers: settings for jobs and tests, and reliable lineage cuts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Where a local session keeps intermediate data unless told otherwise.
LOCAL_WORK = "/tmp/hazardgrid-work"


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "hazardgrid") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # One-file tables cannot be split; a fact table must not become a broadcast.
        .config("spark.sql.autoBroadcastJoinThreshold", "2m")
        # Reading a shuffle by mapper would leave a one-file table in one task.
        .config("spark.sql.adaptive.localShuffleReader.enabled", "false")
        # Small tables with expensive expressions should still use every core.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", LOCAL_WORK)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate data: ``spark.checkpoint.dir``, else one beside the warehouse.

    The same rule holds for every master; both places are reachable by all executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work").rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(work_folder(spark))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as the cluster has cores, for work that costs much more than moving its rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread_rows(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` in partitions of about ``rows`` rows, at least one for each core: a task of costly work stays short however large the input."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(parts)


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Inside, generated methods above 8,000 bytes of code, which the JVM never compiles, give way to one method for each expression."""
    setting = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "8000")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder below :func:`work_folder` that nobody has used."""
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders staged inside the scopes that are open, innermost last.
_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, every folder that :func:`stage` wrote inside this scope.

    What leaves the scope must not read them any more: stage it with ``keep=True``, or write it, before the scope ends.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove_folder(spark, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that its path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame, name: str = "stage", keep: bool = False, group_mb: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to a new folder below :func:`work_folder` and read it back.

    Like :func:`cut_lineage`, but columnar and compressed, so later readers prune columns.  Inside a :func:`scratch` scope the folder lives as long as the
    scope, with ``keep`` as long as the one around it.  A task that reads rows of a wide column holds a whole row group of it; ``group_mb`` makes these
    smaller than the file system's blocks.
    """
    path = new_folder(df.sparkSession, name)
    scopes = _SCOPES[:-1] if keep else _SCOPES
    if scopes:
        scopes[-1].append(path)
    options = {} if group_mb is None else {"parquet.block.size": group_mb << 20}
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
