"""Tables kept by year, changed by copying only the years that change.

A table is a folder: ``data`` holds Parquet written by year, one subfolder for each load; ``manifests`` holds, for each version, one row per year that
names the load with its rows.  A change writes the touched years again as a new load, checks the counts that the writing itself observed, and then
publishes a manifest in which the other years keep their old loads.  Readers see whole versions only, and old versions stay readable.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

_MANIFEST = "year int, load string, rows bigint, columns string"
#: The year of rows without a date.
UNDATED = 0


class CountMismatch(RuntimeError):
    """A change touched other rows than it announced; nothing was published."""


def _manifests(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(_MANIFEST).option("basePath", f"{root}/manifests").json(f"{root}/manifests")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current(spark: SparkSession, root: str) -> int | None:
    """The latest version, ``None`` where there is no table yet."""
    found = _manifests(spark, root)
    return None if found is None else found.agg(F.max("version")).first()[0]


def _entries(spark: SparkSession, root: str, version: int | None) -> tuple[dict[int, tuple[str, int]], StructType]:
    """Load and row count of each year of a version (at most one row per calendar year), and the columns."""
    version = current(spark, root) if version is None else version
    rows = _manifests(spark, root).filter(F.col("version") == version).collect()
    if not rows:
        raise ValueError(f"no version {version} at {root}")
    columns = StructType.fromJson(json.loads(rows[0]["columns"]))
    return {r["year"]: (r["load"], r["rows"]) for r in rows if r["load"] is not None}, columns


def _publish(spark: SparkSession, root: str, version: int, entries: dict[int, tuple[str, int]], columns: StructType) -> None:
    rows = [(year, load, n, columns.json()) for year, (load, n) in sorted(entries.items())] or [(None, None, 0, columns.json())]
    # One small file that appears when its job commits; a version that exists is never replaced.
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{root}/manifests/version={version}")


def read(spark: SparkSession, root: str, version: int | None = None, years: Iterable[int] | None = None) -> DataFrame:
    """A version of the table, the latest unless named; ``years`` reads only these partitions."""
    entries, columns = _entries(spark, root, version)
    wanted = [f"{root}/data/part_load={load}/part_year={year}" for year, (load, _) in entries.items() if years is None or year in set(years)]
    if not wanted:
        return spark.createDataFrame([], columns)
    return spark.read.schema(columns).parquet(*wanted)


def _write(rows: DataFrame, root: str, date: str, watch: Observation, counted: dict) -> str:
    load = uuid.uuid4().hex
    dated = rows.withColumn("part_year", F.coalesce(F.year(date), F.lit(UNDATED)))
    # Large years are split over tasks, small ones share one: no year is a hot key, and no task writes many small files.
    dated = dated.hint("rebalance", "part_year").observe(watch, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counted.items()])
    dated.drop("action").write.partitionBy("part_year").parquet(f"{root}/data/part_load={load}")
    return load


def _counts(spark: SparkSession, root: str, load: str) -> dict[int, tuple[str, int]]:
    """Rows of each year of a load, read from file footers."""
    schema = "part_year int"
    found = spark.read.schema(schema).parquet(f"{root}/data/part_load={load}").groupBy("part_year").count().collect()
    return {r["part_year"]: (load, r["count"]) for r in found}


def write_checked(state: DataFrame, folder: str, expected: int) -> DataFrame:
    """Write a table with ``action`` to a new folder and read it back without it; ``expected`` rows must be inserted or updated.

    The count is taken by the write itself.  With another count the folder must not be used, and :class:`CountMismatch` says so.
    """
    watch = Observation()
    state.observe(watch, F.count_if(F.col("action").isin("inserted", "updated")).alias("changed")).drop("action").write.mode("errorifexists").parquet(folder)
    if watch.get["changed"] != expected:
        raise CountMismatch(f"affected {watch.get['changed']} rows, expected {expected}: {folder} is not valid")
    return state.sparkSession.read.schema(state.drop("action").schema).parquet(folder)


def create(rows: DataFrame, root: str, date: str, version: int = 1) -> None:
    """Write a whole table as its first version."""
    spark, watch = rows.sparkSession, Observation()
    load = _write(rows, root, date, watch, {})
    _publish(spark, root, version, _counts(spark, root, load) if watch.get["rows"] else {}, rows.schema)


def apply_changes(spark: SparkSession, root: str, date: str, change: Callable[[DataFrame], DataFrame], touched: DataFrame, *,
                  expected: dict[str, int] | None = None, scope: tuple[int, int] | None = None, base: int | None = None,
                  version: int | None = None) -> int:
    """Publish ``change(rows of the touched years)`` as the next version and return its number.

    ``touched`` has the years as ``year``.  ``change`` returns all rows of these years with an ``action``: ``inserted``, or ``updated``, or anything
    else for rows that stay.  Raises :class:`CountMismatch` and publishes nothing when the rows that are not inserted are fewer or more than before, when
    a row left the touched years, or when ``expected`` counts of an action differ.  ``scope`` are the years that may change.
    """
    years = sorted(r["year"] for r in touched.select(F.coalesce("year", F.lit(UNDATED)).alias("year")).distinct().collect())
    base = current(spark, root) if base is None else base
    version = base + 1 if version is None else version
    entries, columns = _entries(spark, root, base)
    if scope and any(not scope[0] <= y <= scope[1] for y in years):
        raise CountMismatch("out_of_scope_year_changed")
    if not years:
        if version > base:
            _publish(spark, root, version, entries, columns)
        return version
    new, watch = change(read(spark, root, base, years)), Observation()
    action = F.coalesce("action", F.lit("kept"))
    load = _write(new.select(*columns.names, "action"), root, date, watch, {
        "inserted": F.count_if(action == "inserted"), "updated": F.count_if(action == "updated"), "strays": F.count_if(~F.col("part_year").isin(years))})
    seen = watch.get
    before = sum(n for year, (_, n) in entries.items() if year in years)
    wrong = {a: (seen[a], n) for a, n in (expected or {}).items() if seen[a] != n}
    if seen["rows"] - seen["inserted"] != before or seen["strays"] or wrong:
        raise CountMismatch(f"mutation_count_mismatch: {before} rows before, {seen}, expected {expected}")
    kept = {year: entry for year, entry in entries.items() if year not in years}
    _publish(spark, root, version, kept | _counts(spark, root, load), columns)
    return version
