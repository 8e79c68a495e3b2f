"""Crash and person archives: positional text files, plain or zipped, by county and year.

A file is unpacked and cut into rows once, by the task that holds it.  Records that are split over rows are put together afterwards, by windows over
the kinds of the rows, so that this and all that follows spreads over the cluster.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hazardgrid import fixed_values as V
from hazardgrid.functions.text import normalize_county, strip
from hazardgrid.operators.validation import tag_person
from hazardgrid.session import stage

_BATCH = 20_000
#: Rows of a file that one window looks at.
_BLOCK = 50_000


class ArchiveError(ValueError):
    """An archive that must be refused as a whole."""


def archive_inventory(paths: DataFrame, column: str = "path") -> DataFrame:
    """Add ``county`` and ``year`` from ``<County><Year>Accidents`` style names."""
    name = F.element_at(F.split(column, "/"), -1)
    found = r"^([A-Za-z ]+?)(\d{4})(Accidents|Pedestrians)"
    return paths.withColumn("county", normalize_county(F.regexp_extract(name, found, 1))).withColumn(
        "year", F.regexp_extract(name, found, 2).try_cast("int"))


def requested_counties(names: list[str]) -> list[str]:
    """Canonical names without repeats, in the order asked for."""
    known = {re.sub("[^A-Z]", "", c.upper()): c for c in V.COUNTIES}
    out = []
    for name in names:
        county = known.get(re.sub("[^A-Z]", "", name.upper()))
        if county is None:
            raise ValueError(f"unknown county: {name}")
        out.append(county)
    return list(dict.fromkeys(out))


# --- records split over rows ------------------------------------------------------
#
# The number of columns says what a row can be: a whole record, the head of a split one (a column short), a piece of its text (one column), its end (two
# columns, the second a number), blank, or something else.  Whole records, heads and misfits always begin a stretch, whatever came before; pieces, ends
# and blanks belong to the stretch they stand in.  Only a stretch that a head began can become a record, up to its first end or the piece too many.

WHOLE, HEAD, PIECE, END, BLANK, MISFIT = "whole", "head", "piece", "end", "blank", "misfit"


def row_kind(cells: Column) -> Column:
    width, n = len(V.ARCHIVE_COLUMNS), F.size(cells)
    number = strip(F.try_element_at(cells, F.lit(2))).rlike("^[0-9\u00b2\u00b3\u00b9]+$")
    return (F.when(n == width, WHOLE).when(n == width - 1, HEAD).when(n == 1, PIECE).when(n <= 0, BLANK)
            .when((n == 2) & number, END).otherwise(MISFIT))


def _with_stretch(rows: DataFrame) -> DataFrame:
    """Add ``start, begun`` (line and kind of the row that began the stretch) and ``before`` (the same of the row's predecessor).

    Windows look at blocks of a file; what the blocks before left open is a row for each block.
    """
    rows = rows.withColumn("block", F.floor(F.col("line") / _BLOCK))
    opener = F.when(F.col("kind").isin(WHOLE, HEAD, MISFIT), F.struct("line", "kind"))
    in_block = Window.partitionBy("archive", "block").orderBy("line")
    earlier = in_block.rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("archive", "block").agg(F.max(opener).alias("last")).withColumn("carried", F.last("last", ignorenulls=True).over(
        Window.partitionBy("archive").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    own = rows.withColumns({"_own": F.last(opener, ignorenulls=True).over(in_block), "_before": F.last(opener, ignorenulls=True).over(earlier)})
    own = own.filter(F.col("kind") != WHOLE).join(carried, ["archive", "block"])
    return own.withColumns({"start": F.coalesce("_own.line", "carried.line"), "begun": F.coalesce("_own.kind", "carried.kind"),
                            "before": F.coalesce("_before", "carried")}).drop("_own", "_before", "carried", "block")


def repair_split_records(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(records, rejects)`` of rows ``archive, line, cells`` in file order: ``archive, line, cells`` of whole width, and ``archive, line, reason``.

    ``line`` is that of the record's first row.  A head joins at most ``CONTINUATION_LINES`` pieces of ``CONTINUATION_CHARS`` characters together with its
    end; its last text column takes the pieces and the end's first column.  A head that finds no end is rejected, and the piece too many or the misfit
    that stopped it goes with it; every other row that belongs to no record is a reject of its own.  No cells count as a blank row.
    """
    rows = rows.select("archive", "line", "cells", row_kind(F.col("cells")).alias("kind"))
    whole = rows.filter(F.col("kind") == WHOLE).select("archive", "line", "cells")
    loose = stage(_with_stretch(rows.withColumn("cells", F.when(F.col("kind") != WHOLE, F.col("cells")))), "archive-loose")
    stretch = Window.partitionBy("archive", "start")
    so_far = stretch.orderBy("line")
    text = strip(F.get("cells", F.lit(0)))
    piece = F.col("kind") == PIECE
    headed = loose.filter(F.col("begun") == HEAD).withColumns({
        "pieces": F.count_if(piece).over(so_far), "chars": F.sum(F.when(piece, F.length(text)).otherwise(0)).over(so_far)})
    too_many = piece & ((F.col("pieces") > V.CONTINUATION_LINES) | (F.col("chars") > V.CONTINUATION_CHARS))
    headed = headed.withColumn("stop", F.min(F.when(too_many | (F.col("kind") == END), F.col("line"))).over(stretch))
    inside = F.col("stop").isNull() | (F.col("line") <= F.col("stop"))
    parts = headed.filter(inside & (F.col("kind") != BLANK)).groupBy("archive", "start").agg(
        F.max(F.when(F.col("kind") == HEAD, F.col("cells"))).alias("head"), F.max(F.when(F.col("kind") == END, F.col("cells"))).alias("end"),
        F.sort_array(F.collect_list(F.when(piece, F.struct("line", text.alias("text"))))).alias("texts"))
    parts = stage(parts, "archive-split")
    complete = F.col("end").isNotNull()
    last = V.DAMAGE_COLUMN
    damage = F.array_join(F.filter(F.concat(
        F.array(strip(F.get("head", F.lit(last)))), F.transform("texts", lambda t: t["text"]), F.array(strip(F.get("end", F.lit(0))))), lambda t: t != ""), " ")
    mended = parts.filter(complete).select("archive", F.col("start").alias("line"), F.concat(
        F.slice("head", 1, last), F.array(damage, F.get("end", F.lit(1)))).alias("cells"))
    open_heads = parts.filter(~complete).select("archive", F.col("start").alias("line"))
    # A misfit that stopped an open head is no reject of its own.
    stopped = loose.filter((F.col("kind") == MISFIT) & (F.col("before.kind") == HEAD)).select("archive", "line", F.col("before.line").alias("start"))
    closed = headed.filter(F.col("stop").isNotNull()).select("archive", "start").distinct()
    spared = stopped.join(closed, ["archive", "start"], "left_anti").select("archive", "line")
    alone = (
        loose.filter(F.coalesce(F.col("begun") != HEAD, F.lit(True))).select("archive", "line")
        .unionByName(headed.filter(F.col("line") > F.col("stop")).select("archive", "line"))
        .join(spared, ["archive", "line"], "left_anti"))
    return whole.unionByName(mended), open_heads.unionByName(alone).withColumn("reason", F.lit("schema_columns"))


# --- files ------------------------------------------------------------------------

def _open_text(path: str, content: bytes, ending: str) -> io.TextIOBase:
    if path.lower().endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            members = [m for m in archive.namelist() if m.lower().endswith(ending)]
            if len(members) != 1 or "/" in members[0]:
                raise ArchiveError(f"{path}: expected exactly one top-level *{ending} member")
            raw = archive.open(members[0])
            return io.TextIOWrapper(raw, encoding="latin-1", newline="")
    return io.TextIOWrapper(io.BytesIO(content), encoding="latin-1", newline="")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def scan_crash_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)``: 50 trimmed text columns with ``archive, source_county, source_year, line``.

    A file that cannot be opened gives one reject, the others go on.
    """
    return read_crash_files(_files(spark, path))


def _file_rows(files: DataFrame, ending: str, strict: bool) -> DataFrame:
    """``archive, county, year, line, cells, reason``, staged: every row of every file; a file that cannot be read ends with a row with a reason."""
    schema = "archive string, county string, year int, line long, cells array<string>, reason string"
    names = ["archive", "county", "year", "line", "cells", "reason"]

    def rows_of(path: str, content: bytes) -> Iterator[tuple[int, list[str] | None, str | None]]:
        line = 0
        try:
            for line, cells in enumerate(csv.reader(_open_text(path, content, ending), strict=strict), 1):
                yield line, cells, None
        except (ArchiveError, zipfile.BadZipFile, csv.Error, OSError):
            yield line + 1, None, "archive_invalid"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, county, year in zip(*(batch.column(i).to_pylist() for i in range(4))):
                waiting: list[tuple] = []
                for row in rows_of(path, content):
                    waiting.append((path, county, year, *row))
                    if len(waiting) >= _BATCH:
                        yield _batch(waiting)
                        waiting = []
                if waiting:
                    yield _batch(waiting)

    types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.string()]

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), types)], names)

    return stage(archive_inventory(files.select("path", "content")).select("path", "content", "county", "year").mapInArrow(read, schema), "archive-rows")


def read_crash_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As :func:`scan_crash_archive` for a frame of ``path, content``; every file is unpacked once."""
    rows = _file_rows(files, "accidents.txt", strict=False)
    # One row for each file: what its name says.
    names = rows.groupBy("archive").agg(F.first("county").alias("source_county"), F.first("year").alias("source_year"))
    records, rejects = repair_split_records(rows.filter("reason IS NULL"))
    rejects = rejects.unionByName(rows.filter("reason IS NOT NULL").select("archive", "line", "reason"))
    cells = [strip(F.get("cells", F.lit(i))).alias(c) for i, c in enumerate(V.ARCHIVE_COLUMNS)]
    keys = ["archive", "source_county", "source_year", "line"]
    return records.join(names, "archive").select(*keys, *cells), rejects.join(names, "archive").select(*keys, "reason")


def scan_person_archive(spark: SparkSession, path: str, county: str | Column | None = None,
                        year: int | Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``(rows, refused)``: person rows with key and bicycle flag of sound archives, and ``archive, line, reason`` of the first bad row of each other.

    County and year default to what the file name says; an archive outside the known years, or whose name says neither, is refused.  Sound archives
    load whatever happens to the others.
    """
    rows = _file_rows(_files(spark, path), "pedestrians.txt", strict=True)
    if county is not None:
        rows = rows.withColumn("county", F.lit(county) if isinstance(county, str) else county)
    if year is not None:
        rows = rows.withColumn("year", F.lit(year) if isinstance(year, int) else year)
    return judge_person_rows(rows)


def judge_person_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As :func:`scan_person_archive` for rows ``archive, county, year, line, cells, reason``."""
    first, last = V.PERSON_YEARS
    named = F.col("county").isNotNull() & F.coalesce(F.col("year").between(first, last), F.lit(False))
    tagged = tag_person(rows.filter("reason IS NULL").withColumnRenamed("cells", "columns").drop("reason"), F.col("county"), F.col("year"))
    tagged = tagged.withColumn("reason", F.when(~named, "archive_name").otherwise(F.col("reason")))
    bad = tagged.filter("reason IS NOT NULL").select("archive", "line", "reason").unionByName(
        rows.filter("reason IS NOT NULL").select("archive", "line", "reason"))
    # One verdict for each archive, with a map-side minimum; there are few archives.
    refused = bad.groupBy("archive").agg(F.min(F.struct("line", "reason")).alias("first")).select("archive", "first.line", "first.reason")
    return tagged.join(refused.select("archive"), "archive", "left_anti").drop("columns", "reason"), refused
