"""Grid keys that turn spatial joins into equi joins.

A geometry is listed under every cell it may touch, a probe looks up its own
cells, and the exact test runs on the matches.  Two forms:

* edges of paths, walked row by row so that a long diagonal edge costs cells in
  proportion to its length, not to its bounding box;
* polygons, each at a level whose cells are about a quarter of its extent, so a
  polygon always has a bounded number of cells, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hazardgrid.functions import spatial as S

BASE_CELL_DEG = 0.001
_MAX_LEVEL = 20


def cell_index(value: Column, size) -> Column:
    return F.floor(value / size).cast("long")


def explode_edge_cells(df: DataFrame, size, pad_lat, pad_lon) -> DataFrame:
    """Add ``cx, cy`` for every cell the padded edge (ax, ay)-(bx, by) can touch."""
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    rows = df.withColumn("cy", F.explode(F.sequence(
        cell_index(F.least(ay, by) - pad_lat, size), cell_index(F.greatest(ay, by) + pad_lat, size))))
    # The stretch of the edge inside this padded row, as fractions of the edge.
    low = F.try_divide(F.col("cy") * size - pad_lat - ay, by - ay)
    high = F.try_divide((F.col("cy") + 1) * size + pad_lat - ay, by - ay)
    t0 = F.greatest(F.least(low, high), F.lit(0.0))
    t1 = F.least(F.greatest(low, high), F.lit(1.0))
    x0 = F.when(ay == by, ax).otherwise(ax + t0 * (bx - ax))
    x1 = F.when(ay == by, bx).otherwise(ax + t1 * (bx - ax))
    return rows.withColumn("cx", F.explode(F.sequence(
        cell_index(F.least(x0, x1) - pad_lon, size), cell_index(F.greatest(x0, x1) + pad_lon, size))))


def explode_edges(df: DataFrame, pts: str = "pts") -> DataFrame:
    """One row per edge of a path column, as ``ax, ay, bx, by``."""
    return (
        df.withColumn("_e", F.explode(S.edges(F.col(pts)))).drop(pts)
        .select("*", F.col("_e.a.x").alias("ax"), F.col("_e.a.y").alias("ay"),
                F.col("_e.b.x").alias("bx"), F.col("_e.b.y").alias("by"))
        .drop("_e")
    )


def level_size(level: Column) -> Column:
    return F.lit(BASE_CELL_DEG) * F.pow(F.lit(2.0), level)


def polygon_rows(polygons: DataFrame, rings: str = "rings") -> DataFrame:
    """Replace ``rings`` by rows ``level, cy, band`` (with the extent ``_x0, _x1``).

    ``band`` holds the polygon's edges that reach into the latitude row: all that is
    needed to decide any question about a point in that row.
    """
    box = S.ring_extent(F.col(rings))
    extent = F.greatest(F.col("_box.x1") - F.col("_box.x0"), F.col("_box.y1") - F.col("_box.y0"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent, F.lit(1e-9)) / (4 * BASE_CELL_DEG)))).cast("int")
    sized = (
        polygons.withColumn("_box", box).withColumn("level", F.least(level, F.lit(_MAX_LEVEL)))
        .withColumn("_size", level_size(F.col("level")))
        .withColumn("_edges", S.ring_edges(F.col(rings))).drop(rings)
        .withColumn("cy", F.explode(F.sequence(
            cell_index(F.col("_box.y0"), F.col("_size")), cell_index(F.col("_box.y1"), F.col("_size")))))
    )
    low, high = F.col("cy") * F.col("_size"), (F.col("cy") + 1) * F.col("_size")
    # A hair of slack keeps edges that end exactly on the row limit.
    reach = F.col("_size") * 1e-9
    return (
        sized.withColumn("band", F.filter("_edges", lambda e: (
            (F.greatest(e["a"]["y"], e["b"]["y"]) >= low - reach)
            & (F.least(e["a"]["y"], e["b"]["y"]) <= high + reach))))
        .withColumns({"_x0": F.col("_box.x0"), "_x1": F.col("_box.x1")}).drop("_box", "_size", "_edges")
    )


def polygon_cells(polygons: DataFrame, rings: str = "rings") -> DataFrame:
    """As :func:`polygon_rows`, one row per cell ``level, cx, cy``."""
    size = level_size(F.col("level"))
    return polygon_rows(polygons, rings).withColumn("cx", F.explode(F.sequence(
        cell_index(F.col("_x0"), size), cell_index(F.col("_x1"), size)))).drop("_x0", "_x1")


def levels_in_use(cells: DataFrame) -> list[int]:
    """The polygon levels present: at most 21 small numbers, whatever the data size."""
    return sorted(r[0] for r in cells.select("level").distinct().collect())


def point_cells(points: DataFrame, levels: list[int], x: str = "lon", y: str = "lat") -> DataFrame:
    """Add the cell of each point at every level in use."""
    if not levels:
        levels = [0]
    tagged = points.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
    size = level_size(F.col("level"))
    return tagged.withColumn("cx", cell_index(F.col(x), size)).withColumn("cy", cell_index(F.col(y), size))
