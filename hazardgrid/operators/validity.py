"""Validity of polygons: sides that cross or fold back, found by a join on grid cells, whatever the number of vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hazardgrid.functions import spatial as S
from hazardgrid.operators.grid import explode_edge_cells, level_size
from hazardgrid.session import stage


def _numbered_sides(polygons: DataFrame) -> DataFrame:
    """``id, ring, k, n, level, ax, ay, bx, by``: side ``k`` of ``n`` of each ring; cells are about as long as the polygon's mean side."""
    length = F.aggregate("_sides", F.lit(0.0), lambda a, e: a + F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))
    mean = length / F.greatest(F.size("_sides"), F.lit(1))
    level = F.ceil(F.log2(F.greatest(mean, F.lit(1e-9)) / level_size(F.lit(0)))).cast("int")
    rings = polygons.withColumn("_sides", S.ring_edges(F.col("rings"))).select("id", level.alias("level"), F.posexplode("rings").alias("ring", "pts"))
    proper = rings.withColumn("sides", F.filter(S.edges(F.col("pts")), lambda e: e["a"] != e["b"]))      # a repeated vertex makes no side
    return proper.select("id", "level", "ring", F.size("sides").alias("n"), F.posexplode("sides").alias("k", "e")).select(
        "id", "ring", "k", "n", "level", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def _crossings(sides: DataFrame) -> DataFrame:
    """``id, reason`` of pairs of sides that may not share a point: of one ring, unless neighbours that do not fold back; of two rings, if they cross."""
    listed = explode_edge_cells(sides, level_size(F.col("level")), F.lit(1e-12), F.lit(1e-12)).drop("level")
    other = listed.select("id", "cx", "cy", F.col("ring").alias("oring"), F.col("k").alias("ok"), F.struct(
        S.point(F.col("ax"), F.col("ay")).alias("a"), S.point(F.col("bx"), F.col("by")).alias("b")).alias("o"))
    same = F.col("ring") == F.col("oring")
    pairs = listed.join(other, ["id", "cx", "cy"]).filter((F.col("ring") < F.col("oring")) | (same & (F.col("k") < F.col("ok"))))
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    ux, uy, vx, vy = bx - ax, by - ay, F.col("o.b.x") - F.col("o.a.x"), F.col("o.b.y") - F.col("o.a.y")
    folds = (ux * vy == uy * vx) & (ux * vx + uy * vy < 0)
    neighbours = (F.col("k") + 1 == F.col("ok")) | ((F.col("k") == 0) & (F.col("ok") == F.col("n") - 1))
    wrong = F.when(~same, S.segments_cross(ax, ay, bx, by, F.col("o"))).when(neighbours, folds).otherwise(S.segments_meet(ax, ay, bx, by, F.col("o")))
    return pairs.filter(wrong).select("id", F.when(same, "self_intersection").otherwise("ring_crossing").alias("reason"))


def polygon_problems(polygons: DataFrame) -> DataFrame:
    """``id, reason`` of unusable polygons among ``id, rings`` (closed rings, holes by the even-odd rule).

    ``empty_geometry``: no ring left; ``self_intersection``: a ring meets or runs back over itself; ``ring_crossing``: a hole goes through its shell, or two
    rings cross otherwise (touching is allowed).  Every side meets only the sides of its own polygon in its own cells.
    """
    empty = F.col("rings").isNull() | (F.size("rings") <= 0)
    some = polygons.filter(~empty)
    found = _crossings(_numbered_sides(some)).groupBy("id").agg(F.max("reason").alias("reason"))
    return found.unionByName(polygons.filter(empty).select("id", F.lit("empty_geometry").alias("reason")))


def geometry_audit(df: DataFrame, rings: str = "rings", srid: str | None = None) -> DataFrame:
    """Counts of unusable geometries and of rows in another reference system."""
    other = F.lit(False) if srid is None else F.coalesce(F.col(srid) != 4326, F.lit(False))
    kept = stage(df.select(F.monotonically_increasing_id().alias("id"), F.col(rings).alias("rings"), other.alias("_other")), "geometry-audit")
    problems = polygon_problems(kept.select("id", "rings")).select("id", F.lit(1).alias("_bad"))
    return kept.select("id", "_other").join(problems, "id", "left").agg(
        F.count("_bad").alias("invalid_geometries"), F.count_if("_other").alias("other_srid"))


def repair_polygon(df: DataFrame, rings: str = "rings") -> tuple[DataFrame, DataFrame]:
    """``(usable, rejects)`` after closing rings and dropping degenerate ones; rejects have a ``reason``."""
    fixed = stage(df.withColumn(rings, S.repair_rings(F.col(rings))).withColumn("_row", F.monotonically_increasing_id()), "polygon-repair")
    problems = stage(polygon_problems(fixed.select(F.col("_row").alias("id"), F.col(rings).alias("rings"))).withColumnRenamed("id", "_row"), "polygon-problems")
    return fixed.join(problems, "_row", "left_anti").drop("_row"), fixed.join(problems, "_row").drop("_row")
