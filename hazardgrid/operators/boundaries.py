"""Spatial joins of points, paths and polygons with polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hazardgrid.functions import spatial as S
from hazardgrid.operators.grid import (
    cell_index, explode_edge_cells, explode_edges, level_size, levels_in_use, point_cells, polygon_cells,
    polygon_rows,
)

_CELL = ["level", "cx", "cy"]


def point_covered(points: DataFrame, munis: DataFrame, out: str = "covered",
                  lon: str = "lon", lat: str = "lat", within: float = S.EXACT_DEG) -> DataFrame:
    """Whether the point lies in its own municipality, boundary included (and what is ``within`` degrees of it).

    One join on (municipality, latitude row); a missing point is not covered.
    """
    rows = polygon_rows(munis.select("muni_id", "rings"))
    bands = rows.select("muni_id", F.col("cy").alias("_row"), "band")
    # The row height belongs to the municipality, so it is looked up first.
    heights = rows.select("muni_id", level_size(F.col("level")).alias("_height")).distinct()
    return (
        points.join(heights, "muni_id", "left")
        .withColumn("_row", cell_index(F.col(lat), F.col("_height")))
        .join(bands, ["muni_id", "_row"], "left")
        .withColumn(out, F.coalesce(S.covered_by(F.col(lon), F.col(lat), F.col("band"), within), F.lit(False)))
        .drop("_row", "_height", "band")
    )


def assign_boundary(points: DataFrame, munis: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Left spatial join: the municipality a point lies strictly within.

    One row per match, so overlapping boundaries give several; points without a
    match keep one row with NULL.  ``points`` needs a unique ``crash_id``.
    """
    cells = polygon_cells(munis.select("muni_id", "rings"))
    probes = point_cells(points.select("crash_id", lon, lat), levels_in_use(cells), lon, lat)
    hits = probes.join(cells, _CELL).filter(S.inside_of(F.col(lon), F.col(lat), F.col("band"))).select("crash_id", "muni_id")
    return points.drop("muni_id").join(hits, "crash_id", "left")


def lines_meeting_polygons(lines: DataFrame, polygons: DataFrame, key: str = "segment_id") -> DataFrame:
    """Pairs of a path and a polygon that share a point: ``key`` plus the polygon columns.

    A pair can repeat when several of its cells witness the contact.
    """
    cells = polygon_cells(polygons)
    levels = levels_in_use(cells) or [0]
    edges = explode_edges(lines.select(key, "pts")).withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
    size = level_size(F.col("level"))
    probes = explode_edge_cells(edges, size, F.lit(1e-9), F.lit(1e-9)).withColumn("_size", size)
    joined = probes.join(cells, _CELL)
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))

    def vertex_inside(x, y):
        return (cell_index(y, F.col("_size")) == F.col("cy")) & S.covered_by(x, y, F.col("band"))

    meets = vertex_inside(ax, ay) | vertex_inside(bx, by) | F.exists("band", lambda e: S.segments_meet(ax, ay, bx, by, e))
    carried = [c for c in polygons.columns if c != "rings"]
    return joined.filter(meets).select(key, *carried)


def assign_boundary_intersects(lines: DataFrame, munis: DataFrame, key: str = "segment_id") -> DataFrame:
    """Left spatial join of paths: one row per municipality met, NULL when none."""
    hits = lines_meeting_polygons(lines, munis.select("muni_id", "rings"), key).distinct()
    return lines.drop("muni_id").join(hits, key, "left")


def polygons_meeting_polygons(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Distinct key pairs of polygons that share a point."""
    def outline(df, key):
        return df.select(key, F.explode("rings").alias("pts"))
    a = lines_meeting_polygons(outline(left, left_key), right.select(right_key, "rings"), left_key)
    # What remains is a right polygon wholly inside a left one.
    b = lines_meeting_polygons(outline(right, right_key), left.select(left_key, "rings"), right_key)
    return a.select(left_key, right_key).unionByName(b.select(left_key, right_key)).distinct()


def tracts_touching_boundary(tracts: DataFrame, munis: DataFrame) -> DataFrame:
    """``muni_id, tract_id`` pairs that share a point."""
    return polygons_meeting_polygons(tracts.select("tract_id", "rings"), munis.select("muni_id", "rings"),
                                     "tract_id", "muni_id").select("muni_id", "tract_id")


def assign_tract_municipality(tracts: DataFrame, munis: DataFrame) -> DataFrame:
    """Left spatial join of tracts: one row per municipality met."""
    return tracts.drop("muni_id").join(tracts_touching_boundary(tracts, munis), "tract_id", "left")
