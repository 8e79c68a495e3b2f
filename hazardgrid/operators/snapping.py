"""Crash-to-segment assignment: nearest segment of the same municipality.

Plan: road edges are listed per padded grid cell and gathered into one array per
(municipality, cell).  A crash then needs exactly one equi join on its own cell
and picks the nearest edge inside the array, so the crash table is shuffled at
most once, never multiplied, and never grouped again.  When the index is small
Spark broadcasts it on its measured size and the crashes do not move at all; hot
cells on the crash side are split by AQE's skew join.

Identical edges are merged first (the lowest segment id wins every tie, so the
others can never be chosen).  Cells with more edges than an array may hold are split
over several rows.  What is nearest depends on the point alone, so only the distinct
points in such cells are aggregated and joined back; rows are never told apart by an
id, and the result is the same for every bound.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from hazardgrid import fixed_values as V
from hazardgrid.functions import spatial as S
from hazardgrid.operators.grid import cell_index, explode_edge_cells, explode_edges

EDGES_PER_ROW = 4096


def validate_distance(distance_m) -> float:
    """A finite distance of at least zero, or ValueError before any work starts."""
    try:
        value = float(distance_m)
    except (TypeError, ValueError):
        value = math.nan
    if not math.isfinite(value) or value < 0:
        raise ValueError("Snap distance must be a finite nonnegative number")
    return value


def snap_cell_deg(distance_m: float) -> float:
    return max(4 * distance_m / S.MIN_METERS_PER_DEGREE, 0.001)


def segment_edge_cells(roads: DataFrame, distance_m: float) -> DataFrame:
    """``muni_id, cx, cy, segment_id, ax, ay, bx, by`` for every cell an edge can serve."""
    edges = explode_edges(roads.select("muni_id", "segment_id", "pts"))
    merged = edges.groupBy("muni_id", "ax", "ay", "bx", "by").agg(F.min("segment_id").alias("segment_id"))
    pad_lat = distance_m * 1.01 / S.MIN_METERS_PER_DEGREE + 1e-9
    top = F.least(F.greatest(F.abs("ay"), F.abs("by")) + pad_lat, F.lit(89.0))
    pad_lon = F.lit(pad_lat) / F.cos(F.radians(top))
    return explode_edge_cells(merged, F.lit(snap_cell_deg(distance_m)), F.lit(pad_lat), pad_lon)


def _edge_struct() -> Column:
    """An edge with everything that depends on it alone.

    ``t = (px - ax) * gx + (py - ay) * gy`` is the foot of a point on the edge, and
    the metric scale at any latitude follows from the one at the edge's middle.
    """
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    scale = S.local_scale((ay + by) / 2)
    ex, ey = bx - ax, by - ay
    wx, wy = ex * scale["kx"] * scale["kx"], ey * scale["ky"] * scale["ky"]
    length2 = ex * wx + ey * wy
    return F.struct(
        "segment_id", "ax", "ay", ex.alias("ex"), ey.alias("ey"),
        F.coalesce(F.try_divide(wx, length2), F.lit(0.0)).alias("gx"),
        F.coalesce(F.try_divide(wy, length2), F.lit(0.0)).alias("gy"),
        scale["kx"].alias("kx"), scale["ky"].alias("ky"),
        scale["dkx"].alias("dkx"), scale["dky"].alias("dky"),
    )


def _edge_index(cells: DataFrame, edges_per_row: int) -> tuple[DataFrame, DataFrame | None]:
    """One row per cell with its edge array, and the arrays of overfull cells (None if there are none).

    An overfull cell has an empty array and ``_overfull`` in the first table, and several rows in the second.
    """
    keys = ["muni_id", "cx", "cy"]
    counts = cells.groupBy(*keys).agg(F.count("*").alias("n"))
    densest = counts.agg(F.max("n")).first()[0] or 0          # one number
    if densest <= edges_per_row:
        return cells.groupBy(*keys).agg(F.collect_list(_edge_struct()).alias("near"), F.lit(False).alias("_overfull")), None
    counted = cells.join(counts, keys)
    overfull = F.col("n") > edges_per_row
    single = counted.groupBy(*keys).agg(
        F.collect_list(F.when(~overfull, _edge_struct())).alias("near"), F.max(overfull).alias("_overfull"))
    parts = F.ceil(F.col("n") / edges_per_row).cast("long")
    several = counted.filter(overfull).groupBy(
        *keys, F.pmod(F.xxhash64("ax", "ay", "bx", "by"), parts).alias("_part")).agg(F.collect_list(_edge_struct()).alias("near"))
    return single, several.drop("_part")


def nearest_in(near: Column, distance_m: float) -> Column:
    """Best ``struct(um, segment_id)`` of an edge array within the radius.

    Distances compare as whole micrometres: far below the accuracy of any source,
    and equal for edges that are equally near.  Each step names a value that the
    next one uses more than once, because lambda bodies are not shared otherwise.
    """
    px, py = F.col("lon"), F.col("lat")
    feet = F.transform(near, lambda e: F.struct(e.alias("e"), F.least(F.greatest(
        (px - e["ax"]) * e["gx"] + (py - e["ay"]) * e["gy"], F.lit(0.0)), F.lit(1.0)).alias("t")))
    offsets = F.transform(feet, lambda f: F.struct(
        f["e"].alias("e"),
        (f["e"]["ax"] + f["t"] * f["e"]["ex"] - px).alias("dx"),
        (f["e"]["ay"] + f["t"] * f["e"]["ey"] - py).alias("dy"),
        # Middle latitude of point and foot, relative to the edge's middle.
        ((py - f["e"]["ay"] + (f["t"] - 1) * f["e"]["ey"]) / 2).alias("rise")))
    measured = F.transform(offsets, lambda o: F.struct(
        F.hypot(o["dx"] * (o["e"]["kx"] + o["e"]["dkx"] * o["rise"]),
                o["dy"] * (o["e"]["ky"] + o["e"]["dky"] * o["rise"])).alias("d"),
        o["e"]["segment_id"].alias("segment_id")))
    ranked = F.transform(measured, lambda m: F.struct(
        (m["d"] * 1e6 + 0.5).cast("long").alias("um"), m["segment_id"].alias("segment_id"), m["d"].alias("distance")))
    return F.array_min(F.filter(ranked, lambda r: r["um"] <= F.lit(int(distance_m * 1e6 + 0.5))))


def snap_crashes(crashes: DataFrame, roads: DataFrame, *, distance_m: float = V.SNAP_DISTANCE_M,
                 muni_id: int | None = None, force: bool = True, key: tuple[str, ...] = ("crash_id",),
                 edges_per_row: int = EDGES_PER_ROW) -> DataFrame:
    """Set ``segment_id`` and ``snap_distance`` of every crash in scope.

    The nearest segment within ``distance_m`` (inclusive) wins, the lowest id on
    a tie; without one both columns are cleared.  ``force=False`` leaves crashes
    alone that already have a segment; ``muni_id`` leaves other municipalities
    alone.  ``key`` only spreads crashes without a cell over the tasks; equal and null keys are
    kept apart like any other rows.
    """
    distance_m = validate_distance(distance_m)
    for name, kind in (("segment_id", "bigint"), ("snap_distance", "double")):
        if name not in crashes.columns:
            crashes = crashes.withColumn(name, F.lit(None).cast(kind))
    if muni_id is not None:
        roads = roads.filter(F.col("muni_id") == muni_id)
    single, several = _edge_index(segment_edge_cells(roads, distance_m), edges_per_row)
    in_scope = F.lit(True)
    if muni_id is not None:
        in_scope = F.coalesce(F.col("muni_id") == muni_id, F.lit(False))
    if not force:
        in_scope = in_scope & F.col("segment_id").isNull()

    size = snap_cell_deg(distance_m)
    columns = crashes.columns
    probes = (
        crashes.withColumn("_scope", in_scope)
        .withColumn("cx", F.when(F.col("_scope"), cell_index(F.col("lon"), F.lit(size))))
        .withColumn("cy", F.when(F.col("_scope"), cell_index(F.col("lat"), F.lit(size))))
    )
    # Crashes without a cell match nothing; under one null key they would all meet in one task.
    idle = F.col("muni_id").isNull() | F.col("cx").isNull() | F.col("cy").isNull()
    probes = probes.withColumn("_spread", F.when(idle, F.xxhash64(*key)).otherwise(F.lit(0)))
    found = probes.join(single.withColumn("_spread", F.lit(0).cast("bigint")), ["muni_id", "cx", "cy", "_spread"], "left").withColumn(
        "_best", nearest_in(F.col("near"), distance_m)).drop("near")
    if several is not None:
        overfull = F.coalesce("_overfull", F.lit(False))
        crowded = found.filter(overfull).drop("_best")
        best = (
            crowded.select("muni_id", "cx", "cy", "lon", "lat").distinct().join(several, ["muni_id", "cx", "cy"])
            .withColumn("_best", nearest_in(F.col("near"), distance_m))
            .groupBy("muni_id", "lon", "lat").agg(F.min("_best").alias("_best"))
        )
        found = found.filter(~overfull).unionByName(crowded.join(best, ["muni_id", "lon", "lat"], "left"))
    return found.withColumns({
        "segment_id": F.when(F.col("_scope"), F.col("_best.segment_id")).otherwise(F.col("segment_id")),
        "snap_distance": F.when(F.col("_scope"), F.col("_best.distance")).otherwise(F.col("snap_distance")),
    }).select(*columns)


def nearest_segment(crashes: DataFrame, roads: DataFrame, distance_m: float,
                    key: tuple[str, ...] = ("crash_id",)) -> DataFrame:
    """Nearest segment per crash as ``key, segment_id, distance`` without touching the input."""
    snapped = snap_crashes(
        crashes.select(*key, "muni_id", "lon", "lat"), roads, distance_m=distance_m, key=key)
    return snapped.select(*key, "segment_id", F.col("snap_distance").alias("distance"))


def crashes_within(crashes: DataFrame, roads: DataFrame, distance_m: float,
                   key: tuple[str, ...] = ("crash_id",)) -> DataFrame:
    """Crashes with at least one segment of their municipality within the distance."""
    near = nearest_segment(crashes, roads, distance_m, key)
    return near.filter(F.col("segment_id").isNotNull()).select(*key)
