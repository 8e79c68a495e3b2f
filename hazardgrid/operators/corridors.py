"""Corridors: connected same-road segments, found without enumerating pairs.

Endpoints that coincide, or fall in the same cell small enough that everything in
it is within the tolerance, are tied to one representative (a star, linear in the
number of endpoints).  Distances are only measured between different positions in
neighbouring cells.  Components then come from alternating large-star and
small-star rounds (Kiveris et al., 2014): logarithmic in the length of a chain,
two aggregations and joins per round, lineage cut after each.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from hazardgrid import fixed_values as V
from hazardgrid.functions import spatial as S
from hazardgrid.functions.text import display_road_name, road_key
from hazardgrid.operators.grid import cell_index
from hazardgrid.operators.ranking import dense_rank
from hazardgrid.session import cut_lineage

MAX_ROUNDS = 200
_MAX_METERS_PER_DEGREE = 111_700.0


def corridor_nodes(results: DataFrame, roads: DataFrame, scope: str = "muni_id") -> DataFrame:
    """One node per significant segment with its road key, name and endpoints."""
    picked = results.filter(F.col("is_significant")).select(F.col(scope).alias("scope"), "segment_id").distinct()
    return picked.join(roads.select("segment_id", "sri", "road_name", "pts"), "segment_id").select(
        "scope", "segment_id",
        road_key(F.col("sri"), F.col("road_name"), F.col("segment_id")).alias("road_key"),
        display_road_name(F.col("road_name"), F.col("sri")).alias("corridor_name"),
        S.start_point(F.col("pts")).alias("start_point"), S.end_point(F.col("pts")).alias("end_point"))


def _endpoints(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        "scope", "road_key", "segment_id", F.explode(F.array("start_point", "end_point")).alias("p"),
    ).select("scope", "road_key", "segment_id", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def _neighbour_cells(points: DataFrame, tol_m: float, size: float) -> DataFrame:
    """Every cell that can hold a position within the tolerance, as ``cx, cy``."""
    pad_lat = tol_m * 1.01 / S.MIN_METERS_PER_DEGREE
    pad_lon = F.lit(pad_lat) / F.cos(F.radians(F.least(F.abs("y") + pad_lat, F.lit(89.0))))
    return (
        points.withColumn("cy", F.explode(F.sequence(
            cell_index(F.col("y") - pad_lat, F.lit(size)), cell_index(F.col("y") + pad_lat, F.lit(size)))))
        .withColumn("cx", F.explode(F.sequence(
            cell_index(F.col("x") - pad_lon, F.lit(size)), cell_index(F.col("x") + pad_lon, F.lit(size)))))
    )


def endpoint_adjacency(nodes: DataFrame, tol_m: float = V.CORRIDOR_TOLERANCE_M) -> DataFrame:
    """All pairs ``source < target`` of one road with endpoints within the tolerance."""
    size = max(tol_m, 0.01) / S.MIN_METERS_PER_DEGREE
    points = _endpoints(nodes).distinct()
    left = _neighbour_cells(points, tol_m, size).withColumnsRenamed({"segment_id": "source", "x": "lx", "y": "ly"})
    right = (
        points.withColumn("cx", cell_index(F.col("x"), F.lit(size)))
        .withColumn("cy", cell_index(F.col("y"), F.lit(size)))
        .withColumnsRenamed({"segment_id": "target"})
    )
    near = F.round(S.point_distance_m(F.col("lx"), F.col("ly"), F.col("x"), F.col("y")), 6) <= tol_m
    return (
        left.join(right, ["scope", "road_key", "cx", "cy"])
        .filter((F.col("source") < F.col("target")) & near)
        .select("scope", "source", "target").distinct()
    )


def directed_edges(edges: DataFrame) -> DataFrame:
    """Each edge in both directions."""
    return edges.unionByName(edges.select("scope", F.col("target").alias("source"), F.col("source").alias("target")))


def linking_edges(nodes: DataFrame, tol_m: float = V.CORRIDOR_TOLERANCE_M) -> DataFrame:
    """Few edges with the same components as :func:`endpoint_adjacency`."""
    keys = ["scope", "road_key"]
    size = max(tol_m, 1e-6) / math.sqrt(2) / _MAX_METERS_PER_DEGREE
    ends = _endpoints(nodes)
    # Everything in one cell is within the tolerance of everything else there.
    spots = (
        ends.groupBy(*keys, "x", "y").agg(F.min("segment_id").alias("spot"))
        .withColumn("cx", cell_index(F.col("x"), F.lit(size))).withColumn("cy", cell_index(F.col("y"), F.lit(size)))
    )
    cells = spots.groupBy(*keys, "cx", "cy").agg(F.min("spot").alias("cell"))
    same_spot = ends.join(spots, [*keys, "x", "y"]).select(
        "scope", F.col("segment_id").alias("u"), F.col("spot").alias("v"))
    same_cell = spots.join(cells, [*keys, "cx", "cy"]).select("scope", F.col("spot").alias("u"), F.col("cell").alias("v"))
    probe = _neighbour_cells(
        spots.select(*keys, "x", "y", F.col("spot").alias("u"), F.col("cx").alias("ox"), F.col("cy").alias("oy")),
        tol_m, size)
    other = spots.withColumnsRenamed({"x": "qx", "y": "qy", "spot": "v"})
    near = F.round(S.point_distance_m(F.col("x"), F.col("y"), F.col("qx"), F.col("qy")), 6) <= tol_m
    elsewhere = (F.col("cx") != F.col("ox")) | (F.col("cy") != F.col("oy"))
    across = probe.join(other, [*keys, "cx", "cy"]).filter(elsewhere & near & (F.col("u") < F.col("v"))).select("scope", "u", "v")
    return same_spot.unionByName(same_cell).unionByName(across).filter(F.col("u") != F.col("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select("scope", F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("scope", "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.filter(F.col("v") > F.col("u")).join(least, ["scope", "u"]).select(
        "scope", F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select("scope", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("scope", "u").agg(F.min("v").alias("m"))
    moved = down.join(least, ["scope", "u"]).filter(F.col("v") != F.col("m")).select(
        "scope", F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``scope, node, root`` for every node with an edge; root is the lowest node id."""
    edges = cut_lineage(edges.select("scope", "u", "v"))
    seen = None
    for _ in range(max_rounds):
        edges = cut_lineage(_small_star(_large_star(edges)))
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("scope", "u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select("scope", F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def segment_components(nodes: DataFrame, tol_m: float = V.CORRIDOR_TOLERANCE_M) -> DataFrame:
    """``scope, segment_id, root``; an isolated segment is its own component."""
    roots = connected_components(linking_edges(nodes, tol_m)).withColumnRenamed("node", "segment_id")
    return nodes.select("scope", "segment_id").join(roots, ["scope", "segment_id"], "left").withColumn(
        "root", F.coalesce("root", "segment_id"))


def group_corridors(results: DataFrame, roads: DataFrame, scope: str = "muni_id",
                    tol_m: float = V.CORRIDOR_TOLERANCE_M) -> DataFrame:
    """Add ``corridor_id`` (numbered per scope) and ``corridor_name`` to significant rows."""
    nodes = cut_lineage(corridor_nodes(results, roads, scope))
    members = cut_lineage(segment_components(nodes, tol_m))
    numbers = dense_rank(members, ["scope"], "root", "corridor_id")
    names = members.join(nodes.select("scope", "segment_id", "corridor_name"), ["scope", "segment_id"]).groupBy(
        "scope", "root").agg(F.min("corridor_name").alias("corridor_name"))
    labelled = (
        members.join(numbers, ["scope", "root"]).join(names, ["scope", "root"])
        .select(F.col("scope").alias(scope), "segment_id", F.col("corridor_id").cast("int").alias("corridor_id"), "corridor_name")
    )
    kept = results.drop("corridor_id", "corridor_name").join(labelled, [scope, "segment_id"], "left")
    return kept.withColumns({c: F.when(F.col("is_significant"), F.col(c)) for c in ("corridor_id", "corridor_name")})
