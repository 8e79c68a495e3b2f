"""Paths cut by polygons and into equal pieces, as joins, windows and column expressions.

An edge of a path meets the sides of a polygon in grid cells; where they cross, the edge is cut at fractions of its length.  Every stretch between two
cuts is wholly inside or outside, so its middle decides, and stretches that follow each other make a part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hazardgrid import fixed_values as V
from hazardgrid.functions import spatial as S
from hazardgrid.operators.boundaries import point_covered
from hazardgrid.operators.grid import explode_edge_cells, level_size, levels_in_use, polygon_cells
from hazardgrid.session import spread_rows

_CELL = ["level", "cx", "cy"]
#: Fractions of an edge are compared to so many digits: a cut found from two sides counts once.
_DIGITS = 12
#: Paths that one task lists in cells.
PATHS_PER_TASK = 20_000


def _proper_edges(pts):
    """The edges of a path that have a length."""
    return F.filter(S.edges(pts), lambda e: e["a"] != e["b"])


def _path_edges(paths: DataFrame) -> DataFrame:
    """``source_id, i, ax, ay, bx, by``."""
    return paths.select("source_id", F.posexplode(_proper_edges(F.col("pts"))).alias("i", "e")).select(
        "source_id", "i", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def _in_cells(edges: DataFrame, levels: list[int]) -> DataFrame:
    """Edges listed under their cells at every level in use."""
    tagged = edges.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels or [0]])))
    return explode_edge_cells(tagged, level_size(F.col("level")), F.lit(1e-9), F.lit(1e-9))


def _sides(munis: DataFrame) -> DataFrame:
    """``muni_id, level, ax, ay, bx, by`` of every polygon side; the more sides, the smaller the cells."""
    box, sides = S.ring_extent(F.col("rings")), S.ring_edges(F.col("rings"))
    extent = F.greatest(F.col("_box.x1") - F.col("_box.x0"), F.col("_box.y1") - F.col("_box.y0"))
    # About as long as a side, if the outline were a square.
    wanted = 4 * extent / F.greatest(F.size("_sides"), F.lit(1))
    level = F.greatest(F.lit(0), F.least(F.lit(20), F.ceil(F.log2(F.greatest(wanted, F.lit(1e-9)) / level_size(F.lit(0)))))).cast("int")
    return munis.select("muni_id", box.alias("_box"), sides.alias("_sides")).select("muni_id", level.alias("level"), F.explode("_sides").alias("e")).select(
        "muni_id", "level", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def _cut_fractions(c: dict):
    """Fractions of the edge a-b, strictly between its ends, where it meets the side c-d: a crossing, or a corner that lies on the edge."""
    ax, ay, bx, by, cx, cy, dx, dy = (c[k] for k in ("ax", "ay", "bx", "by", "sx", "sy", "tx", "ty"))
    ux, uy, vx, vy = bx - ax, by - ay, dx - cx, dy - cy
    turn = ux * vy - uy * vx
    t = F.try_divide((cx - ax) * vy - (cy - ay) * vx, turn)
    u = F.try_divide((cx - ax) * uy - (cy - ay) * ux, turn)
    length = F.hypot(ux, uy)

    def corner(x, y):
        off = F.abs(ux * (y - ay) - uy * (x - ax)) <= S.ON_EDGE_DEG * length
        return F.when(off, ((x - ax) * ux + (y - ay) * uy) / (length * length))

    found = F.array(F.when(u.between(0.0, 1.0), t), corner(cx, cy), corner(dx, dy))
    return F.filter(F.transform(found, lambda v: F.round(v, _DIGITS)), lambda v: v.isNotNull() & (v > 0) & (v < 1))


def stretches_inside(paths: DataFrame, munis: DataFrame) -> DataFrame:
    """``source_id, muni_id, i, t0, t1, p0, p1``: stretches of edge ``i`` that lie in a municipality, boundary included.

    No polygon travels: a path edge joins the sides in its cells, and the middle of a stretch joins the latitude row of its municipality.
    """
    munis = munis.select("muni_id", "rings")
    # A path is listed in many cells, so a task takes a bounded number of paths, however few files they come from.
    edges = _path_edges(spread_rows(paths.select("source_id", "pts"), PATHS_PER_TASK))
    home = polygon_cells(munis).select("muni_id", *_CELL)
    near = _in_cells(edges, levels_in_use(home)).join(home, _CELL).drop(*_CELL).withColumn("cut", F.lit(None).cast("double"))
    sides = _sides(munis)
    listed = explode_edge_cells(sides, level_size(F.col("level")), F.lit(1e-9), F.lit(1e-9)).withColumnsRenamed(
        {"ax": "sx", "ay": "sy", "bx": "tx", "by": "ty"})
    pairs = _in_cells(edges, levels_in_use(sides)).join(listed, _CELL)
    cut = pairs.withColumn("cut", F.explode(_cut_fractions({k: F.col(k) for k in ("ax", "ay", "bx", "by", "sx", "sy", "tx", "ty")})))
    ends = ("ax", "ay", "bx", "by")
    met = near.unionByName(cut.select(near.columns)).groupBy("source_id", "muni_id", "i").agg(
        *[F.first(c).alias(c) for c in ends], F.collect_set("cut").alias("cuts"))
    marks = F.array_sort(F.array_union(F.array(F.lit(0.0), F.lit(1.0)), F.col("cuts")))
    spans = met.withColumn("_marks", marks).withColumn("_span", F.explode(F.arrays_zip(
        F.slice("_marks", F.lit(1), F.size("_marks") - 1).alias("t0"), F.slice("_marks", F.lit(2), F.size("_marks") - 1).alias("t1"))))
    t0, t1 = F.col("_span.t0"), F.col("_span.t1")

    def along(t):
        at = S.point(F.col("ax") + t * (F.col("bx") - F.col("ax")), F.col("ay") + t * (F.col("by") - F.col("ay")))
        return F.when(t <= 0, S.point(F.col("ax"), F.col("ay"))).when(t >= 1, S.point(F.col("bx"), F.col("by"))).otherwise(at)

    middle = along((t0 + t1) / 2)
    spans = spans.select("source_id", "muni_id", "i", t0.alias("t0"), t1.alias("t1"), along(t0).alias("p0"), along(t1).alias("p1"),
                         middle["x"].alias("lon"), middle["y"].alias("lat"))
    return point_covered(spans, munis, within=S.ON_EDGE_DEG).filter("covered").drop("covered", "lon", "lat")


def clip_paths(paths: DataFrame, munis: DataFrame) -> DataFrame:
    """Parts of each path inside each municipality it meets.

    ``paths`` needs a unique ``source_id`` and ``pts``; ``munis`` needs ``muni_id, muni_code, rings``.  ``part`` is ``0`` for a single part and counts
    from 1 otherwise, in path order.  A path wholly inside stays as it is; a path that only touches a boundary at points has no part there.
    """
    pair = ["source_id", "muni_id"]
    ordered = Window.partitionBy(*pair).orderBy("begin")
    inside = stretches_inside(paths, munis).withColumns({"begin": F.col("i") + F.col("t0"), "end": F.col("i") + F.col("t1")})
    first = F.coalesce(F.lag("end").over(ordered) != F.col("begin"), F.lit(True))
    numbered = inside.withColumn("_first", first.cast("int")).withColumn("_no", F.sum("_first").over(ordered))
    parts = numbered.groupBy(*pair, "_no").agg(
        F.array_sort(F.collect_list(F.struct("begin", "p0", "p1"))).alias("_s"), F.min("begin").alias("_begin"), F.max("end").alias("_end"))
    total = F.count(F.lit(1)).over(Window.partitionBy(*pair))
    parts = parts.withColumn("_n", total)
    whole = (F.col("_begin") == 0) & (F.col("_end") == F.size(_proper_edges(F.col("pts"))))
    joined = F.concat(F.array(F.get("_s", F.lit(0))["p0"]), F.transform("_s", lambda s: s["p1"]))
    return (
        parts.join(paths, "source_id").join(munis.select("muni_id", "muni_code"), "muni_id")
        .withColumn("pts", F.when(whole, F.col("pts")).otherwise(joined))
        .withColumn("part", F.when(F.col("_n") == 1, F.lit(0)).otherwise(F.col("_no")).cast("int")).drop("_no", "_s", "_begin", "_end", "_n"))


def paths_without_boundary(paths: DataFrame, munis: DataFrame) -> DataFrame:
    """Paths of which no stretch lies in any municipality (a touch is not enough)."""
    return paths.join(stretches_inside(paths, munis).select("source_id").distinct(), "source_id", "left_anti")


def split_line_equal(parts: DataFrame, piece_miles: float = V.PIECE_MILES) -> DataFrame:
    """Cut every part into equal pieces no longer than the target; adds ids and lengths.

    ``parts`` as from :func:`clip_paths`.  Lengths run along the vertices in the metric projection; each edge belongs to the pieces whose stretch of the
    running length it overlaps, and is cut at the marks between them.
    """
    if not piece_miles > 0:
        raise ValueError("piece length must be positive")
    target = piece_miles * V.METERS_PER_MILE
    key = ["source_id", "muni_code", "part"]
    ordered, whole = Window.partitionBy(*key).orderBy("k"), Window.partitionBy(*key)
    vertices = S.with_steps(parts.select(*key, F.posexplode("pts").alias("k", "p")), "m", S.TO_METRIC, {"lon": F.col("p.x"), "lat": F.col("p.y")})
    vertices = vertices.withColumns({"p0": F.lag("p").over(ordered), "m0": F.lag("m").over(ordered)}).filter("p0 IS NOT NULL")
    vertices = vertices.withColumn("step", F.hypot(F.col("m.x") - F.col("m0.x"), F.col("m.y") - F.col("m0.y"))).filter("step > 0")
    run = vertices.withColumns({"run": F.sum("step").over(ordered), "total": F.sum("step").over(whole)})
    run = run.withColumn("count", F.greatest(F.lit(1), F.ceil(F.col("total") / target)).cast("int"))
    size = F.col("total") / F.col("count")
    begin, last = F.col("run") - F.col("step"), F.col("count") - 1
    low = F.least(F.floor(begin / size).cast("int"), last)
    high = F.greatest(low, F.least((F.ceil(F.col("run") / size) - 1).cast("int"), last))
    cut = run.withColumns({"low": low, "high": high}).withColumn("piece", F.explode(F.sequence("low", "high")))

    def mark(df, out, piece):
        t = (piece * size - begin) / F.col("step")
        return S.with_steps(df, out, S.TO_LONLAT, {
            "x": F.col("m0.x") + t * (F.col("m.x") - F.col("m0.x")), "y": F.col("m0.y") + t * (F.col("m.y") - F.col("m0.y"))})

    piece = F.col("piece")
    ends = mark(mark(cut, "from", piece), "to", piece + 1).select(
        *key, "piece", "k", F.when(piece == F.col("low"), F.col("p0")).otherwise(F.col("from")).alias("s"),
        F.when(piece == F.col("high"), F.col("p")).otherwise(F.col("to")).alias("e"))
    ends = ends.withColumn("meters", S.point_distance_m(F.col("s.x"), F.col("s.y"), F.col("e.x"), F.col("e.y")))
    # The edges' lengths are added in path order, as line_length_miles would.
    pieces = ends.groupBy(*key, "piece").agg(F.array_sort(F.collect_list(F.struct("k", "s", "e", "meters"))).alias("_s")).withColumns({
        "pts": F.concat(F.array(F.get("_s", F.lit(0))["s"]), F.transform("_s", lambda s: s["e"])),
        "length_miles": F.aggregate("_s", F.lit(0.0), lambda acc, s: acc + s["meters"]) / V.METERS_PER_MILE}).drop("_s")
    return (
        pieces.join(parts.drop("pts"), key)
        .filter(F.col("length_miles") > 0)
        .withColumn("path_id", F.col("source_id"))
        .withColumn("source_id", F.concat(
            F.col("path_id"), F.lit(":M"), F.col("muni_code"), F.lit(":P"), F.col("part").cast("string"),
            F.lit(":S"), F.col("piece").cast("string")))
    )
