"""Geometry as Column expressions on arrays of ``struct<x,y>`` (degrees, WGS84).

Distances are metric: degree offsets are scaled with the ellipsoid's meridian and
prime-vertical radii at the middle latitude of the two points, which keeps the
error far below a millimetre at road-snapping range.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hazardgrid import fixed_values as V
from hazardgrid.functions.binding import let

# --- fixed values: WGS84 ellipsoid -------------------------------------------
SEMI_MAJOR_M = 6378137.0
FLATTENING = 1 / 298.257223563
ECC2 = FLATTENING * (2 - FLATTENING)
_RAD = math.pi / 180

POINT_TYPE = "struct<x:double,y:double>"
LINE_TYPE = f"array<{POINT_TYPE}>"
RINGS_TYPE = f"array<array<{POINT_TYPE}>>"
# A given point lies on an edge if rounding alone keeps it off; a computed one also within a tenth of a micrometre.
EXACT_DEG = 1e-16
ON_EDGE_DEG = 1e-12
# A degree of latitude is never shorter than this.
MIN_METERS_PER_DEGREE = 110_500.0


def point(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def line(*xy) -> Column:
    return F.array(*[point(x, y) for x, y in xy])


def box_rings(x0, y0, x1, y1) -> Column:
    """A box as the ring list of a polygon."""
    return F.array(line((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)))


def _w2(lat: Column) -> Column:
    s = F.sin(F.radians(lat))
    return F.lit(1.0) - ECC2 * s * s


def meters_per_degree_lat(lat: Column) -> Column:
    w2 = _w2(lat)
    return F.lit(SEMI_MAJOR_M * (1 - ECC2) * _RAD) / (w2 * F.sqrt(w2))


def meters_per_degree_lon(lat: Column) -> Column:
    return F.lit(SEMI_MAJOR_M * _RAD) * F.cos(F.radians(lat)) / F.sqrt(_w2(lat))


def local_scale(lat: Column) -> Column:
    """Metres per degree at ``lat`` and their change per degree of latitude.

    Computed once per point, so that the per-edge distance needs no trigonometry.
    """
    rad = F.radians(lat)
    m, n = meters_per_degree_lat(lat), meters_per_degree_lon(lat)
    return F.struct(
        n.alias("kx"), m.alias("ky"),
        (-m * F.sin(rad) * _RAD).alias("dkx"),
        (F.lit(3 * ECC2 * _RAD) * m * F.sin(rad) * F.cos(rad) / _w2(lat)).alias("dky"),
    )


def point_distance_m(x1, y1, x2, y2) -> Column:
    mid = (y1 + y2) / 2
    return F.hypot((x2 - x1) * meters_per_degree_lon(mid), (y2 - y1) * meters_per_degree_lat(mid))


def point_edge_distance_m(px, py, scale, ax, ay, bx, by) -> Column:
    """Metres from a point to the edge a-b; ``scale`` is :func:`local_scale` of py."""
    kx, ky = scale["kx"], scale["ky"]

    # Each step is a value of its own: copies of an expression inside a lambda are evaluated one by one.
    def along(g):
        length2 = g["ux"] * g["ux"] + g["uy"] * g["uy"]
        t = F.when(length2 > 0, F.least(F.greatest((g["wx"] * g["ux"] + g["wy"] * g["uy"]) / length2, F.lit(0.0)), F.lit(1.0)))
        return F.coalesce(t, F.lit(0.0))

    given = F.struct(((bx - ax) * kx).alias("ux"), ((by - ay) * ky).alias("uy"), ((px - ax) * kx).alias("wx"), ((py - ay) * ky).alias("wy"))
    off = let(let(given, along), lambda t: F.struct((ax + t * (bx - ax) - px).alias("dx"), (ay + t * (by - ay) - py).alias("dy")))
    return let(off, lambda o: F.hypot(o["dx"] * (kx + scale["dkx"] * o["dy"] / 2), o["dy"] * (ky + scale["dky"] * o["dy"] / 2)))


def edges(pts: Column) -> Column:
    """Consecutive vertex pairs of a path as ``struct(a, b)``; empty below two vertices."""
    pairs = F.greatest(F.size(pts) - 1, F.lit(0))
    return F.arrays_zip(F.slice(pts, 1, pairs).alias("a"), F.slice(pts, 2, pairs).alias("b"))


def point_line_distance_m(px, py, pts) -> Column:
    """Shortest distance in metres from a point to a path."""
    return let(local_scale(py), lambda scale: F.array_min(F.transform(edges(pts), lambda e: point_edge_distance_m(
        px, py, scale, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"],
    ))))


def within_distance_m(px, py, pts, meters) -> Column:
    return F.round(point_line_distance_m(px, py, pts), 6) <= meters


def line_length_m(pts) -> Column:
    return F.aggregate(
        edges(pts), F.lit(0.0),
        lambda acc, e: acc + point_distance_m(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]),
    )


def line_length_miles(pts) -> Column:
    return line_length_m(pts) / V.METERS_PER_MILE


def start_point(pts) -> Column:
    return F.try_element_at(pts, F.lit(1))


def end_point(pts) -> Column:
    return F.try_element_at(pts, F.lit(-1))


def ring_edges(rings) -> Column:
    return F.flatten(F.transform(rings, edges))


def on_edge(px, py, edge_list, within: float = EXACT_DEG) -> Column:
    """Whether the point lies on one of the edges, ``within`` degrees whatever their length and direction."""
    def touches(e):
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        cross = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
        return (
            (F.abs(cross) <= within * F.hypot(bx - ax, by - ay))
            & px.between(F.least(ax, bx) - within, F.greatest(ax, bx) + within)
            & py.between(F.least(ay, by) - within, F.greatest(ay, by) + within)
        )
    return F.exists(edge_list, touches)


def odd_crossings(px, py, edge_list) -> Column:
    """Even-odd rule: a ray to the east crosses the edges an odd number of times."""
    def crosses(e):
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        return ((ay > py) != (by > py)) & (px < ax + (py - ay) * F.try_divide(bx - ax, by - ay))
    return F.size(F.filter(edge_list, crosses)) % 2 == 1


def covered_by(px, py, edge_list, within: float = EXACT_DEG) -> Column:
    """Point in polygon where the boundary counts as inside; holes are honoured."""
    return on_edge(px, py, edge_list, within) | odd_crossings(px, py, edge_list)


def inside_of(px, py, edge_list) -> Column:
    """Point strictly inside."""
    return ~on_edge(px, py, edge_list) & odd_crossings(px, py, edge_list)


def segments_meet(ax, ay, bx, by, e) -> Column:
    """Whether the edge a-b and the edge ``e`` share a point."""
    cx, cy, dx, dy = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]

    def side(px, py, qx, qy, rx, ry):
        return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))

    boxes = (
        (F.greatest(ax, bx) >= F.least(cx, dx)) & (F.greatest(cx, dx) >= F.least(ax, bx))
        & (F.greatest(ay, by) >= F.least(cy, dy)) & (F.greatest(cy, dy) >= F.least(ay, by))
    )
    return (
        boxes
        & (side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) <= 0)
        & (side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) <= 0)
    )


def segments_cross(ax, ay, bx, by, e) -> Column:
    """Whether the edge a-b and the edge ``e`` cross in a point inside both."""
    cx, cy, dx, dy = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]

    def side(px, py, qx, qy, rx, ry):
        return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))

    return ((side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) < 0)
            & (side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) < 0))


def ring_extent(rings) -> Column:
    """``struct(x0, y0, x1, y1)`` of all ring vertices."""
    pts = F.flatten(rings)
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"),
        F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"),
    )


def locate_on_edge(m, a, b) -> Column:
    """Point on a measured edge (x, y, m) at measure ``m``; the first vertex when flat."""
    t = F.coalesce(F.try_divide(m - a["m"], b["m"] - a["m"]), F.lit(0.0))
    return point(a["x"] + t * (b["x"] - a["x"]), a["y"] + t * (b["y"] - a["y"]))


def locate_along_measure(pts, m) -> Column:
    """Points of a measured path at measure ``m``, one per distinct location."""
    hits = F.filter(edges(pts), lambda e: m.between(
        F.least(e["a"]["m"], e["b"]["m"]), F.greatest(e["a"]["m"], e["b"]["m"])))
    return F.array_distinct(F.transform(hits, lambda e: locate_on_edge(m, e["a"], e["b"])))


# --- output formats -----------------------------------------------------------

def point_geojson(x, y) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")))


def line_geojson(pts) -> Column:
    return F.to_json(F.struct(
        F.lit("LineString").alias("type"),
        F.transform(pts, lambda p: F.array(p["x"], p["y"])).alias("coordinates"),
    ))


def ring_problem(ring) -> Column:
    """Reason a ring cannot be a polygon ring, NULL when it can."""
    return (
        F.when(ring.isNull() | (F.size(ring) < 4), "too_few_positions")
        .when(start_point(ring) != end_point(ring), "not_closed")
    )


def to_multipolygon_wkt(polygons) -> Column:
    """WKT of ``array<polygon<ring<point>>>``; NULL when a ring is open or too short."""
    def ring_text(ring):
        return F.concat(F.lit("("), F.array_join(F.transform(
            ring, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))

    def polygon_text(rings):
        return F.concat(F.lit("("), F.array_join(F.transform(rings, ring_text), ", "), F.lit(")"))

    bad = F.exists(F.flatten(polygons), lambda r: ring_problem(r).isNotNull())
    body = F.array_join(F.transform(polygons, polygon_text), ", ")
    return F.when(~bad & (F.size(polygons) > 0), F.concat(F.lit("MULTIPOLYGON ("), body, F.lit(")")))


def rings_from_coordinates(coordinates) -> Column:
    """GeoJSON MultiPolygon coordinates (nested number arrays) to a flat ring list."""
    return F.transform(F.flatten(coordinates), lambda ring: F.transform(
        ring, lambda p: point(F.try_element_at(p, F.lit(1)), F.try_element_at(p, F.lit(2)))))


def repair_rings(rings) -> Column:
    """Close rings, drop repeated vertices and rings whose vertices are all on one line."""
    def tidy(ring):
        kept = F.filter(
            F.transform(ring, lambda p, i: F.struct(
                p.alias("p"),
                (F.coalesce(p != F.try_element_at(ring, F.greatest(i, F.lit(1))), F.lit(True)) | (i == 0)).alias("keep"))),
            lambda s: s["keep"])
        pts = F.transform(kept, lambda s: s["p"])
        return F.when(start_point(pts) == end_point(pts), pts).otherwise(
            F.concat(pts, F.array(start_point(pts))))
    return F.filter(F.transform(rings, tidy), lambda r: (F.size(r) >= 4) & ~_on_one_line(r))


def _on_one_line(ring) -> Column:
    """Whether no vertex is beside the line through the first two; crossing outlines whose areas cancel are not on one line."""
    a, b = F.get(ring, F.lit(0)), F.get(ring, F.lit(1))
    return ~F.exists(ring, lambda p: (b["x"] - a["x"]) * (p["y"] - a["y"]) != (b["y"] - a["y"]) * (p["x"] - a["x"]))


# --- metric projection --------------------------------------------------------

# UTM zone 18N on GRS80, and the series of Krueger in the third flattening, to its fifth power.
_UTM_LON, _UTM_SCALE, _UTM_EAST = -75.0, 0.9996, 500000.0
_GRS_F = 1 / 298.257222101
_N = _GRS_F / (2 - _GRS_F)
_ECC = math.sqrt(_GRS_F * (2 - _GRS_F))
_RECTIFYING = _UTM_SCALE * SEMI_MAJOR_M / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_TO_PLANE = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180 - 127 * _N**5 / 288,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440 + 281 * _N**5 / 630,
    61 * _N**3 / 240 - 103 * _N**4 / 140 + 15061 * _N**5 / 26880,
    49561 * _N**4 / 161280 - 179 * _N**5 / 168, 34729 * _N**5 / 80640,
)
_FROM_PLANE = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360 - 81 * _N**5 / 512,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440 + 46 * _N**5 / 105,
    17 * _N**3 / 480 - 37 * _N**4 / 840 - 209 * _N**5 / 4480,
    4397 * _N**4 / 161280 - 11 * _N**5 / 504, 4583 * _N**5 / 161280,
)
_FROM_CONFORMAL = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45 + 26 * _N**5 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45 + 2704 * _N**5 / 315,
    56 * _N**3 / 15 - 136 * _N**4 / 35 - 1262 * _N**5 / 105, 4279 * _N**4 / 630 - 332 * _N**5 / 35, 4174 * _N**5 / 315,
)


def _sphere_of_degrees(g):
    return {"s": F.sin(F.radians(g["lat"])), "dl": F.radians(g["lon"] - _UTM_LON)}


def _tangent(g):
    return {"t": F.sinh(F.atanh(g["s"]) - F.lit(_ECC) * F.atanh(F.lit(_ECC) * g["s"])), "dl": g["dl"]}


def _plane_angles(g):
    return {"xi": F.atan2(g["t"], F.cos(g["dl"])), "eta": F.asinh(F.sin(g["dl"]) / F.hypot(g["t"], F.cos(g["dl"])))}


def _plane(z):
    xi, eta = z["xi"], z["eta"]
    north = xi + sum((F.lit(a) * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, a in enumerate(_TO_PLANE, 1)), F.lit(0.0))
    east = eta + sum((F.lit(a) * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, a in enumerate(_TO_PLANE, 1)), F.lit(0.0))
    return {"x": _UTM_EAST + _RECTIFYING * east, "y": _RECTIFYING * north}


def _angles_of_plane(g):
    return {"xi": g["y"] / _RECTIFYING, "eta": (g["x"] - _UTM_EAST) / _RECTIFYING}


def _sphere_angles(w):
    xi, eta = w["xi"], w["eta"]
    return {"xi": xi - sum((F.lit(b) * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, b in enumerate(_FROM_PLANE, 1)), F.lit(0.0)),
            "eta": eta - sum((F.lit(b) * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, b in enumerate(_FROM_PLANE, 1)), F.lit(0.0))}


def _conformal(z):
    return {"c": F.asin(F.sin(z["xi"]) / F.cosh(z["eta"])), "lon": F.atan2(F.sinh(z["eta"]), F.cos(z["xi"]))}


def _degrees(z):
    lat = z["c"] + sum((F.lit(d) * F.sin(2 * k * z["c"]) for k, d in enumerate(_FROM_CONFORMAL, 1)), F.lit(0.0))
    return {"x": _UTM_LON + F.degrees(z["lon"]), "y": F.degrees(lat)}


#: The projection and its inverse as steps; each takes named values and gives the next ones.
TO_METRIC = (_sphere_of_degrees, _tangent, _plane_angles, _plane)
TO_LONLAT = (_angles_of_plane, _sphere_angles, _conformal, _degrees)


def _named(values: dict) -> Column:
    return F.struct(*[c.cast("double").alias(n) for n, c in values.items()])


def _through(steps, values: dict) -> Column:
    def then(made, step):
        return let(made, lambda z: _named(step(z)))

    return reduce(then, steps[1:], _named(steps[0](values)))


def to_metric(lon, lat) -> Column:
    """``struct(x, y)`` of a point in metres: transverse Mercator, zone 18 north."""
    return _through(TO_METRIC, {"lon": lon, "lat": lat})


def to_lonlat(x, y) -> Column:
    """``struct(x, y)`` in degrees of a point of :func:`to_metric`."""
    return _through(TO_LONLAT, {"x": x, "y": y})


def with_steps(df: DataFrame, out: str, steps, values: dict) -> DataFrame:
    """``df`` with ``out``, what :func:`to_metric` or :func:`to_lonlat` give, through a column for each step: compiled, unlike a lambda."""
    made = []
    for i, step in enumerate(steps):
        columns = {f"_{out}{i}_{n}": c for n, c in step(values).items()}
        df = df.withColumns(columns)
        values = {n: F.col(f"_{out}{i}_{n}") for n in step(values)}
        made += columns
    return df.withColumn(out, point(values["x"], values["y"])).drop(*made)


def metric_length(pts) -> Column:
    """Length in metres of a path's straight edges in the projection."""
    return let(F.transform(pts, lambda p: to_metric(p["x"], p["y"])), lambda m: F.aggregate(edges(m), F.lit(0.0), lambda acc, e: acc + F.hypot(
        e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])))
