"""Where a crash happened: its reported point, or its route and milepost.

Routes are cut into measured edges keyed by route id, level and measure bucket, so a
milepost needs one equi join; a heavily used route is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hazardgrid import fixed_values as V
from hazardgrid.functions import spatial as S
from hazardgrid.operators.boundaries import point_covered
from hazardgrid.operators.validation import first_reason
from hazardgrid.session import stage

#: Width of the smallest measure bucket in miles; each level doubles it.
MEASURE_BUCKET = 0.1
_LEVELS = 64


def _bucket(measure, level):
    return F.floor(measure / (MEASURE_BUCKET * F.pow(F.lit(2.0), level))).cast("long")


def measure_edges(routes: DataFrame) -> DataFrame:
    """``source_id, sri, a, b, mp_start, mp_end, level, bucket`` of every measured edge.

    The level's buckets are at least as wide as the edge, so an edge of any length is in one or two of them.
    """
    edges = routes.select("source_id", "sri", "mp_start", "mp_end", F.explode(S.edges(F.col("pts"))).alias("e")).select(
        "source_id", "sri", "mp_start", "mp_end", "e.a", "e.b").filter("a.m IS NOT NULL AND b.m IS NOT NULL")
    low, high = F.least("a.m", "b.m"), F.greatest("a.m", "b.m")
    level = F.ceil(F.log2(F.greatest((high - low) / MEASURE_BUCKET, F.lit(1.0))))
    placed = edges.withColumn("level", F.least(level, F.lit(_LEVELS)).cast("int"))
    ends = F.array_distinct(F.array(_bucket(low, F.col("level")), _bucket(high, F.col("level"))))
    return placed.withColumn("bucket", F.explode(ends))


def locate_route_milepost(df: DataFrame, routes: DataFrame, munis: DataFrame, key: list[str]) -> DataFrame:
    """Candidate points ``key, source_id, lon, lat`` on the row's route at its milepost.

    The measure must lie in the route's own range and the point in the row's
    municipality.  A vertex shared by two edges gives one point.  A row looks up one bucket at each level in use.
    """
    edges = measure_edges(routes)
    # At most _LEVELS small numbers, whatever the data size.
    levels = sorted(r["level"] for r in edges.select("level").distinct().collect()) or [0]
    wanted = df.filter(F.col("sri").isNotNull() & F.col("milepost").isNotNull()).select(
        *key, "muni_id", "sri", "milepost", F.explode(F.array(*[F.lit(v) for v in levels])).alias("level"))
    wanted = wanted.withColumn("bucket", _bucket(F.col("milepost"), F.col("level")))
    m = F.col("milepost")
    hits = wanted.join(edges, ["sri", "level", "bucket"]).filter(
        m.between(F.least("a.m", "b.m"), F.greatest("a.m", "b.m"))
        & m.between(F.least("mp_start", "mp_end"), F.greatest("mp_start", "mp_end")))
    points = hits.select(*key, "muni_id", "source_id", S.locate_on_edge(m, F.col("a"), F.col("b")).alias("p")).select(
        *key, "muni_id", "source_id", F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))
    return point_covered(points, munis).filter("covered").select(*key, "source_id", "lon", "lat")


def collapse_route_points(points: DataFrame, key: list[str]) -> DataFrame:
    """One location per row: the first point when all agree, else ``route_ambiguous``.

    A second cluster exists exactly when some point is outside the tolerance of
    the first, so comparing with the first is enough.
    """
    point = F.struct("lon", "lat")
    first = points.groupBy(*key).agg(
        F.min_by(point, F.struct("source_id", "lon", "lat")).alias("first"),
        F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    spread = F.greatest(
        F.col("first.lon") - F.col("x0"), F.col("x1") - F.col("first.lon"),
        F.col("first.lat") - F.col("y0"), F.col("y1") - F.col("first.lat"))
    agree = spread <= V.ROUTE_POINT_TOLERANCE_DEG
    return first.select(
        *key, F.when(agree, F.col("first.lon")).alias("route_lon"), F.when(agree, F.col("first.lat")).alias("route_lat"),
        F.when(~agree, F.lit("route_ambiguous")).alias("route_reason"))


def resolve_location(df: DataFrame, routes: DataFrame, munis: DataFrame, key: list[str]) -> DataFrame:
    """Add ``lon, lat, geocode_quality, location_reason, coordinate_issue``.

    Reported point inside its municipality first, then the route location.
    ``df`` needs ``reported`` (lon, lat, issue), ``muni_id``, ``sri``, ``milepost``.  It is evaluated once; the route search reads narrow columns.
    """
    flagged = stage(point_covered(
        df.withColumns({"_lon": F.col("reported.lon"), "_lat": F.col("reported.lat")}), munis, "_valid", "_lon", "_lat"), "located-flagged")
    located = collapse_route_points(
        locate_route_milepost(flagged.filter(~F.col("_valid")), routes, munis, key), key)
    joined = flagged.join(located, key, "left")
    found = F.col("route_lon").isNotNull()
    reason = F.when(~F.col("_valid"), first_reason(
        (F.col("route_reason").isNotNull(), F.col("route_reason")),
        (~found & (F.col("sri").isNull() | F.col("milepost").isNull()), "route_reference_missing"),
        (~found, "route_measure_unresolved")))
    return joined.withColumns({
        "lon": F.when(F.col("_valid"), F.col("_lon")).otherwise(F.col("route_lon")),
        "lat": F.when(F.col("_valid"), F.col("_lat")).otherwise(F.col("route_lat")),
        "geocode_quality": F.when(F.col("_valid"), "reported").when(found, "route_milepost"),
        "location_reason": reason,
        "coordinate_issue": F.coalesce(F.col("reported.issue"), F.when(~F.col("_valid"), F.lit("reported_outside_municipality"))),
    }).drop("_lon", "_lat", "_valid", "route_lon", "route_lat", "route_reason")
