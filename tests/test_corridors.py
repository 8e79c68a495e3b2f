import random

from conftest import rows
from pyspark.sql import functions as F

from hazardgrid.operators import corridors as C
from hazardgrid.operators.ranking import average_rank_pct, dense_rank, running_total

ROADS = "segment_id long, muni_id int, sri string, road_name string, pts array<struct<x:double,y:double>>"
SIX = [
    (-96411, "A", "Route A", [(-74.5, 40.0), (-74.499, 40.0)]),
    (-96412, "A", "Route A", [(-74.498994, 40.0), (-74.498, 40.0)]),
    (-96413, "A", "Route A", [(-74.4, 40.0), (-74.399, 40.0)]),
    (-96414, "B", "Route B", [(-74.498, 40.0), (-74.497, 40.0)]),
    (-96415, None, " local ROAD ", [(-74.3, 40.0), (-74.299, 40.0)]),
    (-96416, None, "LOCAL road", [(-74.299, 40.0), (-74.298, 40.0)]),
]


def frames(spark, items):
    r = spark.createDataFrame([(i, 1, s, n, [{"x": x, "y": y} for x, y in p]) for i, s, n, p in items], ROADS)
    return r.select("muni_id", "segment_id").withColumn("is_significant", F.lit(True)), r


def test_six_roads_give_four_stable_corridors(spark):
    results, roads = frames(spark, SIX)
    first = rows(C.group_corridors(results, roads), "segment_id", "corridor_id", "corridor_name")
    groups = {}
    for seg, cid, name in first:
        groups.setdefault(cid, []).append((seg, name))
    assert sorted(sorted(s for s, _ in g) for g in groups.values()) == [
        [-96416, -96415], [-96414], [-96413], [-96412, -96411]]
    assert dict((s, n) for s, _, n in first)[-96415] == "Local Road"
    assert {cid for _, cid, _ in first} == {1, 2, 3, 4}
    assert rows(C.group_corridors(results, roads), "segment_id", "corridor_id", "corridor_name") == first


def test_insignificant_rows_get_no_corridor(spark):
    results, roads = frames(spark, SIX)
    results = results.withColumn("is_significant", F.col("segment_id") != -96413)
    out = dict((r["segment_id"], r["corridor_id"]) for r in C.group_corridors(results, roads).collect())
    assert out[-96413] is None and sum(v is not None for v in out.values()) == 5


def test_long_chain_settles(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    results, roads = frames(spark, [(order[i], "A", "A", [(-74.5 + i * .001, 40.0), (-74.5 + (i + 1) * .001, 40.0)]) for i in range(n)])
    assert C.group_corridors(results, roads).select("corridor_id").distinct().count() == 1


def test_star_needs_linear_edges_and_matches_all_pairs(spark):
    hub = [(i, "A", "A", [(-74.5, 40.0), (-74.5 + .001 * (i % 7 + 1), 40.0 + .001 * i)]) for i in range(200)]
    nodes = C.corridor_nodes(*frames(spark, hub))
    assert C.linking_edges(nodes).count() < 3 * 200
    assert C.endpoint_adjacency(nodes).count() >= 200 * 199 / 2
    assert C.segment_components(nodes).select("root").distinct().collect()[0][0] == 0


def test_linking_edges_have_the_components_of_all_pairs(spark):
    rnd = random.Random(3)
    tiny = 1e-5 / 1.11          # about a metre
    spot = lambda: (-74.5 + rnd.randrange(30) * tiny * .6, 40 + rnd.randrange(3) * tiny * .6)
    results, roads = frames(spark, [(i, rnd.choice("AB"), "x", [spot(), (rnd.random() * 10, rnd.random() * 10)]) for i in range(60)])
    nodes = C.corridor_nodes(results, roads).cache()
    pairs = C.endpoint_adjacency(nodes).collect()
    root = {r["segment_id"]: r["segment_id"] for r in nodes.collect()}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for p in pairs:
        a, b = find(p["source"]), find(p["target"])
        root[max(a, b)] = min(a, b)
    want = sorted((i, find(i)) for i in root)
    assert sorted((r["segment_id"], r["root"]) for r in C.segment_components(nodes).collect()) == want


def test_ranks_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") % 77).alias("v"))
    got = {(r["g"], r["v"]): r["k"] for r in dense_rank(df, ["g"], "v", "k").collect()}
    assert got[(0, 0)] == 1 and got[(2, 76)] == 77 and len(got) == 231
    total = running_total(spark.range(100).withColumn("one", F.lit(1)), [], ["id"], "one", "n")
    assert rows(total.filter("id IN (0, 50, 99)"), "id", "n") == [(0, 1), (50, 51), (99, 100)]
    pct = average_rank_pct(spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,)], "x double"), "x", "p")
    assert [(a, None if b is None else round(b, 3)) for a, b in rows(pct)] == [(None, None), (1.0, 33.333), (2.0, 83.333), (2.0, 83.333)]
