from pyspark.sql import functions as F

from checks import published as P
from hazardgrid.functions import spatial as S


def test_pages_grow_in_number_not_in_length(spark, monkeypatch):
    monkeypatch.setattr(P, "PAGE_FEATURES", 10)
    rows = P.feature_pages(spark.range(300), "id", F.struct("id")).select(F.size(F.from_json("value", "features array<struct<id:long>>")["features"]).alias("n")).collect()
    assert len(rows) == 30 and {r["n"] for r in rows} == {10}


def test_distance_evaluates_the_radii_once_a_point(spark):
    pts = S.line((F.lit(-74.0), F.col("y")), (F.lit(-73.9), F.col("y") + 0.1), (F.lit(-73.8), F.col("y")))
    df = spark.range(3).select((F.col("id") / 10 + 40).alias("y")).select(S.point_line_distance_m(F.lit(-73.95), F.col("y"), pts).alias("m"), S.point_line_distance_m(F.lit(-74.0), F.col("y"), pts).alias("zero"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().count("SIN(") < 40
    got = df.collect()
    assert all(abs(r["zero"]) < 1e-9 and 3000 < r["m"] < 4500 for r in got)
