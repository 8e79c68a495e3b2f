import pytest
from conftest import rows
from pyspark.sql import functions as F

from hazardgrid.operators import sketches, snapshots, upserts

SCHEMA = "external_id string, crash_date date, severity string, dashboard_id string, ped_involved boolean, bike_involved boolean, total_killed int, total_injured int, pedestrians_killed int, pedestrians_injured int"


def crashes(spark, ids, severity="minor", year=2020):
    df = spark.createDataFrame([(i,) for i in ids], "external_id string")
    n = F.coalesce(F.regexp_extract("external_id", r"(\d+)$", 1).try_cast("int"), F.lit(0))
    return df.select("external_id", F.make_date(F.lit(year) + n % 3, F.lit(5), F.lit(1)).alias("crash_date"), F.lit(severity).alias("severity"),
                     *[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in SCHEMA.split(", ")[3:]])


def folder_bytes(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_only_touched_years_are_written_and_old_versions_stay(spark, tmp_path):
    root = str(tmp_path / "table")
    assert snapshots.current(spark, root) is None
    snapshots.create(crashes(spark, [f"e{i}" for i in range(3000)]), root, "crash_date")
    incoming = crashes(spark, ["e3", "e9003"], "fatal")        # both of the first year
    years = upserts.touched_years(snapshots.read(spark, root), incoming)
    assert rows(years, "year") == [(2020,)]
    first = next((tmp_path / "table" / "data").iterdir())
    assert snapshots.apply_changes(spark, root, "crash_date", lambda old: upserts.upsert_crashes(old, incoming), years, expected={"inserted": 1, "updated": 1}) == 2
    second = next(p for p in (tmp_path / "table" / "data").iterdir() if p != first)
    assert folder_bytes(second) < folder_bytes(first) / 2
    now, before = snapshots.read(spark, root), snapshots.read(spark, root, 1)
    assert now.count() == 3001 and before.count() == 3000
    assert rows(now.filter("severity = 'fatal'"), "external_id") == [("e3",), ("e9003",)] and before.filter("severity = 'fatal'").isEmpty()
    assert rows(snapshots.read(spark, root, years=[2021]).select(F.year("crash_date").alias("y")).distinct(), "y") == [(2021,)]


def test_wrong_counts_publish_nothing(spark, tmp_path):
    root = str(tmp_path / "table")
    snapshots.create(crashes(spark, ["e0", "e1"]), root, "crash_date")
    incoming, years = crashes(spark, ["e3"], "fatal"), spark.createDataFrame([(2020,)], "year int")
    change = lambda old: upserts.upsert_crashes(old, incoming)
    for bad in ({"expected": {"inserted": 2}}, {"scope": (2021, 2025)}):
        with pytest.raises(snapshots.CountMismatch):
            snapshots.apply_changes(spark, root, "crash_date", change, years, **bad)
    with pytest.raises(snapshots.CountMismatch):          # a row is lost
        snapshots.apply_changes(spark, root, "crash_date", lambda old: change(old).filter("external_id <> 'e0'"), years)
    with pytest.raises(snapshots.CountMismatch):          # a row leaves the touched years
        snapshots.apply_changes(spark, root, "crash_date", lambda old: change(old).withColumn("crash_date", F.lit("2022-01-01").cast("date")), years)
    assert snapshots.current(spark, root) == 1 and snapshots.read(spark, root).count() == 2


def test_empty_tables_and_undated_rows(spark, tmp_path):
    root = str(tmp_path / "table")
    snapshots.create(crashes(spark, []), root, "crash_date")
    assert snapshots.read(spark, root).count() == 0
    undated = crashes(spark, ["e1", None]).withColumn("crash_date", F.lit(None).cast("date"))
    years = upserts.touched_years(snapshots.read(spark, root), undated)
    snapshots.apply_changes(spark, root, "crash_date", lambda old: upserts.upsert_crashes(old, undated), years, expected={"inserted": 2})
    assert rows(snapshots.read(spark, root), "external_id", "crash_date") == [(None, None), ("e1", None)]


def test_rows_without_a_key_stay_out_of_the_join(spark):
    old = crashes(spark, ["e1", "e2"] + [None] * 18)
    new = crashes(spark, ["e1", "e3"] + [None] * 18, "fatal")
    merged = upserts.upsert_crashes(old, new)
    counts = {r["action"]: r["count"] for r in merged.groupBy("action").count().collect()}
    assert counts == {"updated": 1, "inserted": 19, "kept": 19} and merged.filter("external_id IS NULL").count() == 36
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = merged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # 90 % of both sides have no key; what the join reads has one.
    joined = plan[:plan.index("Union")] if "Union" not in plan.split("SortMergeJoin")[0] else plan
    assert "isnotnull(external_id" in joined and plan.count("SortMergeJoin") == 1


def test_bloom_filter_keeps_every_member_and_few_others(spark):
    members = spark.range(0, 40_000, 10).select(F.concat(F.lit("k"), "id").alias("k"))
    all_ = spark.range(40_000).select(F.concat(F.lit("k"), "id").alias("k")).unionByName(spark.createDataFrame([(None,)], "k string"))
    kept = sketches.keep_possible(all_, {"k": sketches.bloom_filter(members, "k")})
    assert kept.join(members, "k", "left_semi").count() == 4000
    assert kept.count() < 4000 * 1.25 and kept.filter("k IS NULL").isEmpty()
    none = sketches.keep_possible(all_, {"k": sketches.bloom_filter(members.limit(0), "k")})
    assert none.isEmpty()


def test_tract_load_is_refused_unless_every_row_counts(spark, tmp_path):
    from hazardgrid.plans.ingest import load_tracts
    schema = "tract_id string, muni_id int, pct_below_poverty double, svi_percentile double"
    old = spark.createDataFrame([("a", 1, .1, 10.0), ("b", 2, .2, 20.0)], schema)
    new = spark.createDataFrame([("b", None, None, 25.0), ("c", None, None, 30.0)], schema)
    assert rows(load_tracts(new, old, str(tmp_path / "ok"))) == [("a", 1, .1, 10.0), ("b", 2, .2, 25.0), ("c", None, None, 30.0)]
    with pytest.raises(snapshots.CountMismatch):              # two stored rows of one id
        load_tracts(new, old.unionByName(old), str(tmp_path / "bad"))
