from pyspark.sql import functions as F
from test_dashboard import frame, munis  # noqa: F401

from hazardgrid.functions import text as T
from hazardgrid.operators import validation as C
from hazardgrid.session import small_methods, spread_rows


def test_wide_rows_are_not_shuffled_by_municipality_name(spark, munis):  # noqa: F811
    tagged = C.tag_dashboard(frame(spark, {}), munis)
    plan = tagged._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and tagged.count() == 1


def test_rows_are_tagged_once(spark, munis):  # noqa: F811
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    tagged = C.tag_dashboard(frame(spark, {}, {}, {"id_cr": "43"}, {"id_cr": "x"}), munis)
    audited = C.duplicate_identity_audit(tagged.mapInArrow(count, tagged.schema))
    bad = audited.filter("reason IS NOT NULL")
    assert bad.join(bad.groupBy("dashboard_id").count(), "dashboard_id").count() == 4 and seen.value == 4


def test_tasks_grow_with_the_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread_rows(spark.range(30 * cores), 3).rdd.getNumPartitions() == 10 * cores
    assert spread_rows(spark.range(3), 3).rdd.getNumPartitions() == cores


def test_setting_is_put_back(spark):
    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    with small_methods(spark):
        assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == before


def test_summary_labels_of_odd_cells(spark):
    cells = {'["a", "b"]': ["a", "b"], "[]": [], '[ "a" ]': ["a"], '["a",]': None, '["a" "b"]': None, '["a\\"b"]': ['a"b'], '["\\u0041"]': ["A"], "[null]": None,
             '["a", 1]': None, "[broken": None, "": [], "one": ["one"], '["é"]': ["é"]}
    plain = spark.createDataFrame([(k,) for k in cells], "t string").select("t", T.summary_labels(F.col("t")).alias("x"))
    got = {r["t"]: r["x"] for r in plain.collect()}
    assert got == cells
