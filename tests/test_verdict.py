"""Cases outside the check data that once gave wrong results."""

import datetime as dt

import pytest

from hazardgrid.operators import equity, freshness, upserts


def test_new_rows_without_a_key_are_all_inserted(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([(None, 5), (None, 5), ("b", 4), ("b", 3), ("a", 9)], "k string, v int")
    got = sorted(((r.k, r.v) for r in upserts.insert_if_absent(old, new, ["k"]).collect()), key=str)
    assert got == sorted([("a", 1), ("b", 3), (None, 5), (None, 5)], key=str)


def test_bicycle_evidence_keeps_the_year_column(spark):
    crashes = spark.createDataFrame([("x", 1, dt.date(2020, 5, 1), False, 1999)], "external_id string, muni_id int, crash_date date, bike_involved boolean, year int")
    evidence = spark.createDataFrame([("x", 2020, "Mercer")], "external_id string, year int, county string")
    munis = spark.createDataFrame([(1, "MERCER")], "muni_id int, county string")
    row = upserts.enrich_bicycle(crashes, evidence, munis).collect()[0]
    assert row.year == 1999 and row.bike_involved and row.matched


def test_every_lacking_municipality_is_reported(spark):
    crashes = spark.createDataFrame([(1, dt.date(2020, 5, 1))], "muni_id int, crash_date date")
    munis = spark.createDataFrame([(i,) for i in range(1, 102)], "muni_id int")
    with pytest.raises(freshness.MissingCrashData) as error:
        freshness.require_years(crashes, munis, 2020, 2020)
    assert error.value.count == 100 == error.value.rows.count()


def test_index_without_usable_components_ranks_nothing(spark):
    from hazardgrid import fixed_values as V
    columns = list(V.CENSUS_VARIABLES)
    df = spark.createDataFrame([tuple("0" for _ in columns)] * 4, ", ".join(f"`{c}` string" for c in columns))
    assert {r.svi_percentile for r in equity.vulnerability_index(df).collect()} == {0.0}
