import csv
import io

from conftest import rows
from test_archives import raw

from hazardgrid.operators import snapshots
from hazardgrid.streaming.incremental import load_new_archives


def write(path, *records):
    out = io.StringIO()
    csv.writer(out).writerows(records)
    path.write_bytes(out.getvalue().encode("latin-1"))


def test_archives_load_once_and_every_record_is_accounted_for(spark, tmp_path):
    ring = [[{"x": -75.0, "y": 40.0}, {"x": -74.0, "y": 40.0}, {"x": -74.0, "y": 41.0}, {"x": -75.0, "y": 41.0}, {"x": -75.0, "y": 40.0}]]
    munis = spark.createDataFrame([(1, "1113", "West Windsor Township", "Mercer", ring)],
                                  "muni_id int, muni_code string, name string, county string, rings array<array<struct<x:double,y:double>>>")
    routes = spark.createDataFrame([], "source_id string, sri string, mp_start double, mp_end double, pts array<struct<x:double,y:double,m:double>>")
    inbox, root = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    write(inbox / "Mercer2022Accidents.txt", raw(id="1"), raw(id="1", severity="F"), raw(id="2", latitude="", longitude=""),
          raw(id="3", severity="?"), raw(id="4", municipality_name="Elsewhere"), ["short"])
    load_new_archives(spark, str(inbox), root, munis, routes).awaitTermination()
    crashes = f"{root}/crashes"
    state = snapshots.read(spark, crashes)
    assert rows(state, "external_id", "severity", "geocode_quality") == [("NJDOT:2022:MERCER:1", "fatal", "reported")]
    totals = spark.read.json(f"{root}/manifest/*").first()
    assert (totals["records"], totals["loaded"], totals["duplicate"], totals["rejected"]) == (6, 1, 1, 4)

    write(inbox / "Mercer2021Accidents.txt", raw(id="9", crash_date="01/01/2021"))
    load_new_archives(spark, str(inbox), root, munis, routes).awaitTermination()
    assert snapshots.read(spark, crashes).count() == 2 and snapshots.read(spark, crashes, 2).count() == 1
    # The second load wrote its own year only.
    assert [sorted(p.name for p in load.iterdir() if p.is_dir()) for load in sorted((tmp_path / "out" / "crashes" / "data").iterdir(), key=lambda f: f.stat().st_mtime)] == [
        [], ["part_year=2022"], ["part_year=2021"]]
    rejected = spark.read.json(f"{root}/rejected/*")
    assert rejected.count() == 4 and spark.read.json(f"{root}/reasons/*").count() >= 1
    load_new_archives(spark, str(inbox), root, munis, routes).awaitTermination()      # nothing new
    assert snapshots.current(spark, crashes) == 3
