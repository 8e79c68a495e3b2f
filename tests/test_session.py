from pathlib import Path

import pytest

from hazardgrid.session import scratch, stage, work_folder


def folders(spark):
    return {p.name for p in Path(work_folder(spark).removeprefix("file:")).glob("scoped-*")}


def test_staged_folders_go_with_their_scope(spark):
    before = folders(spark)
    with scratch(spark):
        stage(spark.range(3), "scoped-a")
        with scratch(spark):
            stage(spark.range(3), "scoped-b")
            result = stage(spark.range(5), "scoped-c", keep=True)
        assert {n[:8] for n in folders(spark) - before} == {"scoped-a", "scoped-c"}
        assert result.count() == 5
        kept = stage(result, "scoped-d", keep=True)
    assert {n[:8] for n in folders(spark) - before} == {"scoped-d"} and kept.count() == 5
    with pytest.raises(ZeroDivisionError), scratch(spark):
        stage(spark.range(3), "scoped-e")
        1 / 0
    assert {n[:8] for n in folders(spark) - before} == {"scoped-d"}
