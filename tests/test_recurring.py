"""Refreshing a plan over a folder by period: changed periods only, drifting files by name."""

import pytest
from pyspark.sql import functions as F

from auditframe.errors import RefusedError
from auditframe.plans.recurring import PeriodStore
from auditframe.plans.runs import Contract, DriftError
from auditframe.plans.specs import AnalyticsPlan, Metric

PLAN = AnalyticsPlan("metrics", group_by=["g"], metrics=[Metric("count"), Metric("sum", "v")])
CONTRACT = Contract(["g", "v", "month"], {"g": "string", "v": "bigint", "month": "string"})


def write(spark, folder, month, rows, mode="append", kinds="g string, v long"):
    spark.createDataFrame(rows, kinds).coalesce(1).write.mode(mode).parquet(f"{folder}/month={month}")


def test_refresh(spark, tmp_path):
    folder, store = str(tmp_path / "in"), PeriodStore(spark, str(tmp_path / "store"))
    for month in ("2024-01", "2024-02", "2024-03"):
        write(spark, folder, month, [("a", 1), ("b", int(month[-1]))])

    def stored():
        return {(r["month"], r["g"]): (r["count"], r["sum_v"]) for r in store.results().collect()}

    with pytest.raises(RefusedError, match="Nothing"):
        store.results()
    assert store.refresh(folder, PLAN, "month", CONTRACT) == ["2024-01", "2024-02", "2024-03"]
    assert store.refresh(folder, PLAN, "month", CONTRACT) == [] and len(stored()) == 6
    write(spark, folder, "2024-02", [("b", 10), ("c", 5)])
    write(spark, folder, "2024-04", [("a", 7)])
    assert store.refresh(folder, PLAN, "month", CONTRACT) == ["2024-02", "2024-04"]
    found = stored()
    assert found["2024-02", "b"] == (2, 12) and found["2024-02", "c"] == (1, 5) and found["2024-04", "a"] == (1, 7) and found["2024-01", "b"] == (1, 1)
    write(spark, folder, "2024-01", [("z", 3)], "overwrite")
    assert store.refresh(folder, PLAN, "month", CONTRACT) == ["2024-01"] and ("2024-01", "b") not in stored()


@pytest.mark.parametrize("rows, kinds, kind", [([("a", 1.5)], "g string, v double", "type"), ([("a", 1, 2)], "g string, v long, w long", "schema"), ([(1, "a")], "v long, g string", "schema")])
def test_a_drifting_file_is_named(spark, tmp_path, rows, kinds, kind):
    folder, store = str(tmp_path / "in"), PeriodStore(spark, str(tmp_path / "store"))
    write(spark, folder, "2024-01", [("a", 1)])
    store.refresh(folder, PLAN, "month", CONTRACT)
    write(spark, folder, "2024-02", [("a", 1)])
    write(spark, folder, "2024-02", rows, kinds=kinds)
    with pytest.raises(DriftError, match="month=2024-02/part-") as caught:
        store.refresh(folder, PLAN, "month", CONTRACT)
    assert caught.value.finding.kind == kind and store.results().where(F.col("month") == "2024-02").count() == 0


def test_plans_without_groups_by_period_are_refused(spark, tmp_path):
    with pytest.raises(RefusedError, match="keyed by period"):
        PeriodStore(spark, str(tmp_path)).refresh(str(tmp_path), AnalyticsPlan("rank", value_column="v"), "month", CONTRACT)
