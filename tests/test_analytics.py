"""Analytics plans: known numbers, refusals, and both execution strategies side by side."""

import json
import random
import statistics
from datetime import datetime
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from auditframe.errors import RefusedError
from auditframe.functions.identity import canonical_json, float_text
from auditframe.operators.windows import rank_rows, rolling_mean, series_change
from auditframe.plans.analytics import check_facts, refuse_large_result, run_plan, select_facts
from auditframe.plans.specs import AnalyticsPlan, Metric, PlanFilter
from auditframe.workload import QUERIES



@pytest.fixture()
def sales(spark):
    return spark.createDataFrame(
        [("Coast", "Ida", 620, 1500, "2026-03"), ("Coast", "Jon", 200, 1500, "2026-03"), ("Coast", "Ida", 110, 1500, "2026-03"), ("Hills", "Lea", 540, 700, "2026-03")],
        "region string, salesperson string, net_sales long, target long, month string",
    )


def facts(result):
    return {r["key"]: r["value"] for r in result.facts.collect()}


def test_target_variance(sales):
    plan = AnalyticsPlan("target_variance", group_by=["region"], value_column="net_sales", second_column="target", contributor_column="salesperson")
    found = facts(run_plan(sales, plan))
    assert found["target.worst_region_shortfall"] == 570 and found["target.top_contributor"] == 730


@pytest.mark.parametrize("target, message", [([2000, 1999, 1000], "not unique"), ([None, None, 1000], "must have a target")])
def test_target_refusals(spark, target, message):
    df = spark.createDataFrame([("N", 1, target[0]), ("N", 2, target[1]), ("S", 3, target[2])], "g string, v long, t long")
    with pytest.raises(RefusedError, match=message):
        run_plan(df, AnalyticsPlan("target_variance", group_by=["g"], value_column="v", second_column="t"))


def test_grouped_sum_order_and_limit(sales):
    plan = AnalyticsPlan("metrics", group_by=["region"], metrics=[Metric("sum", "net_sales")], limit=1)
    result = run_plan(sales, plan)
    assert [tuple(r) for r in result.table.collect()] == [("Coast", 930.0)]
    assert result.facts.count() == 2 and result.input_rows == 4


def test_fact_identity(spark):
    df = spark.createDataFrame([(None, 1), ("None", 2), ("Zürich \"x\"\n😀", 4)], "group string, value long")
    found = facts(run_plan(df, AnalyticsPlan("metrics", group_by=["group"], metrics=[Metric("sum", "value")])))
    assert len(found) == 3
    for group, value in ((None, 1.0), ("None", 2.0), ("Zürich \"x\"\n😀", 4.0)):
        text = json.dumps({"group": group}, sort_keys=True, separators=(",", ":"))
        assert found["metric.sum_value.group." + sha256(text.encode()).hexdigest()[:16]] == value


def test_canonical_json_matches_python(spark):
    rows = [("é\t\\", 1, 0.1, True, None), ("", -5, 1e20, False, "x"), ("\x7f", 0, 123456789.25, True, "~"), ("a", 7, 1e-7, False, "/"), ("b", 7, 3.0, None, "0")]
    df = spark.createDataFrame(rows, "s string, i long, f double, b boolean, n string")
    got = [r[0] for r in df.select(canonical_json(df, ["s", "i", "f", "b", "n"])).collect()]
    assert got == [json.dumps(dict(zip("sifbn", r)), sort_keys=True, separators=(",", ":")) for r in rows]


def test_float_text_matches_python(spark):
    rng = random.Random(3)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 20) for _ in range(300)] + [0.5, 1e16, 1e15, 100.0, 0.0001, 12345678.9]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(float_text(F.col("v"))).collect()]
    # Java 17 may print one digit more than the shortest form; both read back to the same number.
    assert [float(g) for g in got] == values
    assert all(("e" in g) == ("e" in repr(v)) for g, v in zip(got, values))


def test_metrics_against_python(spark):
    rng = random.Random(11)
    data = [("hot" if rng.random() < 0.5 else f"g{rng.randint(0, 5)}", rng.choice([None, *range(30)])) for _ in range(800)]
    df = spark.createDataFrame(data, "g string, v long").repartition(3)
    metrics = [Metric(n, "v") for n in ("distinct_count", "sum", "mean", "median", "min", "max", "variance", "std")]
    plan = AnalyticsPlan("metrics", group_by=["g"], metrics=[Metric("count"), *metrics, Metric("percentile", "v", 37.5)])
    got = {r["g"]: r for r in run_plan(df, plan).table.collect()}
    for g in {g for g, _ in data}:
        values = sorted(v for k, v in data if k == g and v is not None)
        at = (len(values) - 1) * 0.375
        low = values[int(at)]
        high = values[min(int(at) + 1, len(values) - 1)]
        expected = [
            sum(k == g for k, _ in data), len(set(values)), sum(values), statistics.mean(values), statistics.median(values), values[0],
            values[-1], statistics.variance(values), statistics.stdev(values), low + (high - low) * (at - int(at)),
        ]
        assert list(got[g])[1:] == pytest.approx(expected)


def test_overall_percentiles(spark):
    df = spark.createDataFrame([(float(v),) for v in (4, 1, 3, 2)], "v double")
    plan = AnalyticsPlan("metrics", metrics=[Metric("median", "v"), Metric("percentile", "v", 25), Metric("variance", "v")])
    assert tuple(run_plan(df, plan).table.first()) == pytest.approx((2.5, 1.75, 5 / 3))


def test_filters_and_null_policy(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0)], "k string, v double")
    plan = AnalyticsPlan("metrics", metrics=[Metric("count")], filters=[PlanFilter("v", "not_in", [1.0])])
    assert run_plan(df, plan).table.first()["count"] == 2
    with pytest.raises(RefusedError, match="No rows remain"):
        run_plan(df, AnalyticsPlan("metrics", filters=[PlanFilter("k", "eq", "z")]))
    with pytest.raises(RefusedError, match="No rows remain"):
        run_plan(df, AnalyticsPlan("metrics", group_by=["k"], filters=[PlanFilter("k", "eq", "z")]))
    with pytest.raises(RefusedError, match="Missing values"):
        run_plan(df, AnalyticsPlan("metrics", group_by=["k"], metrics=[Metric("sum", "v")], nulls="fail"))
    with pytest.raises(RefusedError, match="schema"):
        run_plan(df, AnalyticsPlan("metrics", expected_columns=["v", "k"]))
    with pytest.raises(RefusedError, match="Unknown column"):
        run_plan(df, AnalyticsPlan("metrics", metrics=[Metric("sum", "zz")]))


@pytest.mark.parametrize(
    "rows, schema, plan, message",
    [
        ([("x",)], "v string", AnalyticsPlan("metrics", metrics=[Metric("sum", "v")]), "not numeric"),
        ([(True,)], "v boolean", AnalyticsPlan("metrics", metrics=[Metric("sum", "v")]), "not numeric"),
        ([(float("inf"),)], "v double", AnalyticsPlan("metrics", metrics=[Metric("sum", "v")]), "infinite"),
        ([(2**53 + 1,)], "v long", AnalyticsPlan("metrics", metrics=[Metric("max", "v")]), "2\\^53"),
        ([(None,)], "v double", AnalyticsPlan("metrics", metrics=[Metric("sum", "v")]), "at least 1"),
        ([(1.0,)], "v double", AnalyticsPlan("metrics", metrics=[Metric("std", "v")]), "at least 2"),
        ([(1.0,)], "v double", AnalyticsPlan("rank", value_column="zz"), "Unknown"),
        ([(None,)], "v double", AnalyticsPlan("rank", value_column="v"), "at least one"),
    ],
)
def test_value_refusals(spark, rows, schema, plan, message):
    with pytest.raises(RefusedError, match=message):
        run_plan(spark.createDataFrame(rows, schema), plan)


def test_correlation(spark):
    df = spark.createDataFrame([(10, 1, 5), (20, 2, 5), (30, 3, 5), (None, 9, 5)], "x long, y long, flat long")
    assert facts(run_plan(df, AnalyticsPlan("correlation", value_column="x", second_column="y")))["correlation.pearson"] == pytest.approx(1.0)
    with pytest.raises(RefusedError, match="zero variance"):
        run_plan(df, AnalyticsPlan("correlation", value_column="x", second_column="flat"))
    with pytest.raises(RefusedError, match="two paired"):
        run_plan(df.limit(1), AnalyticsPlan("correlation", value_column="x", second_column="y"))


def test_distribution(spark):
    df = spark.createDataFrame([(10,), (20,), (40,), (None,)], "v long")
    found = facts(run_plan(df, AnalyticsPlan("distribution", value_column="v")))
    assert found["distribution.median"] == 20 and found["distribution.p25"] == 15 and found["distribution.missing_count"] == 1
    one = run_plan(df.filter("v = 10"), AnalyticsPlan("distribution", value_column="v"))
    assert "distribution.std" not in facts(one)


def test_ordered_series(spark):
    df = spark.createDataFrame([(3, 40), (1, 10), (2, 20)], "period long, value long")
    change = run_plan(df, AnalyticsPlan("percent_change", value_column="value", order_column="period"))
    assert facts(change) == {"percent_change.last": 100.0}
    rolled = run_plan(df, AnalyticsPlan("rolling_mean", value_column="value", order_column="period", window=2))
    assert facts(rolled) == {"rolling.mean.last": 30.0}
    with pytest.raises(RefusedError, match="complete window"):
        run_plan(df, AnalyticsPlan("rolling_mean", value_column="value", order_column="period", window=5))


@pytest.mark.parametrize(
    "rows, message",
    [
        ([("2026-01", 0.0), ("2026-02", 5.0)], "Division by zero"),
        ([("2026-01", 5.0)], "at least two"),
        ([("2026-01", None), ("2026-02", 5.0)], "at least two"),
        ([("2026-01", 1.0), ("2026-02", None), ("2026-03", 5.0)], "consecutive"),
        ([("soon", 1.0), ("2026-02", 5.0)], "could not be read"),
    ],
)
def test_change_refusals(spark, rows, message):
    df = spark.createDataFrame(rows, "month string, value double")
    with pytest.raises(RefusedError, match=message):
        run_plan(df, AnalyticsPlan("growth_rate", value_column="value", order_column="month"))


def test_zero_in_the_last_period_is_fine(spark):
    df = spark.createDataFrame([("2026-01", 5.0), ("2026-02", 0.0)], "month string, value double")
    assert [r["growth_rate"] for r in series_change(df, "value", "month").orderBy("month").collect()] == [None, -1.0]


@pytest.mark.parametrize("method, expected", [("dense", [1, 1, 2, None]), ("min", [1, 1, 3, None]), ("max", [2, 2, 3, None])])
def test_rank_ties(spark, method, expected):
    df = spark.createDataFrame([("a", 10), ("b", 10), ("c", 5), ("d", None)], "name string, value long")
    ranked = rank_rows(df, "value", method)
    assert [r["rank"] for r in ranked.orderBy("name").collect()] == expected


@pytest.mark.parametrize("method", ["dense", "min", "max"])
@pytest.mark.parametrize("ascending", [True, False])
def test_rank_strategies_agree_on_hot_values(spark, as_rows, method, ascending):
    df = spark.range(3000).select("id", F.expr("CASE WHEN id % 3 = 0 THEN 42 WHEN id % 10 = 1 THEN NULL ELSE pmod(hash(id), 200) END").alias("v"))
    function = {"dense": "dense_rank()", "min": "rank()", "max": "count(v)"}[method]
    order = "ASC NULLS LAST" if ascending else "DESC NULLS LAST"
    plain = df.selectExpr("*", f"CASE WHEN v IS NOT NULL THEN CAST({function} OVER (ORDER BY v {order}) AS DOUBLE) END AS rank")
    ranged = rank_rows(df.repartition(5), "v", method, ascending)
    assert as_rows(plain) == as_rows(ranged)


def test_rolling_strategies_agree_on_one_huge_group(spark, as_rows):
    df = spark.range(200_000).select(
        F.expr("CASE WHEN id % 3 > 0 THEN 'hot' ELSE concat('g', pmod(hash(id), 50)) END").alias("g"),
        F.pmod(F.hash("id"), F.lit(9973)).alias("o"), "id", F.expr("CASE WHEN id % 17 > 0 THEN CAST(id % 100 AS DOUBLE) END").alias("v"),
    )
    frame = "OVER (PARTITION BY g ORDER BY o, id, v ROWS 3 PRECEDING)"
    plain = df.selectExpr("*", f"CASE WHEN count(v) {frame} = 4 THEN avg(v) {frame} END AS rolling_mean")
    blocks = rolling_mean(df.repartition(6), "v", "o", 4, ["g"])
    total = plain.join(blocks.withColumnRenamed("rolling_mean", "other"), ["g", "o", "id"])
    assert total.count() == 200_000
    assert total.filter("NOT (rolling_mean <=> other) AND abs(rolling_mean - other) > 1e-9 OR (rolling_mean IS NULL) <> (other IS NULL)").count() == 0


def test_identical_rows_spread_and_stay_whole(spark):
    df = spark.range(50_000).select(F.lit(1).alias("o"), F.lit(2.0).alias("v")).repartition(8)
    rolled = rolling_mean(df, "v", "o", 3)
    assert rolled.agg(F.count(F.lit(1)), F.count("rolling_mean"), F.max("rolling_mean")).first() == (50_000, 49_998, 2.0)


def test_select_facts(spark):
    spark.createDataFrame([(1, 2.5), (2, 3.5)], "a long, b double").createOrReplaceTempView("select_facts_input")
    one = {r["key"]: r["value"] for r in select_facts(spark, "SELECT sum(b) AS total, 'x' AS t FROM select_facts_input").collect()}
    assert one == {"metric.count": 1.0, "sql.total": 6.0}
    assert [r["value"] for r in select_facts(spark, "SELECT * FROM select_facts_input;").collect()] == [2.0]
    commented = "-- first\n/* then */ (SELECT sum(a) AS total FROM select_facts_input) -- last"
    assert [r["value"] for r in select_facts(spark, commented).collect()] == [1.0, 3.0]
    assert [r["value"] for r in select_facts(spark, "SELECT ';--' AS t, 4 AS n; -- end").collect()] == [1.0, 4.0]
    with pytest.raises(RefusedError, match="at most 1 rows"):
        select_facts(spark, "SELECT * FROM select_facts_input", max_rows=1)
    for text in ("DROP TABLE x", "", "INSERT INTO t VALUES (1)"):
        with pytest.raises(RefusedError):
            select_facts(spark, text)


def test_result_expectations(spark, sales):
    refuse_large_result(sales, 20)
    with pytest.raises(RefusedError):
        refuse_large_result(sales, 19)
    twice = run_plan(sales, AnalyticsPlan("metrics")).facts
    check_facts(twice)
    with pytest.raises(RefusedError, match="duplicate identity"):
        check_facts(twice.union(twice))


def test_change_from_zero_is_infinite_where_asked(spark):
    rows = [(1, 5.0), (2, 0.0), (3, 0.0), (4, 2.0), (5, 0.0), (6, -2.0), (7, None), (8, 1.0)]
    df = spark.createDataFrame(rows, "at int, value double")
    found = [r["growth_rate"] for r in series_change(df, "value", "at", refuse_zero=False).orderBy("at").collect()]
    assert str(found) == "[None, -1.0, nan, inf, -1.0, -inf, None, None]"


def test_growth_per_event_with_a_zero(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1), 0.0), (2, datetime(2024, 1, 2), 3.0), (3, datetime(2024, 1, 3), 6.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    found = {r["event_id"]: r["growth_rate"] for r in QUERIES["growth_rate_per_event_by_blocks"](spark, str(tmp_path)).collect()}
    assert found == {1: None, 2: float("inf"), 3: 1.0}
