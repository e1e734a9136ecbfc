"""Table operations on small tables with missing values, and their refusals."""

import re

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from auditframe.errors import RefusedError
from auditframe.operators.transforms import apply_operations, group_aggregate
from auditframe.plans.specs import operation


@pytest.fixture()
def sales(spark):
    return spark.createDataFrame(
        [(1, "North", 100.0, 40, True), (2, "South", None, 50, False), (2, "South", None, 50, False), (3, None, 200.0, 0, True)],
        "id long, region string, amount double, cost long, paid boolean",
    )


def run(df, *payloads):
    return apply_operations(df, [operation(p) for p in payloads])


@pytest.mark.parametrize(
    "spec, ids",
    [
        ({"operator": "eq", "column": "region", "value": "North"}, [1]),
        ({"operator": "ne", "column": "region", "value": "North"}, [2, 2, 3]),
        ({"operator": "gt", "column": "amount", "value": 100}, [3]),
        ({"operator": "gte", "column": "amount", "value": 100}, [1, 3]),
        ({"operator": "lt", "column": "cost", "value": 50}, [1, 3]),
        ({"operator": "lte", "column": "cost", "value": 50}, [1, 2, 2, 3]),
        ({"operator": "contains", "column": "region", "value": "out"}, [2, 2]),
        ({"operator": "in", "column": "region", "value": ["North", None]}, [1, 3]),
        ({"operator": "is_null", "column": "amount"}, [2, 2]),
        ({"operator": "not_null", "column": "amount"}, [1, 3]),
        ({"operator": "eq", "column": "region", "value": 5}, []),
        ({"operator": "ne", "column": "region", "value": 5}, [1, 2, 2, 3]),
        ({"operator": "in", "column": "region", "value": [5]}, []),
        ({"operator": "eq", "column": "paid", "value": True}, [1, 3]),
    ],
)
def test_filters(sales, spec, ids):
    assert sorted(r["id"] for r in run(sales, {"type": "filter", **spec}).collect()) == ids


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 5.0), (3, None)], "id long, v double")
    assert [r["id"] for r in run(df, {"type": "filter", "column": "v", "operator": "gt", "value": 1}).collect()] == [2]
    assert sorted(r["id"] for r in run(df, {"type": "filter", "column": "v", "operator": "is_null"}).collect()) == [1, 3]
    filled = run(df, {"type": "missing", "action": "fill", "columns": ["v"], "value": 0})
    assert sorted(r["v"] for r in filled.collect()) == [0.0, 0.0, 5.0]


@pytest.mark.parametrize(
    "payload",
    [
        {"type": "select", "columns": ["nope"]},
        {"type": "filter", "column": "region", "operator": "gt", "value": 5},
        {"type": "rename", "mapping": {"id": "cost"}},
        {"type": "missing", "action": "fill", "columns": ["region"], "value": 5},
        {"type": "missing", "action": "fill", "columns": ["cost"], "value": 0.5},
        {"type": "derive", "new_column": "cost", "left_column": "amount", "operator": "add", "constant": 1.0},
        {"type": "derive", "new_column": "x", "left_column": "region", "operator": "add", "constant": 1.0},
        {"type": "derive", "new_column": "x", "left_column": "amount", "operator": "divide", "right_column": "cost"},
        {"type": "derive", "new_column": "x", "left_column": "amount", "operator": "percentage", "constant": 0.0},
        {"type": "group", "group_by": ["id"], "aggregations": [{"column": "region", "function": "mean"}]},
        {"type": "drop_duplicates", "columns": ["nope"]},
    ],
)
def test_refusals(sales, payload):
    with pytest.raises(RefusedError):
        run(sales, payload)


def test_zero_divisor_is_refused_even_when_unused_later(sales):
    with pytest.raises(RefusedError, match="Division by zero"):
        run(
            sales,
            {"type": "derive", "new_column": "x", "left_column": "amount", "operator": "ratio", "right_column": "cost"},
            {"type": "filter", "column": "cost", "operator": "gt", "value": 0},
            {"type": "select", "columns": ["id"]},
        )


def test_zero_divisors_filtered_before_are_fine(sales):
    result = run(
        sales,
        {"type": "filter", "column": "cost", "operator": "gt", "value": 0},
        {"type": "derive", "new_column": "pct", "left_column": "amount", "operator": "percentage", "right_column": "cost"},
        {"type": "filter", "column": "pct", "operator": "not_null"},
    )
    assert [r["pct"] for r in result.collect()] == [250.0]


def test_boolean_counts_as_a_number(sales):
    result = run(sales, {"type": "derive", "new_column": "x", "left_column": "paid", "operator": "add", "right_column": "cost"})
    assert sorted(r["x"] for r in result.collect()) == [1, 41, 50, 50]


def test_chain_and_group(sales, as_rows):
    result = run(
        sales,
        {"type": "drop_duplicates"},
        {"type": "missing", "action": "fill", "columns": ["amount"], "value": 10.0},
        {"type": "derive", "new_column": "net", "left_column": "amount", "operator": "subtract", "right_column": "cost"},
        {"type": "group", "group_by": ["region"], "aggregations": [{"column": "net", "function": "sum"}, {"column": "id", "function": "count"}]},
    )
    assert as_rows(result) == [(None, 200.0, 1), ("North", 60.0, 1), ("South", -40.0, 1)]


def test_sum_of_only_missing_values_is_zero(spark):
    df = spark.createDataFrame([("a", None), ("a", None)], "k string, v double")
    result = run(df, {"type": "group", "group_by": ["k"], "aggregations": [{"column": "v", "function": "sum"}, {"column": "v", "function": "mean"}]})
    assert [tuple(r) for r in result.collect()] == [("a", 0.0, None)]


@pytest.mark.parametrize("keep, expected", [("first", [("a", 1), ("b", 5)]), ("last", [("a", 9), ("b", 5)])])
def test_dedupe_order(spark, as_rows, keep, expected):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 9), ("b", 5)], "k string, v long")
    result = run(df, {"type": "drop_duplicates", "columns": ["k"], "keep": keep, "order_by": ["v"]})
    assert as_rows(result) == expected


def test_dedupe_limits_a_hot_key_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS v")
    plan = plan_of(run(df, {"type": "drop_duplicates", "columns": ["k"], "order_by": ["v"]}))
    assert re.search(r"WindowGroupLimit .*Partial", plan)


def test_sort_puts_missing_last_both_ways(sales):
    for ascending in (True, False):
        result = run(sales, {"type": "sort", "keys": [{"column": "amount", "ascending": ascending}]})
        assert [r["amount"] for r in result.collect()][-2:] == [None, None]


def test_group_median_ways_agree(spark, as_rows):
    df = spark.range(5000).select((F.col("id") % 7).alias("k"), F.when(F.col("id") % 11 > 0, F.pmod(F.hash("id"), F.lit(97))).alias("v"))
    op = operation({"type": "group", "group_by": ["k"], "aggregations": [{"column": "v", "function": "median"}, {"column": "v", "function": "max"}]})
    plain = df.groupBy("k").agg(F.percentile("v", F.lit(0.5)), F.max("v"))
    assert as_rows(group_aggregate(df, op)) == as_rows(plain)


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1, 2.0)], "`a.b` long, `c.d` double")
    result = run(
        df,
        {"type": "derive", "new_column": "e.f", "left_column": "a.b", "operator": "add", "right_column": "c.d"},
        {"type": "rename", "mapping": {"a.b": "x.y"}},
        {"type": "filter", "column": "x.y", "operator": "eq", "value": 1},
    )
    assert result.columns == ["x.y", "c.d", "e.f"] and result.first()["e.f"] == 3.0
