"""Specifications refuse unknown fields and impossible combinations."""

import pytest

from auditframe.errors import RefusedError
from auditframe.plans.specs import (
    AnalyticsPlan, DerivationRule, FieldMapping, FieldReference, JoinSpec, Metric, PlanFilter, TargetColumn, TransformPlan, operation,
)


@pytest.mark.parametrize(
    "payload",
    [
        {"type": "python", "code": "1"},
        {"type": "select", "columns": ["a"], "extra": 1},
        {"type": "filter", "column": "a", "operator": "like", "value": "x"},
        {"type": "filter", "column": "a", "operator": "contains", "value": 5},
        {"type": "filter", "column": "a", "operator": "in", "value": 5},
        {"type": "filter", "column": "a", "operator": "gt", "value": None},
        {"type": "filter", "column": "a", "operator": "gt", "value": float("nan")},
        {"type": "sort", "keys": []},
        {"type": "rename", "mapping": {"a": ""}},
        {"type": "missing", "action": "fill"},
        {"type": "derive", "new_column": "n", "left_column": "a", "operator": "add"},
        {"type": "derive", "new_column": "n", "left_column": "a", "operator": "add", "right_column": "b", "constant": 1.0},
        {"type": "group", "group_by": [], "aggregations": [{"column": "a", "function": "sum"}]},
        {"type": "group", "group_by": ["a"], "aggregations": [{"column": "a", "function": "sum", "alias": "a"}]},
        {"type": "group", "group_by": ["a"], "aggregations": [{"column": "b", "function": "eval"}]},
        {"type": "drop_duplicates", "keep": "none"},
    ],
)
def test_operations_refuse(payload):
    with pytest.raises(RefusedError):
        operation(payload)


@pytest.mark.parametrize(
    "build",
    [
        lambda: JoinSpec([], []),
        lambda: JoinSpec(["a"], ["a", "b"]),
        lambda: JoinSpec(["a"], ["a"], "cross"),
        lambda: PlanFilter("a", "is_null", 1),
        lambda: PlanFilter("a", "in", []),
        lambda: PlanFilter("a", "contains", "x"),
        lambda: Metric("count", "a"),
        lambda: Metric("sum"),
        lambda: Metric("percentile", "a"),
        lambda: Metric("percentile", "a", 101),
        lambda: Metric("sum", "a", 5),
        lambda: AnalyticsPlan("metrics", value_column="a"),
        lambda: AnalyticsPlan("rank"),
        lambda: AnalyticsPlan("rank", value_column="a", group_by=["b"]),
        lambda: AnalyticsPlan("rolling_mean", value_column="a", order_column="b"),
        lambda: AnalyticsPlan("rolling_mean", value_column="a", order_column="b", window=1),
        lambda: AnalyticsPlan("percent_change", value_column="a"),
        lambda: AnalyticsPlan("correlation", value_column="a"),
        lambda: AnalyticsPlan("target_variance", value_column="a", second_column="b"),
        lambda: AnalyticsPlan("distribution", value_column="a", contributor_column="b"),
        lambda: AnalyticsPlan("metrics", metrics=[Metric("sum", "a"), Metric("sum", "a")]),
        lambda: AnalyticsPlan("metrics", group_by=["sum_a"], metrics=[Metric("sum", "a")]),
        lambda: AnalyticsPlan("metrics", group_by=["a", "a"]),
        lambda: AnalyticsPlan("metrics", limit=0),
        lambda: FieldMapping("a", "role", None),
        lambda: DerivationRule("a", "add", [FieldReference("s", "x")]),
        lambda: DerivationRule("a", "policy_multiply", [FieldReference("s", "x")]),
        lambda: DerivationRule("a", "concat", [FieldReference("s", "x")], constant=1.0),
        lambda: TransformPlan(["s"], {}, [TargetColumn("A")], []),
        lambda: TransformPlan(["s"], {}, [TargetColumn("A")], [FieldMapping("A")], required_fields=["B"]),
    ],
)
def test_plans_refuse(build):
    with pytest.raises(RefusedError):
        build()


def test_default_names():
    assert Metric("percentile", "v", 99.5).output == "p99_5_v"
    assert Metric("percentile", "v", 25).output == "p25_v"
    assert AnalyticsPlan("metrics").metrics == [Metric("count")]


def test_nothing_is_cut_by_default():
    assert AnalyticsPlan("metrics").limit is None and AnalyticsPlan("metrics", limit=50_000).limit == 50_000
    assert len(AnalyticsPlan("metrics", filters=[PlanFilter("a", "in", list(range(5000)))] * 21).filters) == 21
