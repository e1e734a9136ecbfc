"""Row predicates. Comparisons keep the missing-value rules of the specification, not SQL's.

``ne`` and ``not_in`` keep rows whose value is missing; every other comparison drops them.
Predicates stay plain column comparisons so that Catalyst can push them to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from auditframe.errors import RefusedError
from auditframe.functions.columns import comparable, family, is_binary_float, missing, ref, require_columns
from auditframe.plans.specs import FilterRows, PlanFilter


def predicate(df: DataFrame, spec: FilterRows | PlanFilter) -> Column:
    require_columns(df, [spec.column])
    data_type = df.schema[spec.column].dataType
    column = ref(spec.column)
    op = spec.operator
    if op == "is_null":
        return missing(df, spec.column)
    if op == "not_null":
        return ~missing(df, spec.column)
    if op == "contains":
        return F.coalesce(column.cast("string").contains(spec.value), F.lit(False))
    if op in ("in", "not_in"):
        inside = _membership(df, spec)
        return inside if op == "in" else ~inside
    pair = comparable(column, data_type, spec.value)
    if pair is None:
        if op in ("eq", "ne"):
            return F.lit(op == "ne")
        raise RefusedError(f"Filter '{op}' is incompatible with column '{spec.column}' of type {family(data_type)}.")
    left, right = pair
    if op == "eq":
        return left == right
    if op == "ne":
        return ~left.eqNullSafe(right)
    compared = {"gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right}[op]
    if op in ("gt", "gte") and is_binary_float(data_type):
        # Spark orders NaN above every number; a missing value satisfies no ordering.
        compared = compared & ~F.isnan(column)
    return compared


def _membership(df: DataFrame, spec: FilterRows | PlanFilter) -> Column:
    data_type = df.schema[spec.column].dataType
    column = ref(spec.column)
    pairs = [comparable(column, data_type, v) for v in spec.value if v is not None]
    pairs = [p for p in pairs if p is not None]
    inside = F.coalesce(pairs[0][0].isin(*[p[1] for p in pairs]), F.lit(False)) if pairs else F.lit(False)
    if any(v is None for v in spec.value):
        inside = inside | missing(df, spec.column)
    return inside


def apply_filters(df: DataFrame, filters: list[PlanFilter]) -> DataFrame:
    """Conjunction of plan filters; Catalyst merges the chain into one predicate."""
    for spec in filters:
        df = df.filter(predicate(df, spec))
    return df
