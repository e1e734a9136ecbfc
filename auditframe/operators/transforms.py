"""The closed set of table operations: select, filter, sort, rename, dedupe, missing, derive, group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from auditframe.errors import RefusedError
from auditframe.functions.columns import (
    comparable, family, is_numeric, missing, number, present, ref, require_columns,
)
from auditframe.guards import Guard, GuardedChain
from auditframe.operators.filters import predicate
from auditframe.operators.quantiles import grouped_percentiles, join_on_keys, sketches
from auditframe.session import materialize
from auditframe.plans.specs import (
    DeriveColumn, DropDuplicates, FilterRows, GroupAggregate, HandleMissing, RenameColumns, SelectColumns, SortRows,
)


def apply_operations(df: DataFrame, operations: list) -> DataFrame:
    """Apply operations in order. All row-level refusals of the chain are checked in one job."""
    chain = GuardedChain(df)
    for op in operations:
        chain.apply(lambda frame, op=op: apply_operation(frame, op), operation_guards(chain.frame, op))
    return chain.checked()


def operation_guards(df: DataFrame, op) -> list[Guard]:
    if isinstance(op, DeriveColumn) and op.operator in ("divide", "ratio", "percentage") and op.right_column:
        require_columns(df, [op.right_column])
        if is_numeric(df, op.right_column, booleans=True):
            return [Guard("Division by zero is not allowed ({n} row(s)).", number(df, op.right_column) == 0)]
    return []


def apply_operation(df: DataFrame, op) -> DataFrame:
    if isinstance(op, SelectColumns):
        require_columns(df, op.columns)
        return df.select(*[ref(c) for c in op.columns])
    if isinstance(op, FilterRows):
        return df.filter(predicate(df, op))
    if isinstance(op, SortRows):
        return _sort(df, op)
    if isinstance(op, RenameColumns):
        return _rename(df, op)
    if isinstance(op, DropDuplicates):
        return drop_duplicates(df, op)
    if isinstance(op, HandleMissing):
        return _handle_missing(df, op)
    if isinstance(op, DeriveColumn):
        return _derive(df, op)
    if isinstance(op, GroupAggregate):
        return group_aggregate(df, op)
    raise RefusedError("Unsupported transformation operation.")


def _sort(df: DataFrame, op: SortRows) -> DataFrame:
    require_columns(df, [key.column for key in op.keys])
    order = [
        present(df, k.column).asc_nulls_last() if k.ascending else present(df, k.column).desc_nulls_last() for k in op.keys
    ]
    return df.orderBy(*order)


def _rename(df: DataFrame, op: RenameColumns) -> DataFrame:
    require_columns(df, list(op.mapping))
    resulting = [op.mapping.get(c, c) for c in df.columns]
    if len(resulting) != len(set(resulting)):
        raise RefusedError("Rename would create duplicate column names.")
    return df.select(*[ref(c).alias(op.mapping.get(c, c)) for c in df.columns])


def drop_duplicates(df: DataFrame, op: DropDuplicates) -> DataFrame:
    """Keep the first or last row per key.

    Full-row duplicates need no order. Otherwise a row number filtered to 1 is used: Spark plans
    it as a per-task group limit before the shuffle, so a hot key ships one row per task.
    """
    if op.columns is None or set(op.columns) == set(df.columns):
        return df.distinct()
    require_columns(df, [*op.columns, *op.order_by])
    rest = [c for c in df.columns if c not in op.order_by and c not in op.columns]
    order = [ref(c) for c in [*op.order_by, *rest]]
    order = [c.asc_nulls_last() if op.keep == "first" else c.desc_nulls_first() for c in order] or [F.lit(1)]
    window = Window.partitionBy(*[ref(c) for c in op.columns]).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(window)).filter(F.col("__rn") == 1).drop("__rn")


def _handle_missing(df: DataFrame, op: HandleMissing) -> DataFrame:
    columns = op.columns or df.columns
    require_columns(df, columns)
    if op.action == "drop":
        keep = F.lit(True)
        for c in columns:
            keep = keep & ~missing(df, c)
        return df.filter(keep)
    return df.select(*[_filled(df, c, op.value) if c in columns else ref(c) for c in df.columns])


def _filled(df: DataFrame, column: str, value) -> Column:
    data_type = df.schema[column].dataType
    pair = comparable(ref(column), data_type, value)
    whole = family(data_type) != "integer" or isinstance(value, int) or float(value).is_integer()
    if pair is None or family(data_type) == "boolean" and not isinstance(value, bool) or not whole:
        raise RefusedError(f"Fill value is incompatible with column '{column}'.")
    return F.coalesce(present(df, column), F.lit(value).cast(data_type)).alias(column)


def arithmetic(operator: str, left: Column, right: Column) -> Column:
    if operator == "add":
        return left + right
    if operator == "subtract":
        return left - right
    if operator == "multiply":
        return left * right
    ratio = F.try_divide(left.cast("double"), right.cast("double"))
    return ratio * 100 if operator == "percentage" else ratio


def _derive(df: DataFrame, op: DeriveColumn) -> DataFrame:
    if op.new_column in df.columns:
        raise RefusedError(f"Derived column '{op.new_column}' already exists.")
    operands = [op.left_column] + ([op.right_column] if op.right_column else [])
    require_columns(df, operands)
    for name in operands:
        if not is_numeric(df, name, booleans=True):
            raise RefusedError(f"Derived operation requires numeric column '{name}'.")
    if op.operator in ("divide", "ratio", "percentage") and op.constant is not None and op.constant == 0:
        raise RefusedError("Division by zero is not allowed.")
    left = _operand(df, op.left_column)
    right = F.lit(float(op.constant)) if op.constant is not None else _operand(df, op.right_column)
    return df.withColumn(op.new_column, arithmetic(op.operator, left, right))


def _operand(df: DataFrame, column: str) -> Column:
    c = present(df, column)
    return c.cast("bigint") if family(df.schema[column].dataType) in ("boolean", "integer") else c


def group_aggregate(df: DataFrame, op: GroupAggregate) -> DataFrame:
    """Group-by with missing keys as their own group; a sum over only missing values is 0."""
    require_columns(df, [*op.group_by, *[a.column for a in op.aggregations]])
    aggregates, medians = [], []
    for item in op.aggregations:
        numeric = is_numeric(df, item.column, booleans=True)
        if item.function in ("sum", "mean", "median") and not numeric:
            raise RefusedError(f"Aggregation '{item.function}' requires numeric column '{item.column}'.")
        value = present(df, item.column)
        operand = _operand(df, item.column) if numeric else value
        if item.function == "median":
            medians.append((item.output, item.column, 50.0))
        else:
            aggregates.append(
                {
                    "count": lambda: F.count(value),
                    "sum": lambda: F.coalesce(F.sum(operand), F.lit(0)),
                    "mean": lambda: F.avg(operand),
                    "min": lambda: F.min(value),
                    "max": lambda: F.max(value),
                }[item.function]().alias(item.output)
            )
    keys = [ref(k) for k in op.group_by]
    if not medians:
        return df.groupBy(*keys).agg(*aggregates)
    base = materialize(df.groupBy(*keys).agg(*aggregates, *sketches(df, medians)))
    result = join_on_keys(base, grouped_percentiles(df, op.group_by, medians, sketched=base), op.group_by, "left")
    return result.select(*keys, *[ref(a.output) for a in op.aggregations])
