"""Ranks, rolling means and period changes over ordered rows.

Global positions stand in for a whole-table window, so that neither a missing ``PARTITION BY`` nor a
huge group ends up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from auditframe.errors import RefusedError
from auditframe.functions.columns import (
    is_numeric, number, present, ref, require_columns, require_numeric, unsafe_number,
)
from auditframe.functions.scalars import moment
from auditframe.operators.ordering import add_positions, add_running_counts, with_halo
from auditframe.session import shuffle_partitions


def check_values(df: DataFrame, columns: Sequence[str], extra: dict[str, Column] | None = None) -> dict:
    """One job: refuse unsafe numbers, return the row count and any extra aggregates."""
    for c in columns:
        require_columns(df, [c])
        require_numeric(df, c)
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(unsafe_number(df, c)).alias(f"bad{i}") for i, c in enumerate(columns)],
        *[c.alias(name) for name, c in (extra or {}).items()],
    ).first().asDict()
    refuse_unsafe(columns, row)
    return row


def refuse_unsafe(columns: Sequence[str], row: dict) -> None:
    for i, c in enumerate(columns):
        if row.get(f"bad{i}"):
            raise RefusedError(
                f"Column '{c}' contains {row[f'bad{i}']} infinite value(s) or integers beyond the exact range of 2^53."
            )


# ---- ranks ------------------------------------------------------------------------------------


def rank_checks(df: DataFrame, value: str) -> dict:
    """Refuse values that cannot be ranked; the row count and the number of values."""
    require_columns(df, [value])
    require_numeric(df, value)
    checked = check_values(df, [value], {"filled": F.count(number(df, value))})
    if checked["rows"] and not checked["filled"]:
        raise RefusedError("Rank requires at least one non-null numeric value.")
    return checked


def rank_rows(df: DataFrame, value: str, method: str = "dense", ascending: bool = False, checked: dict | None = None) -> DataFrame:
    """``df`` plus ``rank`` (dense, min or max); a missing value has no rank."""
    checked = checked or rank_checks(df, value)
    return _rank_by_value(df, value, method, ascending, checked["rows"])


def _rank_by_value(df: DataFrame, value: str, method: str, ascending: bool, rows: int) -> DataFrame:
    """Rank the distinct values, then look the rank up by value.

    Repeated values are folded to (value, count) before the ordering, so ties carry no skew. In
    the lookup every value occurs once on the small side, which lets adaptive execution split a
    hot value on the large side; rows without a value are spread over many salts.
    """
    v = present(df, value)
    counted = df.filter(v.isNotNull()).groupBy(v.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    ranged = add_running_counts(counted, [F.col("__v").asc() if ascending else F.col("__v").desc()], "__n", rows)
    rank = {"dense": F.col("__pos") + 1, "min": F.col("__from") + 1, "max": F.col("__from") + F.col("__n")}[method]
    ranks = ranged.select("__v", rank.alias("__rank"))
    salts = shuffle_partitions(df.sparkSession)
    scattered = F.pmod(F.xxhash64(*[ref(c) for c in df.columns]), F.lit(salts)) + 1
    left = df.withColumn("__lv", v).withColumn("__salt", F.when(v.isNotNull(), F.lit(0)).otherwise(scattered))
    right = ranks.withColumn("__zero", F.lit(0).cast("long"))
    joined = left.join(right, (F.col("__lv") == F.col("__v")) & (F.col("__salt") == F.col("__zero")), "left")
    return joined.select(*[ref(c) for c in df.columns], F.col("__rank").cast("double").alias("rank"))


# ---- ordered series ---------------------------------------------------------------------------


def order_key(df: DataFrame, column: str) -> Column:
    """A number as it is, anything else as a timestamp; unparsable text becomes null."""
    if is_numeric(df, column):
        return present(df, column)
    return moment(df, column)


def with_order_key(df: DataFrame, column: str) -> DataFrame:
    """``df`` with its order column parsed in place."""
    return df.withColumn(column, order_key(df, column))


def check_order(df: DataFrame, order: str, values: Sequence[str], extra: dict[str, Column] | None = None) -> dict:
    """Refuse unparsable order keys and unsafe values; return the row count and extra aggregates."""
    require_columns(df, [order])
    numeric = is_numeric(df, order)
    checks = {
        "order_bad": F.count_if(unsafe_number(df, order) if numeric else order_key(df, order).isNull()),
        "order_given": F.count(present(df, order)),
        **(extra or {}),
    }
    row = check_values(df, values, checks)
    if row["order_bad"] and (numeric or row["order_given"]):
        raise RefusedError(f"Order column '{order}' could not be read as finite numbers or dates in {row['order_bad']} row(s).")
    return row


def _series_order(df: DataFrame, order: str, first: Sequence[str] = ()) -> list[Column]:
    """Sort keys: groups, the order column (missing last), then every other column as tie-break."""
    rest = [c for c in df.columns if c != order and c not in first]
    return [*[ref(c).asc_nulls_last() for c in first], present(df, order).asc_nulls_last(), *[ref(c).asc_nulls_last() for c in rest]]


def rolling_checks(df: DataFrame, value: str, order: str) -> dict:
    require_columns(df, [value, order])
    require_numeric(df, value)
    return check_order(df, order, [value], {"filled": F.count(number(df, value))})


def rolling_mean(
    df: DataFrame, value: str, order: str, window: int, group_by: Sequence[str] = (), checked: dict | None = None,
) -> DataFrame:
    """``df`` plus ``rolling_mean`` over the last ``window`` rows; null until all are present."""
    checked = checked or rolling_checks(df, value, order)
    df = with_order_key(df, order)
    v = number(df, value)
    groups = [ref(c) for c in group_by]
    blocks = with_halo(add_positions(df, _series_order(df, order, group_by), checked["rows"]), window - 1, checked["rows"])
    frame = Window.partitionBy("__block", *groups).orderBy("__pos").rowsBetween(1 - window, 0)
    result = blocks.withColumn("rolling_mean", F.when(F.count(v).over(frame) == window, F.avg(v).over(frame)))
    return result.filter("__own").select(*[ref(c) for c in df.columns], "rolling_mean")


def change_checks(df: DataFrame, value: str, order: str, refuse_zero: bool = True) -> dict:
    """Refuse a series without changes or, unless told otherwise, with a zero to divide by.

    Whether a previous value is zero follows from the zero count and the last row's value, so
    the check needs no ordered pass.
    """
    require_columns(df, [value, order])
    require_numeric(df, value)
    v = number(df, value)
    key = order_key(df, order)
    # Matches the sort order: a missing key sorts last, and so does a missing value among ties.
    last = F.struct(key.isNull().alias("n"), key.alias("k"), *_nulls_last(df, order))
    checked = check_order(
        df, order, [value],
        {"zeros": F.count_if(v == 0), "filled": F.count(v), "last": F.max_by(F.struct(v.alias("v")), last)},
    )
    if not checked["rows"]:
        return checked
    last_value = checked["last"]["v"]
    if refuse_zero and checked["zeros"] - (last_value == 0) > 0:
        raise RefusedError("Division by zero: a previous period value is 0.")
    if checked["filled"] - (last_value is not None) <= 0:
        raise RefusedError("Percent change requires at least two ordered values.")
    return checked


def series_change(df: DataFrame, value: str, order: str, checked: dict | None = None, refuse_zero: bool = True) -> DataFrame:
    """``df`` plus ``percent_change`` and ``growth_rate`` against the previous ordered row.

    A previous value of zero refuses the whole series. With ``refuse_zero=False`` the change from it is
    that of floating-point division: infinite with the sign of the change, NaN from zero to zero.
    """
    checked = checked or change_checks(df, value, order, refuse_zero)
    df = with_order_key(df, order)
    v = number(df, value)
    sort = _series_order(df, order)
    blocks = with_halo(add_positions(df, sort, checked["rows"]), 1, checked["rows"])
    result = blocks.withColumn("__prev", F.lag(v).over(Window.partitionBy("__block").orderBy("__pos"))).filter("__own")
    columns = [ref(c) for c in df.columns]
    change = v - F.col("__prev")
    growth = F.try_divide(change, F.col("__prev"))
    if not refuse_zero:
        signed = [F.when(change > 0, float("inf")), F.when(change < 0, float("-inf")), F.when(change == 0, float("nan"))]
        growth = F.when(F.col("__prev") == 0, F.coalesce(*signed)).otherwise(growth)
    return result.select(*columns, (growth * 100.0).alias("percent_change"), growth.alias("growth_rate"))


def _nulls_last(df: DataFrame, order: str) -> list[Column]:
    """Tie-break columns as (is missing, value) pairs, in the order used for sorting."""
    out = []
    for i, c in enumerate(x for x in df.columns if x != order):
        out += [ref(c).isNull().alias(f"n{i}"), ref(c).alias(f"t{i}")]
    return out


def last_rolling(df: DataFrame, order: str, group_by: Sequence[str]) -> DataFrame:
    """Per group, the last complete rolling mean and the number of complete windows."""
    complete = df.filter(F.col("rolling_mean").isNotNull())
    key = F.struct(present(df, order).isNull().alias("n"), present(df, order).alias("k"), *_nulls_last(df, order))
    return complete.groupBy(*[ref(c) for c in group_by]).agg(
        F.max_by("rolling_mean", key).alias("value"), F.count(F.lit(1)).alias("row_count")
    )
