"""Analytics plans: nine analyses, each giving a result table and named numeric facts.

The refusal counters of a grouped analysis ride along in the same aggregation as its metrics. The
aggregated table is materialised once, checked, and returned, so the input is scanned once; only
exact percentiles need a second pass, whose strategy the first pass chooses.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from auditframe.errors import RefusedError
from auditframe.functions.columns import (
    is_numeric, missing, number, present, ref, require_columns, require_numeric, require_unique_names,
    unsafe_number,
)
from auditframe.functions.identity import canonical_json, group_suffix
from auditframe.operators.counting import counting_pass
from auditframe.operators.filters import apply_filters
from auditframe.operators.quantiles import grouped_percentiles, join_on_keys, sketches
from auditframe.operators.windows import (
    change_checks, last_rolling, rank_checks, rank_rows, refuse_unsafe, rolling_checks, rolling_mean, series_change,
)
from auditframe.plans.specs import AnalyticsPlan, Metric
from auditframe.session import materialize

FACT_SCHEMA = (
    "key string, metric string, value double, label string, dataset string, calculation string, "
    "row_count long, grouping string, unit string"
)
FACT_COLUMNS = [part.split()[0] for part in FACT_SCHEMA.split(", ")]
MAX_RESULT_CELLS = 50_000
#: A query begins so, after comments and opening brackets; a last semicolon may have comments behind it.
SELECT_START = r"(?is)(?:\s|\(|--[^\n]*\n|/\*.*?\*/)*(?:select|with)\b"
LAST_SEMICOLON = r";\s*(?:--[^\n'\"]*\s*)*$"


@dataclass(frozen=True)
class AnalyticsResult:
    """``table`` is whole unless the plan sets a limit; ``facts`` come from the whole analysis."""

    table: DataFrame
    facts: DataFrame
    input_rows: int


def run_plan(df: DataFrame, plan: AnalyticsPlan, dataset: str = "dataset") -> AnalyticsResult:
    """Validate, filter and analyse."""
    require_unique_names(df)
    if plan.expected_columns and df.columns != plan.expected_columns:
        raise RefusedError("Dataset schema does not match the analytical plan; inspect the current columns first.")
    require_columns(df, plan.referenced_columns())
    rows = apply_filters(df, plan.filters)
    if plan.analysis in ("metrics", "group_compare"):
        result = _metrics(rows, plan, dataset)
    else:
        handler = {
            "distribution": _distribution,
            "correlation": _correlation,
            "rank": _rank,
            "rolling_mean": _rolling,
            "percent_change": _change,
            "growth_rate": _change,
            "target_variance": _target_variance,
        }[plan.analysis]
        result = handler(rows, plan, dataset)
    facts = materialize(result.facts)
    check_facts(facts)
    return replace(result, facts=facts)


def _top(table: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """The table in order, cut only where the plan asks for it."""
    ordered = table.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def refuse_large_result(table: DataFrame, max_cells: int = MAX_RESULT_CELLS) -> None:
    """Opt-in expectation for callers that bring a result to the driver."""
    allowed = max_cells // max(len(table.columns), 1)
    if table.limit(allowed + 1).count() > allowed:
        raise RefusedError("The analytical result exceeds the bounded result size.")


def check_facts(facts: DataFrame) -> None:
    """Refuse repeated fact identities and non-finite values, both found by one count per identity."""
    per_key = facts.groupBy("key").agg(
        F.count("value").alias("n"), F.count_if(F.isnan("value") | (F.abs("value") == float("inf"))).alias("bad")
    )
    found = per_key.agg(F.sum("bad").alias("bad"), F.min(F.when(F.col("n") > 1, F.col("key"))).alias("repeated")).first()
    if found["bad"]:
        raise RefusedError(f"{found['bad']} fact value(s) are not finite.")
    if found["repeated"] is not None:
        raise RefusedError(f"Analytical facts produced a duplicate identity '{found['repeated']}'.")


def _one_row(df: DataFrame) -> tuple[dict, DataFrame]:
    """Run a global aggregate once; hand the row back both as values and as a table."""
    row = df.first()
    return row.asDict(), df.sparkSession.createDataFrame([row], df.schema)


def _no_rows() -> RefusedError:
    return RefusedError("No rows remain after applying the requested filters.")


def _refuse_nulls(plan: AnalyticsPlan, nulls: int | None) -> None:
    if plan.nulls == "fail" and nulls:
        raise RefusedError("Missing values are present and the plan is configured to fail on nulls.")


def _fact(
    key: Column, metric: Column, value: Column, label: Column, dataset: str, calculation: Column, rows: Column,
    grouping: Column, unit: str | None = None,
) -> Column:
    return F.struct(
        key.alias("key"), metric.alias("metric"), value.cast("double").alias("value"), label.alias("label"),
        F.lit(dataset).alias("dataset"), calculation.alias("calculation"), rows.cast("long").alias("row_count"),
        grouping.alias("grouping"), F.lit(unit).cast("string").alias("unit"),
    )


def _facts(table: DataFrame, structs: list[Column]) -> DataFrame:
    return table.select(F.explode(F.array(*structs)).alias("f")).select(*[F.col(f"f.{c}").alias(c) for c in FACT_COLUMNS])


# ---- metrics ----------------------------------------------------------------------------------

_NEEDED_VALUES = {"sum": 1, "mean": 1, "median": 1, "min": 1, "max": 1, "variance": 2, "std": 2, "percentile": 1}


def _metric_column(df: DataFrame, metric: Metric) -> Column | None:
    """The aggregate of one metric; percentiles and distinct counts have passes of their own."""
    if metric.name == "count":
        return F.count(F.lit(1)).cast("double")
    if metric.name == "distinct_count":
        return None
    v = number(df, metric.column)
    return {
        "sum": F.sum(v), "mean": F.avg(v), "min": F.min(v), "max": F.max(v), "variance": F.var_samp(v),
        "std": F.stddev_samp(v),
    }.get(metric.name)


def _compare_metrics(plan: AnalyticsPlan) -> AnalyticsPlan:
    if plan.analysis != "group_compare":
        return plan
    metrics = [Metric("count"), Metric("mean", plan.value_column), Metric("sum", plan.value_column)]
    return replace(plan, analysis="metrics", metrics=metrics, value_column=None)


def _metrics(df: DataFrame, plan: AnalyticsPlan, dataset: str) -> AnalyticsResult:
    plan = _compare_metrics(plan)
    columns = plan.value_columns()
    for m in plan.metrics:
        if m.name not in ("count", "distinct_count"):
            require_numeric(df, m.column)
    keys = [present(df, k).alias(f"__k{i}") for i, k in enumerate(plan.group_by)]
    names = [f"__k{i}" for i in range(len(keys))]
    guarded = [c for c in columns if is_numeric(df, c)]
    aggregates = [F.count(F.lit(1)).alias("__rows")]
    aggregates += [F.count(present(df, c)).alias(f"__n{i}") for i, c in enumerate(columns)]
    aggregates += [F.count_if(unsafe_number(df, c)).alias(f"__bad{i}") for i, c in enumerate(guarded)]
    direct = [m for m in plan.metrics if _metric_column(df, m) is not None]
    aggregates += [_metric_column(df, m).alias(f"__m{plan.metrics.index(m)}") for m in direct]
    distinct = [m for m in plan.metrics if m.name == "distinct_count"]
    exact = [m for m in plan.metrics if m not in direct and m not in distinct]
    wanted = [(f"__m{plan.metrics.index(m)}", m.column, 50.0 if m.name == "median" else m.percentile) for m in exact]
    aggregates += sketches(df, wanted)
    first_pass = df.groupBy(*keys).agg(*aggregates)
    first_pass = materialize(first_pass) if keys else _one_row(first_pass)[1]

    check = first_pass.agg(
        F.coalesce(F.sum("__rows"), F.lit(0)).alias("rows"),
        *[F.sum(f"__bad{i}").alias(f"bad{i}") for i in range(len(guarded))],
        *[F.min(f"__n{i}").alias(f"n{i}") for i in range(len(columns))],
        *[F.sum(F.col("__rows") - F.col(f"__n{i}")).alias(f"nulls{i}") for i in range(len(columns))],
    ).first().asDict()
    if not check["rows"]:
        raise _no_rows()
    _refuse_nulls(plan, sum(check[f"nulls{i}"] or 0 for i in range(len(columns))))
    refuse_unsafe(guarded, check)
    for m in plan.metrics:
        needed = _NEEDED_VALUES.get(m.name, 0)
        if needed and check[f"n{columns.index(m.column)}"] < needed:
            raise RefusedError(f"{m.name} requires at least {needed} non-null numeric value(s) of '{m.column}' in every group.")

    table = first_pass
    if exact:
        keyed = df.select(*keys, *[ref(c) for c in dict.fromkeys(m.column for m in exact)])
        percentiles = grouped_percentiles(keyed, names, wanted, sketched=first_pass)
        table = join_on_keys(table, percentiles, names, "inner")
    if distinct:
        table = join_on_keys(table, _distinct_counts(df, plan, distinct, keys, names), names, "inner")
    if exact or distinct:
        table = materialize(table)
    table = table.select(
        *[F.col(n).alias(k) for n, k in zip(names, plan.group_by)],
        *[F.col(f"__m{i}").alias(m.output) for i, m in enumerate(plan.metrics)],
        F.col("__rows"),
    )
    grouping = canonical_json(table, plan.group_by) if keys else F.lit("{}")
    suffix = group_suffix(grouping) if keys else F.lit("")
    facts = _facts(
        table,
        [
            _fact(
                F.concat(F.lit(f"metric.{m.output}"), suffix), F.lit(m.name), ref(m.output), F.lit(m.output), dataset,
                F.lit(m.calculation), F.col("__rows"), grouping,
            )
            for m in plan.metrics
        ],
    )
    table = table.drop("__rows")
    if keys:
        sort = next((m.output for m in plan.metrics if m.name != "count"), plan.metrics[-1].output)
        by = ref(sort).asc_nulls_last() if plan.ascending else ref(sort).desc_nulls_last()
        table = _top(table, [by, *[ref(k).asc_nulls_last() for k in plan.group_by]], plan.limit)
    return AnalyticsResult(table, facts, check["rows"])


def _distinct_counts(df: DataFrame, plan: AnalyticsPlan, metrics: list[Metric], keys: list[Column], names: list[str]) -> DataFrame:
    """Distinct values per group, counted by digest: the other columns are not multiplied for it."""
    columns = list(dict.fromkeys(m.column for m in metrics))
    counts = counting_pass(df, columns, carried=False, keys=keys)
    found = {m: (F.col("c") == columns.index(m.column)) & F.col("d1").isNotNull() for m in metrics}
    return counts.groupBy(*names).agg(*[F.count_if(own).cast("double").alias(f"__m{plan.metrics.index(m)}") for m, own in found.items()])


# ---- whole-table analyses ---------------------------------------------------------------------


def _distribution(df: DataFrame, plan: AnalyticsPlan, dataset: str) -> AnalyticsResult:
    column = plan.value_column
    require_numeric(df, column)
    v = number(df, column)
    wanted = [("median", column, 50.0), ("p25", column, 25.0), ("p75", column, 75.0)]
    row, basics = _one_row(
        df.agg(
            *sketches(df, wanted),
            F.count(F.lit(1)).alias("rows"),
            F.count_if(unsafe_number(df, column)).alias("bad0"),
            F.count(v).cast("double").alias("count"),
            F.count_if(missing(df, column)).cast("double").alias("missing_count"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"),
        )
    )
    if not row["rows"]:
        raise _no_rows()
    refuse_unsafe([column], row)
    _refuse_nulls(plan, row["missing_count"])
    percentiles = grouped_percentiles(df, [], wanted, sketched=basics)
    names = ["count", "missing_count", "min", "max", "mean", "median", "std", "p25", "p75"]
    whole = join_on_keys(basics, percentiles, [], "inner")
    structs = [
        _fact(
            F.lit(f"distribution.{n}"), F.lit(n), F.col(n), F.lit(n), dataset, F.lit(f"distribution of {column}"),
            F.col("rows"), F.lit("{}"),
        )
        for n in names
    ]
    return AnalyticsResult(whole.select(*names), _facts(whole, structs).filter("value is not null"), row["rows"])


def _correlation(df: DataFrame, plan: AnalyticsPlan, dataset: str) -> AnalyticsResult:
    a, b = plan.value_column, plan.second_column
    require_numeric(df, a)
    require_numeric(df, b)
    both = number(df, a).isNotNull() & number(df, b).isNotNull()
    x, y = F.when(both, number(df, a)), F.when(both, number(df, b))
    row, moments = _one_row(
        df.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(unsafe_number(df, a)).alias("bad0"),
            F.count_if(unsafe_number(df, b)).alias("bad1"),
            F.count_if(both).alias("paired_rows"),
            F.stddev_samp(x).alias("sx"),
            F.stddev_samp(y).alias("sy"),
            F.covar_samp(x, y).alias("sxy"),
        )
    )
    if not row["rows"]:
        raise _no_rows()
    refuse_unsafe([a, b], row)
    _refuse_nulls(plan, row["rows"] - row["paired_rows"])
    if row["paired_rows"] < 2:
        raise RefusedError("Correlation requires at least two paired non-null numeric values.")
    if not row["sx"] or not row["sy"]:
        raise RefusedError("Correlation is undefined when a column has zero variance.")
    table = moments.select(
        F.lit(a).alias("x"), F.lit(b).alias("y"), (F.col("sxy") / (F.col("sx") * F.col("sy"))).alias("pearson"), "paired_rows"
    )
    fact = _fact(
        F.lit("correlation.pearson"), F.lit("correlation"), F.col("pearson"), F.lit("Pearson correlation"), dataset,
        F.lit(f"pearson({a}, {b})"), F.col("paired_rows"), F.lit("{}"),
    )
    return AnalyticsResult(table, _facts(table, [fact]), row["rows"])


def _refuse_empty(plan: AnalyticsPlan, checked: dict) -> int:
    if not checked["rows"]:
        raise _no_rows()
    _refuse_nulls(plan, checked["rows"] - checked["filled"])
    return checked["rows"]


def _rank(df: DataFrame, plan: AnalyticsPlan, dataset: str) -> AnalyticsResult:
    checked = rank_checks(df, plan.value_column)
    rows = _refuse_empty(plan, checked)
    ranked = rank_rows(df, plan.value_column, plan.rank_method, plan.ascending, checked)
    best = number(df, plan.value_column)
    top = df.agg((F.min(best) if plan.ascending else F.max(best)).alias("top"), F.count(F.lit(1)).alias("rows"))
    fact = _fact(
        F.lit("rank.top_value"), F.lit("rank"), F.col("top"), F.lit("top ranked value"), dataset,
        F.lit(f"rank({plan.value_column})"), F.col("rows"), F.lit("{}"),
    )
    order = [F.col("rank").asc_nulls_last(), *[ref(c).asc_nulls_last() for c in df.columns]]
    return AnalyticsResult(_top(ranked, [*order], plan.limit), _facts(top, [fact]), rows)


def _rolling(df: DataFrame, plan: AnalyticsPlan, dataset: str) -> AnalyticsResult:
    checked = rolling_checks(df, plan.value_column, plan.order_column)
    rows = _refuse_empty(plan, checked)
    rolled = rolling_mean(
        df, plan.value_column, plan.order_column, plan.window, plan.group_by, checked
    )
    last = materialize(last_rolling(rolled, plan.order_column, plan.group_by))
    summary = last.agg(F.count("value").alias("groups")).first()
    if not summary["groups"]:
        raise RefusedError("Rolling mean did not produce a complete window for any group.")
    grouping = canonical_json(last, plan.group_by) if plan.group_by else F.lit("{}")
    suffix = group_suffix(grouping) if plan.group_by else F.lit("")
    fact = _fact(
        F.concat(F.lit("rolling.mean.last"), suffix), F.lit("rolling_mean"), F.col("value"), F.lit("latest rolling mean"),
        dataset, F.lit(f"rolling_mean({plan.value_column}, window={plan.window})"), F.col("row_count"), grouping,
    )
    order = [ref(c).asc_nulls_last() for c in [*plan.group_by, plan.order_column, *rolled.columns]]
    return AnalyticsResult(_top(rolled, [*order], plan.limit), _facts(last, [fact]), rows)


def _change(df: DataFrame, plan: AnalyticsPlan, dataset: str) -> AnalyticsResult:
    checked = change_checks(df, plan.value_column, plan.order_column)
    rows = _refuse_empty(plan, checked)
    changed = series_change(df, plan.value_column, plan.order_column, checked)
    column = plan.analysis
    order = F.struct(present(changed, plan.order_column).isNull().alias("n"), present(changed, plan.order_column).alias("k"))
    complete = changed.filter(F.col(column).isNotNull())
    row, last = _one_row(complete.agg(F.max_by(column, order).alias("value"), F.count(F.lit(1)).alias("row_count")))
    if not row["row_count"]:
        raise RefusedError("Percent change requires at least two consecutive non-null ordered values.")
    fact = _fact(
        F.lit(f"{column}.last"), F.lit(column), F.col("value"), F.lit(f"latest {column.replace('_', ' ')}"), dataset,
        F.lit(f"{column}({plan.value_column}) ordered by {plan.order_column}"), F.col("row_count"), F.lit("{}"),
        "percent" if column == "percent_change" else "ratio",
    )
    by = [ref(c).asc_nulls_last() for c in [plan.order_column, *df.columns]]
    return AnalyticsResult(_top(changed, [*by], plan.limit), _facts(last, [fact]), rows)


# ---- targets ----------------------------------------------------------------------------------


def _target_variance(df: DataFrame, plan: AnalyticsPlan, dataset: str) -> AnalyticsResult:
    """Actual against target per group; the worst group and its largest contributor as facts."""
    value, target = plan.value_column, plan.second_column
    require_numeric(df, value)
    if not is_numeric(df, target):
        raise RefusedError("Target values must be numeric.")
    v, t = number(df, value), number(df, target)
    keys = [present(df, k).alias(k) for k in plan.group_by]
    counters = {
        "actual": (F.sum(v), F.sum), "target": (F.max(t), F.max), "row_count": (F.count(F.lit(1)), F.sum), "__values": (F.count(v), F.sum),
        "__low": (F.min(t), F.min), "__nulls": (F.count_if(missing(df, value) | missing(df, target)), F.sum),
        "__bad0": (F.count_if(unsafe_number(df, value)), F.sum), "__bad1": (F.count_if(unsafe_number(df, target)), F.sum),
    }
    first = [aggregate.alias(name) for name, (aggregate, _) in counters.items()]
    if plan.contributor_column:
        # Sums per group and contributor first, then per group: one scan serves both, and the top contributor is a bounded fold.
        inner = df.groupBy(*keys, present(df, plan.contributor_column).cast("string").alias("__contributor")).agg(*first)
        best_first = F.struct(F.col("actual").isNull(), -F.col("actual"), F.col("__contributor").isNull(), "__contributor")
        top = F.min_by(F.struct(F.col("__contributor").alias("contributor"), F.col("actual").alias("value")), best_first).alias("__top")
        grouped = inner.groupBy(*[ref(k) for k in plan.group_by]).agg(*[again(name).alias(name) for name, (_, again) in counters.items()], top)
    else:
        grouped = df.groupBy(*keys).agg(*first)
    whole = materialize(grouped)
    check = whole.agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows"),
        F.sum("__bad0").alias("bad0"),
        F.sum("__bad1").alias("bad1"),
        F.sum("__nulls").alias("nulls"),
        F.min("__values").alias("values"),
        F.count_if(F.col("target").isNull()).alias("without"),
        F.count_if(F.col("target") != F.col("__low")).alias("conflicting"),
    ).first().asDict()
    if not check["rows"]:
        raise _no_rows()
    _refuse_nulls(plan, check["nulls"])
    refuse_unsafe([value, target], check)
    if not check["values"]:
        raise RefusedError("The selected numeric column has no non-null values in a group.")
    if check["without"]:
        raise RefusedError("Each group must have a target value.")
    if check["conflicting"]:
        raise RefusedError("Target values are not unique within a group.")
    table = whole.select(
        *[ref(k) for k in plan.group_by],
        "actual",
        "target",
        (F.col("actual") - F.col("target")).alias("variance"),
        F.greatest(F.col("target") - F.col("actual"), F.lit(0.0)).alias("shortfall"),
        F.col("row_count").cast("double").alias("row_count"),
        *([F.col("__top")] if plan.contributor_column else []),
    )
    order = [F.col("shortfall").desc(), *[ref(k).asc_nulls_last() for k in plan.group_by]]
    worst = table.orderBy(*order).limit(1)
    grouping = canonical_json(worst, plan.group_by)
    by = ", ".join(plan.group_by)
    facts = _facts(
        worst,
        [
            _fact(
                F.lit(f"target.worst_region_{name}"), F.lit(metric), F.col(name), F.lit(label), dataset, F.lit(how),
                F.col("row_count"), grouping,
            )
            for name, metric, label, how in (
                ("shortfall", "shortfall", "largest shortfall", f"max(target - sum({value}), 0) grouped by {by}"),
                ("actual", "sum", "actual at largest shortfall", f"sum({value})"),
                ("target", "target", "target at largest shortfall", target),
            )
        ],
    )
    if plan.contributor_column:
        facts = facts.unionByName(_top_contributor(plan, worst, dataset))
    return AnalyticsResult(_top(table.drop("__top"), [*order], plan.limit), facts, check["rows"])


def _top_contributor(plan: AnalyticsPlan, worst: DataFrame, dataset: str) -> DataFrame:
    placed = worst.select(*[ref(k) for k in plan.group_by], "row_count", F.coalesce("__top.contributor", F.lit("nan")).alias(plan.contributor_column), F.col("__top.value").alias("__value"))
    fact = _fact(
        F.lit("target.top_contributor"), F.lit("sum"), F.col("__value"), ref(plan.contributor_column), dataset,
        F.lit(f"sum({plan.value_column}) by {plan.contributor_column} within the largest shortfall group"),
        F.col("row_count"), canonical_json(placed, [*plan.group_by, plan.contributor_column]),
    )
    return _facts(placed, [fact])


def select_facts(spark, select_sql: str, dataset: str = "sql", max_rows: int | None = None) -> DataFrame:
    """Facts of one read-only SELECT: its row count, and every number when it returns one row.

    Spark's own parser runs the text; anything but a query is refused before it runs, and a
    result beyond ``max_rows`` after.
    """
    if not re.match(SELECT_START, select_sql):
        raise RefusedError("Only a single read-only SELECT is accepted.")
    # The line break closes a trailing comment, so that the bracket stays outside of it.
    bounded = spark.sql(f"SELECT * FROM ({re.sub(LAST_SEMICOLON, '', select_sql)}\n) AS bounded_source")
    values = F.struct(*[F.col(f"c{i}") for i in range(len(bounded.columns))])
    seen = bounded.toDF(*[f"c{i}" for i in range(len(bounded.columns))]).agg(F.count(F.lit(1)).alias("n"), F.any_value(values).alias("row")).first()
    count = seen["n"]
    if max_rows is not None and count > max_rows:
        raise RefusedError(f"Datasets may contain at most {max_rows} rows.")
    facts = [("metric.count", "count", float(count), "count", dataset, "count", count, "{}", None)]
    if count == 1:
        for field, value in zip(bounded.schema.fields, seen["row"]):
            name = field.name
            if isinstance(field.dataType, NumericType) and value is not None:
                facts.append((f"sql.{name}", "sql_value", float(value), name, dataset, "validated read-only SELECT", 1, "{}", None))
    return spark.createDataFrame(facts, FACT_SCHEMA)
