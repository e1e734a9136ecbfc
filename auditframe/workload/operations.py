"""Projections, filters, missing data, duplicates, sorting and grouping on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditframe.operators.transforms import apply_operations
from auditframe.operators.profile import candidate_keys, duplicate_rows, uniqueness_violations
from auditframe.plans.specs import JoinSpec, operation
from auditframe.plans.workflow import join_workflow
from auditframe.workload.registry import query, table


def _operations(*payloads):
    return [operation(p) for p in payloads]


def _run(df, *payloads):
    return apply_operations(df, _operations(*payloads))


def _priced(spark, sf):
    """Line items whose zero discounts count as missing."""
    return table(spark, sf, "lineitem").withColumn("l_discount", F.expr("nullif(l_discount, 0)"))


PRICED = "SELECT * REPLACE (nullif(l_discount, 0) AS l_discount) FROM lineitem"


@query(
    "SELECT p_brand AS brand, p_name, p_retailprice AS price FROM part"
)
def select_rename_sort(spark, sf):
    return _run(
        table(spark, sf, "part"),
        {"type": "select", "columns": ["p_brand", "p_name", "p_retailprice"]},
        {"type": "rename", "mapping": {"p_brand": "brand", "p_retailprice": "price"}},
        {"type": "sort", "keys": [{"column": "price", "ascending": False}, {"column": "brand"}]},
    )


@query(
    """
    SELECT l_orderkey, l_linenumber, l_quantity + l_linenumber AS added, l_extendedprice - l_tax AS reduced,
           l_extendedprice * l_quantity AS multiplied, l_extendedprice * 1.5 AS scaled
    FROM lineitem
    """
)
def derive_add_subtract_multiply(spark, sf):
    return _run(
        table(spark, sf, "lineitem"),
        {"type": "derive", "new_column": "added", "left_column": "l_quantity", "operator": "add", "right_column": "l_linenumber"},
        {"type": "derive", "new_column": "reduced", "left_column": "l_extendedprice", "operator": "subtract", "right_column": "l_tax"},
        {"type": "derive", "new_column": "multiplied", "left_column": "l_extendedprice", "operator": "multiply", "right_column": "l_quantity"},
        {"type": "derive", "new_column": "scaled", "left_column": "l_extendedprice", "operator": "multiply", "constant": 1.5},
        {"type": "select", "columns": ["l_orderkey", "l_linenumber", "added", "reduced", "multiplied", "scaled"]},
    )


@query(
    """
    SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit_price, l_tax / l_quantity AS tax_ratio,
           l_linenumber / l_quantity * 100 AS line_percentage, l_extendedprice / 8.0 AS eighth
    FROM lineitem
    """
)
def derive_divide_ratio_percentage(spark, sf):
    return _run(
        table(spark, sf, "lineitem"),
        {"type": "derive", "new_column": "unit_price", "left_column": "l_extendedprice", "operator": "divide", "right_column": "l_quantity"},
        {"type": "derive", "new_column": "tax_ratio", "left_column": "l_tax", "operator": "ratio", "right_column": "l_quantity"},
        {"type": "derive", "new_column": "line_percentage", "left_column": "l_linenumber", "operator": "percentage", "right_column": "l_quantity"},
        {"type": "derive", "new_column": "eighth", "left_column": "l_extendedprice", "operator": "divide", "constant": 8.0},
        {"type": "select", "columns": ["l_orderkey", "l_linenumber", "unit_price", "tax_ratio", "line_percentage", "eighth"]},
    )


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'")
def filter_eq(spark, sf):
    return _run(
        table(spark, sf, "orders"),
        {"type": "filter", "column": "o_orderpriority", "operator": "eq", "value": "1-URGENT"},
        {"type": "select", "columns": ["o_orderkey", "o_totalprice"]},
    )


@query(
    f"SELECT l_orderkey, l_partkey, l_discount FROM ({PRICED}) WHERE l_discount IS DISTINCT FROM 0.05"
)
def filter_ne_keeps_missing(spark, sf):
    return _run(
        _priced(spark, sf),
        {"type": "filter", "column": "l_discount", "operator": "ne", "value": 0.05},
        {"type": "select", "columns": ["l_orderkey", "l_partkey", "l_discount"]},
    )


@query(
    f"""
    SELECT l_orderkey, l_quantity, l_discount FROM ({PRICED})
    WHERE l_quantity > 10 AND l_quantity <= 40 AND l_discount >= 0.02 AND l_linenumber < 5
    """
)
def filter_ranges(spark, sf):
    return _run(
        _priced(spark, sf),
        {"type": "filter", "column": "l_quantity", "operator": "gt", "value": 10},
        {"type": "filter", "column": "l_quantity", "operator": "lte", "value": 40},
        {"type": "filter", "column": "l_discount", "operator": "gte", "value": 0.02},
        {"type": "filter", "column": "l_linenumber", "operator": "lt", "value": 5},
        {"type": "select", "columns": ["l_orderkey", "l_quantity", "l_discount"]},
    )


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'red')")
def filter_contains(spark, sf):
    return _run(
        table(spark, sf, "part"),
        {"type": "filter", "column": "p_name", "operator": "contains", "value": "red"},
        {"type": "select", "columns": ["p_partkey", "p_name"]},
    )


@query(
    f"SELECT l_orderkey, l_partkey, l_discount FROM ({PRICED}) WHERE l_discount IN (0.01, 0.1) OR l_discount IS NULL"
)
def filter_in_with_missing(spark, sf):
    return _run(
        _priced(spark, sf),
        {"type": "filter", "column": "l_discount", "operator": "in", "value": [0.01, 0.1, None]},
        {"type": "select", "columns": ["l_orderkey", "l_partkey", "l_discount"]},
    )


@query(
    f"""
    SELECT 'missing' AS state, count(*) AS n, sum(l_quantity) AS quantity FROM ({PRICED}) WHERE l_discount IS NULL
    UNION ALL
    SELECT 'present', count(*), sum(l_quantity) FROM ({PRICED}) WHERE l_discount IS NOT NULL
    """
)
def filter_null_tests(spark, sf):
    lines = _priced(spark, sf)

    def part(operator, state):
        kept = _run(lines, {"type": "filter", "column": "l_discount", "operator": operator})
        return kept.agg(F.lit(state).alias("state"), F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))

    return part("is_null", "missing").unionByName(part("not_null", "present"))


@query(
    f"SELECT l_orderkey, l_linenumber, l_discount FROM ({PRICED}) WHERE l_discount IS NOT NULL"
)
def missing_drop(spark, sf):
    return _run(
        _priced(spark, sf),
        {"type": "missing", "action": "drop"},
        {"type": "select", "columns": ["l_orderkey", "l_linenumber", "l_discount"]},
    )


@query(
    f"SELECT l_orderkey, l_linenumber, coalesce(l_discount, 0.5) AS l_discount FROM ({PRICED})"
)
def missing_fill(spark, sf):
    return _run(
        _priced(spark, sf),
        {"type": "missing", "action": "fill", "columns": ["l_discount"], "value": 0.5},
        {"type": "select", "columns": ["l_orderkey", "l_linenumber", "l_discount"]},
    )


_DEDUPE_ORDER = (
    "l_shipdate {d}, l_partkey {d}, l_suppkey {d}, l_quantity {d}, l_extendedprice {d}, l_discount {d}, l_tax {d}, "
    "l_returnflag {d}, l_linestatus {d}"
)
_DEDUPE_SQL = """
    SELECT * FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) = 1
"""


@query(_DEDUPE_SQL.format(order=_DEDUPE_ORDER.format(d="ASC")))
def dedupe_keep_first(spark, sf):
    return _run(
        table(spark, sf, "lineitem"),
        {"type": "drop_duplicates", "columns": ["l_orderkey", "l_linenumber"], "order_by": ["l_shipdate"]},
    )


@query(_DEDUPE_SQL.format(order=_DEDUPE_ORDER.format(d="DESC")))
def dedupe_keep_last(spark, sf):
    return _run(
        table(spark, sf, "lineitem"),
        {"type": "drop_duplicates", "columns": ["l_orderkey", "l_linenumber"], "keep": "last", "order_by": ["l_shipdate"]},
    )


@query("SELECT DISTINCT lang, text FROM documents")
def distinct_rows(spark, sf):
    return _run(
        table(spark, sf, "documents"),
        {"type": "select", "columns": ["lang", "text"]},
        {"type": "drop_duplicates"},
    )


@query(
    "SELECT sum(n)::BIGINT AS row_count, sum(n - 1)::BIGINT AS duplicate_row_count "
    "FROM (SELECT count(*) AS n FROM documents GROUP BY lang, text)"
)
def duplicate_row_count(spark, sf):
    return duplicate_rows(table(spark, sf, "documents").select("lang", "text"))


@query(
    """
    SELECT 'lineitem.l_orderkey' AS field, sum(n)::BIGINT AS violating_rows
    FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) WHERE n > 1
    UNION ALL
    SELECT 'orders.o_orderkey', coalesce(sum(n), 0)::BIGINT
    FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey) WHERE n > 1
    """
)
def uniqueness_check(spark, sf):
    lines = uniqueness_violations(table(spark, sf, "lineitem"), "l_orderkey")
    orders = uniqueness_violations(table(spark, sf, "orders"), "o_orderkey")
    return lines.select(F.lit("lineitem.l_orderkey").alias("field"), "violating_rows").unionByName(
        orders.select(F.lit("orders.o_orderkey").alias("field"), "violating_rows")
    )


def _key_sql(name, columns):
    parts = [
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count, "
        f"count(DISTINCT {c}) = count(*) AND count({c}) = count(*) AS is_candidate_key FROM {name}"
        for c in columns
    ]
    return " UNION ALL ".join(parts)


@query(_key_sql("part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]))
def candidate_key_columns(spark, sf):
    return candidate_keys(table(spark, sf, "part"))


@query(
    f"""
    SELECT l_returnflag, l_linestatus, count(l_discount) AS l_discount_count, coalesce(sum(l_discount_only), 0) AS zero_sum,
           avg(l_quantity) AS l_quantity_mean, quantile_cont(l_extendedprice, 0.5) AS l_extendedprice_median,
           min(l_shipdate) AS l_shipdate_min, max(l_linenumber) AS l_linenumber_max
    FROM (SELECT *, CAST(NULL AS DOUBLE) AS l_discount_only FROM ({PRICED}))
    GROUP BY l_returnflag, l_linestatus
    """
)
def group_aggregate_all(spark, sf):
    lines = _priced(spark, sf).withColumn("l_discount_only", F.lit(None).cast("double"))
    return _run(
        lines,
        {
            "type": "group",
            "group_by": ["l_returnflag", "l_linestatus"],
            "aggregations": [
                {"column": "l_discount", "function": "count"},
                {"column": "l_discount_only", "function": "sum", "alias": "zero_sum"},
                {"column": "l_quantity", "function": "mean"},
                {"column": "l_extendedprice", "function": "median"},
                {"column": "l_shipdate", "function": "min"},
                {"column": "l_linenumber", "function": "max"},
            ],
        },
    )


@query(
    """
    SELECT segment, count(*) AS orders, round(sum(net), 4) AS net, round(sum(net) / count(*) * 100, 4) AS net_per_100
    FROM (SELECT nullif(c_mktsegment, 'BUILDING') AS segment, o_totalprice - 10 AS net
          FROM orders JOIN customer ON o_custkey = c_custkey)
    GROUP BY segment
    """
)
def join_group_derive_chain(spark, sf):
    customers = table(spark, sf, "customer").withColumn("segment", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    grouped = join_workflow(
        table(spark, sf, "orders"),
        customers,
        JoinSpec(["o_custkey"], ["c_custkey"]),
        left_operations=_operations({"type": "select", "columns": ["o_orderkey", "o_custkey", "o_totalprice"]}),
        right_operations=_operations({"type": "select", "columns": ["c_custkey", "segment"]}),
        operations=_operations(
            {"type": "derive", "new_column": "net_order", "left_column": "o_totalprice", "operator": "subtract", "constant": 10.0},
            {
                "type": "group",
                "group_by": ["segment"],
                "aggregations": [
                    {"column": "o_orderkey", "function": "count", "alias": "orders"},
                    {"column": "net_order", "function": "sum", "alias": "net"},
                ],
            },
            {"type": "derive", "new_column": "net_per_100", "left_column": "net", "operator": "percentage", "right_column": "orders"},
        ),
    ).frame
    return grouped.select("segment", "orders", F.round("net", 4).alias("net"), F.round("net_per_100", 4).alias("net_per_100"))
