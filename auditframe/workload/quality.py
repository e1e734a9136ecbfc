"""Inspection, profiling and category snapshots of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditframe.operators.profile import (
    category_snapshot, inspect_columns, inspect_dataset, profile_categorical, profile_numeric,
)
from auditframe.workload.metrics import rounded
from auditframe.workload.registry import query, table

_CUSTOMERS = """
    SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance
    FROM customer
"""


def _customers(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "c_custkey", "nullif(c_mktsegment, 'BUILDING') AS segment", "CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance"
    )


def _inspect_sql(source, columns):
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS data_type, count(*) AS row_count, "
        f"count(*) - count({c}) AS missing_count, round((count(*) - count({c})) * 100.0 / count(*), 1) AS missing_percentage FROM ({source})"
        for i, (c, t) in enumerate(columns)
    )


@query(_inspect_sql(_CUSTOMERS, [("c_custkey", "bigint"), ("segment", "string"), ("balance", "double")]))
def inspect_columns_customer(spark, sf):
    return inspect_columns(_customers(spark, sf)).withColumn("missing_percentage", F.round("missing_percentage", 1))


@query(
    """
    SELECT sum(n)::BIGINT AS row_count, 11::BIGINT AS column_count, sum(n - 1)::BIGINT AS duplicate_row_count
    FROM (SELECT *, count(*) AS n FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem) GROUP BY ALL)
    """
)
def inspect_dataset_lineitem(spark, sf):
    """All columns of lineitem delivered twice, so that every row has a copy."""
    lines = table(spark, sf, "lineitem")
    return inspect_dataset(lines.unionByName(lines))


def _numeric_sql(source, columns):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS value_count, count(*) - count({c}) AS missing_count, "
        f"round(avg({c}), 6) AS mean, CAST(min({c}) AS DOUBLE) AS minimum, CAST(max({c}) AS DOUBLE) AS maximum, "
        f"round(quantile_cont({c}, 0.5), 6) AS median FROM ({source})"
        for c in columns
    )


_LINES = "SELECT * REPLACE (nullif(l_discount, 0) AS l_discount) FROM lineitem"
_NUMERIC = _numeric_sql(
    _LINES, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
)


def _lines(spark, sf):
    return table(spark, sf, "lineitem").withColumn("l_discount", F.expr("nullif(l_discount, 0)"))


@query(_NUMERIC)
def profile_numeric_lineitem(spark, sf):
    return rounded(profile_numeric(_lines(spark, sf)))


def _categorical_sql(source, columns):
    union = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM ({source})" for c in columns)
    return f"""
    WITH long AS ({union}),
         counted AS (SELECT column_name, value, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY ALL),
         totals AS (SELECT column_name, count(value) AS value_count, count(*) - count(value) AS missing_count,
                           count(DISTINCT value) AS unique_count FROM long GROUP BY column_name),
         ranked AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank FROM counted)
    SELECT t.column_name, value_count, missing_count, unique_count, CAST(rank AS INTEGER) AS rank, value, n AS frequency
    FROM totals t LEFT JOIN ranked r ON t.column_name = r.column_name AND rank <= 5
    """


@query(
    _categorical_sql(
        "SELECT nullif(o_orderstatus, 'P') AS status, o_orderpriority, o_orderdate FROM orders", ["status", "o_orderpriority", "o_orderdate"]
    )
)
def profile_categorical_orders(spark, sf):
    orders = table(spark, sf, "orders").withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')"))
    return profile_categorical(orders.withColumnRenamed("o_orderstatus", "status"))


def _snapshot_sql(source, columns):
    union = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value FROM ({source})" for c in columns)
    return f"""
    WITH long AS ({union}),
         s AS (SELECT column_name, count(DISTINCT value) AS u, max(length(value)) AS longest, list(DISTINCT value ORDER BY value) AS v
               FROM long WHERE value IS NOT NULL GROUP BY column_name)
    SELECT column_name, u AS unique_count, u <= 100 AND longest <= 200 AS values_complete,
           CASE WHEN u <= 100 AND longest <= 200 THEN array_to_string(v, '|') ELSE '' END AS category_values
    FROM s
    """


@query(_snapshot_sql("SELECT lang, source, text FROM documents", ["lang", "source", "text"]))
def category_snapshot_documents(spark, sf):
    snapshot = category_snapshot(table(spark, sf, "documents"))
    return snapshot.withColumn("category_values", F.array_join("category_values", "|"))
