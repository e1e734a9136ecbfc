"""Audited joins on whole tables. Supplier nations include missing keys on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditframe.operators.joins import join_diagnostics, join_frames, join_sources, match_counts, one_to_one_outer
from auditframe.plans.specs import JoinRule, JoinSpec
from auditframe.workload.registry import query, table

# Suppliers in debt have no nation; NATION_7 has no key; suppliers above 9000 only, so that some
# nations stay without one.
_LEFT = "SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN s_nationkey END AS nation, s_name AS name FROM supplier"
_RIGHT = "SELECT nullif(n_nationkey, 7) AS nation, n_name AS name, n_regionkey FROM nation"


def _suppliers(spark, sf):
    return table(spark, sf, "supplier").selectExpr(
        "s_suppkey", "CASE WHEN s_acctbal >= 0 THEN s_nationkey END AS nation", "s_name AS name"
    )


def _nations(spark, sf):
    return table(spark, sf, "nation").selectExpr("nullif(n_nationkey, 7) AS nation", "n_name AS name", "n_regionkey")


def _join_sql(kind):
    return f"""
    SELECT CASE WHEN l.s_suppkey IS NULL THEN r.nation ELSE l.nation END AS nation, l.s_suppkey, l.name AS name_left,
           r.name AS name_right, r.n_regionkey
    FROM ({_LEFT}) l {kind} JOIN ({_RIGHT}) r ON l.nation IS NOT DISTINCT FROM r.nation
    """


def _joined(spark, sf, how):
    return join_frames(_suppliers(spark, sf), _nations(spark, sf), JoinSpec(["nation"], ["nation"], how))


@query(_join_sql("INNER"))
def join_inner(spark, sf):
    return _joined(spark, sf, "inner")


@query(_join_sql("LEFT"))
def join_left(spark, sf):
    return _joined(spark, sf, "left")


@query(_join_sql("RIGHT"))
def join_right(spark, sf):
    return _joined(spark, sf, "right")


@query(_join_sql("FULL"))
def join_outer(spark, sf):
    return _joined(spark, sf, "outer")


def _diagnostics_sql(left, right, keys, kind, left_keys, right_keys):
    extra = {"inner": "0", "left": "lu", "right": "ru", "outer": "lu + ru"}[kind]
    return f"""
    WITH l AS (SELECT {keys[0]} AS k, count(*) AS n FROM {left} GROUP BY ALL),
         r AS (SELECT {keys[1]} AS k, count(*) AS n FROM {right} GROUP BY ALL),
         c AS (SELECT coalesce(l.n, 0) AS ln, coalesce(r.n, 0) AS rn FROM l FULL JOIN r ON l.k IS NOT DISTINCT FROM r.k),
         s AS (SELECT sum(ln)::BIGINT AS li, sum(rn)::BIGINT AS ri, sum(ln * rn)::BIGINT AS m,
                      sum(CASE WHEN rn = 0 THEN ln ELSE 0 END)::BIGINT AS lu,
                      sum(CASE WHEN ln = 0 THEN rn ELSE 0 END)::BIGINT AS ru, bool_or(ln > 1 AND rn > 1) AS mm FROM c)
    SELECT li AS left_input_rows, ri AS right_input_rows, m + {extra} AS output_rows, m AS matched_output_rows,
           lu AS left_unmatched_rows, ru AS right_unmatched_rows, '{left_keys}' AS left_keys, '{right_keys}' AS right_keys,
           '{kind}' AS join_type, (m > li - lu OR m > ri - ru) AS row_multiplication_occurred, mm AS many_to_many_detected,
           CASE WHEN mm THEN 'Many-to-many join keys produced suspicious row multiplication.'
                WHEN m > li - lu OR m > ri - ru THEN 'Repeated join keys caused output row multiplication.' END AS warning
    FROM s
    """


@query(_diagnostics_sql("orders", "lineitem", ("o_orderkey", "l_orderkey"), "left", "o_orderkey", "l_orderkey"))
def join_diagnostics_one_to_many(spark, sf):
    return join_diagnostics(
        table(spark, sf, "orders"), table(spark, sf, "lineitem"), JoinSpec(["o_orderkey"], ["l_orderkey"], "left")
    )


@query(_diagnostics_sql("events", "orders", ("user_id", "o_custkey"), "outer", "user_id", "o_custkey"))
def join_diagnostics_many_to_many(spark, sf):
    return join_diagnostics(table(spark, sf, "events"), table(spark, sf, "orders"), JoinSpec(["user_id"], ["o_custkey"], "outer"))


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name, s_name
    FROM lineitem LEFT JOIN part ON l_partkey = CASE WHEN p_type = 'PROMO' THEN -1 - p_partkey ELSE p_partkey END
                  LEFT JOIN supplier ON l_suppkey = CASE WHEN s_acctbal > 0 THEN s_suppkey ELSE -1 - s_suppkey END
    """
)
def join_chain_by_role(spark, sf):
    """Two lookups after one another; promoted parts and makers in debt carry keys that no line names."""
    sources = {
        "lines": table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        "parts": table(spark, sf, "part").selectExpr("CASE WHEN p_type = 'PROMO' THEN -1 - p_partkey ELSE p_partkey END AS p_partkey", "p_name"),
        "makers": table(spark, sf, "supplier").selectExpr("CASE WHEN s_acctbal > 0 THEN s_suppkey ELSE -1 - s_suppkey END AS s_suppkey", "s_name"),
    }
    rules = [
        JoinRule("parts", ["l_partkey"], ["p_partkey"], block_row_multiplication=False, max_unmatched_left_percentage=60.0),
        JoinRule("makers", ["lines.l_suppkey"], ["s_suppkey"], block_row_multiplication=False),
    ]
    merged, _ = join_sources(sources, list(sources), rules)
    names = ["lines.l_orderkey", "lines.l_linenumber", "lines.l_partkey", "lines.l_suppkey", "parts.p_name", "makers.s_name"]
    return merged.select(*[F.col(f"`{n}`").alias(n.split(".")[1]) for n in names])


_MATCH = """
    (SELECT o_custkey AS custkey, count(*) AS n FROM orders GROUP BY o_custkey) a
    FULL JOIN (SELECT CASE WHEN c_acctbal > 0 THEN c_custkey ELSE -1 - c_custkey END AS custkey, c_acctbal FROM customer) b
    ON a.custkey = b.custkey
"""


@query(
    f"""
    SELECT CASE WHEN a.custkey IS NULL THEN b.custkey ELSE a.custkey END AS custkey, n, c_acctbal,
           CASE WHEN b.custkey IS NULL THEN 'left_only' WHEN a.custkey IS NULL THEN 'right_only' ELSE 'matched' END AS match_state
    FROM {_MATCH}
    """
)
def join_one_to_one_outer(spark, sf):
    """Customers with their orders; customers in debt carry keys that no order names."""
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count(F.lit(1)).alias("n"))
    customers = table(spark, sf, "customer").selectExpr("CASE WHEN c_acctbal > 0 THEN c_custkey ELSE -1 - c_custkey END AS custkey", "c_acctbal")
    return one_to_one_outer(orders, customers, "custkey")


@query(
    f"""
    SELECT count(*) FILTER (a.custkey IS NOT NULL AND b.custkey IS NOT NULL) AS matched,
           count(*) FILTER (b.custkey IS NULL) AS left_only, count(*) FILTER (a.custkey IS NULL) AS right_only
    FROM {_MATCH}
    """
)
def join_match_counts(spark, sf):
    return match_counts(join_one_to_one_outer(spark, sf))
