"""Analytics plans on whole tables: metrics, facts, distribution, correlation and targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditframe.operators.joins import join_frames, lookup
from auditframe.plans.analytics import FACT_COLUMNS, run_plan, select_facts
from auditframe.plans.specs import AnalyticsPlan, JoinSpec, Metric, PlanFilter
from auditframe.workload.registry import query, table

_LINES = "SELECT *, nullif(l_linestatus, 'O') AS status FROM lineitem"


def _lines(spark, sf):
    return table(spark, sf, "lineitem").withColumn("status", F.expr("nullif(l_linestatus, 'O')"))


def rounded(df, digits=6, skip=()):
    """Doubles rounded, everything else untouched."""
    return df.select(
        *[
            F.round(f"`{f.name}`", digits).alias(f.name)
            if f.dataType.typeName() == "double" and f.name not in skip
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


# ---- targets ----------------------------------------------------------------------------------

_REGION_OF = """
    SELECT o_orderkey, o_totalprice, r_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""
_ACTUALS = f"""
    region_of AS ({_REGION_OF}),
    targets AS (SELECT r_name, sum(o_totalprice) * 0.6 AS target FROM region_of GROUP BY r_name),
    sales AS (SELECT r_name, n_name, l_extendedprice * (1 - l_discount) AS net_sales
              FROM lineitem JOIN region_of ON l_orderkey = o_orderkey),
    variance AS (SELECT s.r_name, actual, target, n FROM (SELECT r_name, sum(net_sales) AS actual, count(*) AS n FROM sales
                 GROUP BY r_name) s JOIN targets t ON s.r_name = t.r_name)
"""


def regional_sales(spark, sf):
    """Net line sales with region, nation and the region's target."""
    places = join_frames(
        table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"),
        table(spark, sf, "region").select("r_regionkey", "r_name"),
        JoinSpec(["n_regionkey"], ["r_regionkey"]),
    )
    customers = join_frames(
        table(spark, sf, "customer").select("c_custkey", "c_nationkey"), places, JoinSpec(["c_nationkey"], ["n_nationkey"])
    ).select("c_custkey", "n_name", "r_name")
    orders = join_frames(
        table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), customers, JoinSpec(["o_custkey"], ["c_custkey"])
    )
    targets = orders.groupBy("r_name").agg((F.sum("o_totalprice") * 0.6).alias("target"))
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_sales")
    )
    sales = join_frames(lines, orders.select("o_orderkey", "n_name", "r_name"), JoinSpec(["l_orderkey"], ["o_orderkey"]))
    return lookup(sales, targets, JoinSpec(["r_name"], ["r_name"])).select("r_name", "n_name", "net_sales", "target")


_TARGET_PLAN = AnalyticsPlan(
    "target_variance", group_by=["r_name"], value_column="net_sales", second_column="target", contributor_column="n_name"
)


@query(
    f"""
    WITH {_ACTUALS}
    SELECT r_name, round(actual, 4) AS actual, round(target, 4) AS target, round(actual - target, 4) AS variance,
           round(greatest(target - actual, 0), 4) AS shortfall, CAST(n AS DOUBLE) AS row_count
    FROM variance
    """
)
def flagship_target_variance(spark, sf):
    return rounded(run_plan(regional_sales(spark, sf), _TARGET_PLAN, "sales").table, 4)


@query(
    f"""
    WITH {_ACTUALS},
    worst AS (SELECT * FROM variance ORDER BY greatest(target - actual, 0) DESC, r_name LIMIT 1),
    tops AS (SELECT n_name, sum(net_sales) AS v, count(*) AS n FROM sales WHERE r_name = (SELECT r_name FROM worst) GROUP BY n_name)
    SELECT 'target.worst_region_shortfall' AS key, 'largest shortfall' AS label, round(greatest(target - actual, 0), 4) AS value,
           n AS row_count FROM worst
    UNION ALL SELECT 'target.worst_region_actual', 'actual at largest shortfall', round(actual, 4), n FROM worst
    UNION ALL SELECT 'target.worst_region_target', 'target at largest shortfall', round(target, 4), n FROM worst
    UNION ALL (SELECT 'target.top_contributor', n_name, round(v, 4), (SELECT n FROM worst) FROM tops ORDER BY v DESC, n_name LIMIT 1)
    """
)
def target_facts_with_contributor(spark, sf):
    facts = run_plan(regional_sales(spark, sf), _TARGET_PLAN, "sales").facts
    return rounded(facts.select("key", "label", "value", "row_count"), 4)


# ---- metrics ----------------------------------------------------------------------------------

_ALL_METRICS = [
    Metric("count"), Metric("distinct_count", "l_shipdate"), Metric("distinct_count", "l_partkey", alias="parts"),
    Metric("sum", "l_quantity"), Metric("mean", "l_extendedprice"), Metric("median", "l_extendedprice"),
    Metric("min", "l_discount"), Metric("max", "l_tax"), Metric("variance", "l_quantity"), Metric("std", "l_extendedprice"),
    Metric("percentile", "l_quantity", 90), Metric("percentile", "l_extendedprice", 99.5),
]
_ALL_METRICS_SQL = """
    CAST(count(*) AS DOUBLE) AS count, CAST(count(DISTINCT l_shipdate) AS DOUBLE) AS distinct_count_l_shipdate,
    CAST(count(DISTINCT l_partkey) AS DOUBLE) AS parts, sum(l_quantity) AS sum_l_quantity,
    round(avg(l_extendedprice), 6) AS mean_l_extendedprice, round(quantile_cont(l_extendedprice, 0.5), 6) AS median_l_extendedprice,
    min(l_discount) AS min_l_discount, max(l_tax) AS max_l_tax, round(var_samp(l_quantity), 6) AS variance_l_quantity,
    round(stddev_samp(l_extendedprice), 6) AS std_l_extendedprice, round(quantile_cont(l_quantity, 0.9), 6) AS p90_l_quantity,
    round(quantile_cont(l_extendedprice, 0.995), 6) AS p99_5_l_extendedprice
"""


def _all_metrics(spark, sf):
    plan = AnalyticsPlan("metrics", group_by=["l_returnflag", "status"], metrics=_ALL_METRICS)
    return rounded(run_plan(_lines(spark, sf), plan, "lineitem").table)


@query(f"SELECT l_returnflag, status, {_ALL_METRICS_SQL} FROM ({_LINES}) GROUP BY l_returnflag, status")
def group_metrics_all(spark, sf):
    return _all_metrics(spark, sf)


@query(f"SELECT {_ALL_METRICS_SQL} FROM lineitem")
def overall_metrics(spark, sf):
    return rounded(run_plan(_lines(spark, sf), AnalyticsPlan("metrics", metrics=_ALL_METRICS), "lineitem").table)


@query(
    """
    SELECT o_orderpriority, CAST(count(*) AS DOUBLE) AS count, round(sum(o_totalprice), 4) AS sum_o_totalprice
    FROM orders WHERE o_orderstatus NOT IN ('P') AND o_totalprice >= 1000 AND o_orderdate IS NOT NULL GROUP BY o_orderpriority
    """
)
def filtered_plan(spark, sf):
    plan = AnalyticsPlan(
        "metrics", group_by=["o_orderpriority"], metrics=[Metric("count"), Metric("sum", "o_totalprice")],
        filters=[
            PlanFilter("o_orderstatus", "not_in", ["P"]), PlanFilter("o_totalprice", "gte", 1000),
            PlanFilter("o_orderdate", "not_null"),
        ],
        nulls="fail", ascending=True,
    )
    return rounded(run_plan(table(spark, sf, "orders"), plan, "orders").table, 4)


@query(
    """
    WITH g AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY ALL),
    k AS (SELECT *, '{"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}' AS grouping FROM g)
    SELECT 'metric.count.group.' || substr(sha256(grouping), 1, 16) AS key, 'count' AS metric, CAST(n AS DOUBLE) AS value,
           'count' AS label, 'orders' AS dataset, 'count' AS calculation, n AS row_count, grouping, CAST(NULL AS VARCHAR) AS unit FROM k
    UNION ALL
    SELECT 'metric.revenue.group.' || substr(sha256(grouping), 1, 16), 'sum', round(s, 4), 'revenue', 'orders', 'sum_o_totalprice',
           n, grouping, NULL FROM k
    """
)
def group_metric_facts(spark, sf):
    plan = AnalyticsPlan(
        "metrics", group_by=["o_orderstatus", "o_orderpriority"], metrics=[Metric("count"), Metric("sum", "o_totalprice", alias="revenue")]
    )
    return rounded(run_plan(table(spark, sf, "orders"), plan, "orders").facts, 4).select(*FACT_COLUMNS)


@query(
    """
    SELECT c_mktsegment, CAST(count(*) AS DOUBLE) AS count, round(avg(c_acctbal), 6) AS mean_c_acctbal, round(sum(c_acctbal), 6) AS sum_c_acctbal
    FROM customer GROUP BY c_mktsegment
    """
)
def group_compare(spark, sf):
    plan = AnalyticsPlan("group_compare", group_by=["c_mktsegment"], value_column="c_acctbal")
    return rounded(run_plan(table(spark, sf, "customer"), plan, "customer").table)


_DISTRIBUTION = """
    SELECT CAST(count(l_discount) AS DOUBLE) AS count, CAST(count(*) - count(l_discount) AS DOUBLE) AS missing_count,
           min(l_discount) AS min, max(l_discount) AS max, round(avg(l_discount), 6) AS mean,
           round(quantile_cont(l_discount, 0.5), 6) AS median, round(stddev_samp(l_discount), 6) AS std,
           round(quantile_cont(l_discount, 0.25), 6) AS p25, round(quantile_cont(l_discount, 0.75), 6) AS p75
    FROM (SELECT nullif(l_discount, 0) AS l_discount FROM lineitem)
"""


def _distribution(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.expr("nullif(l_discount, 0)").alias("l_discount"))
    return rounded(run_plan(lines, AnalyticsPlan("distribution", value_column="l_discount"), "lineitem").table)


@query(_DISTRIBUTION)
def distribution(spark, sf):
    return _distribution(spark, sf)


@query(
    """
    SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, round(corr(l_quantity, l_extendedprice), 6) AS pearson, count(*) AS paired_rows
    FROM lineitem
    """
)
def correlation(spark, sf):
    plan = AnalyticsPlan("correlation", value_column="l_quantity", second_column="l_extendedprice")
    return rounded(run_plan(table(spark, sf, "lineitem"), plan, "lineitem").table)


@query(
    """
    SELECT 'metric.count' AS key, 1.0::DOUBLE AS value, 'count' AS label UNION ALL
    SELECT 'sql.orders', CAST(count(*) AS DOUBLE), 'orders' FROM orders UNION ALL
    SELECT 'sql.revenue', round(sum(o_totalprice), 4), 'revenue' FROM orders
    """
)
def select_facts_one_row(spark, sf):
    text = f"-- totals\nSELECT count(*) AS orders, sum(o_totalprice) AS revenue FROM parquet.`{sf}/orders.parquet`; -- end"
    facts = select_facts(spark, text)
    return rounded(facts.select("key", "value", "label"), 4)


@query(
    """
    SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS count, round(sum(l_quantity), 6) AS sum_l_quantity,
           round(quantile_cont(l_extendedprice, 0.5), 6) AS median_l_extendedprice
    FROM lineitem GROUP BY l_orderkey
    """
)
def group_metrics_by_order(spark, sf):
    """More groups than any default bound: one per order, none is cut."""
    metrics = [Metric("count"), Metric("sum", "l_quantity"), Metric("median", "l_extendedprice")]
    plan = AnalyticsPlan("metrics", group_by=["l_orderkey"], metrics=metrics)
    return rounded(run_plan(table(spark, sf, "lineitem"), plan, "lineitem").table)
