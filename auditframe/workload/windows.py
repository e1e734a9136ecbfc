"""Ranks, rolling means and period changes on whole tables, with both execution strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditframe.operators.windows import rank_rows, rolling_mean, series_change
from auditframe.plans.analytics import run_plan
from auditframe.plans.specs import AnalyticsPlan
from auditframe.workload.metrics import rounded
from auditframe.workload.registry import query, table

_PARTS = "SELECT p_partkey, nullif(p_size, 50) AS size FROM part"


def _parts(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey", "nullif(p_size, 50) AS size")


def _rank_sql(function):
    return f"SELECT p_partkey, size, CASE WHEN size IS NOT NULL THEN CAST({function} AS DOUBLE) END AS rank FROM ({_PARTS})"


_DENSE = _rank_sql("dense_rank() OVER (ORDER BY size DESC NULLS LAST)")
_MIN = _rank_sql("rank() OVER (ORDER BY size DESC NULLS LAST)")
_MAX = _rank_sql("count(size) OVER (ORDER BY size DESC NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")


@query(_DENSE)
def rank_dense(spark, sf):
    return rank_rows(_parts(spark, sf), "size", "dense")


@query(_MIN)
def rank_min(spark, sf):
    return rank_rows(_parts(spark, sf), "size", "min")


@query(_MAX)
def rank_max(spark, sf):
    return rank_rows(_parts(spark, sf), "size", "max")


@query(
    """
    SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(dense_rank() OVER (ORDER BY l_extendedprice) AS DOUBLE) AS rank
    FROM lineitem
    """
)
def rank_dense_ascending_by_range(spark, sf):
    """Dense rank of every line item without ordering the whole table in one task."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rank_rows(lines, "l_extendedprice", "dense", ascending=True)


@query(
    """
    SELECT l_orderkey, l_linenumber, l_quantity, CAST(rank() OVER (ORDER BY l_quantity DESC) AS DOUBLE) AS rank FROM lineitem
    """
)
def rank_min_by_range(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return rank_rows(lines, "l_quantity", "min")


@query(
    """
    SELECT l_orderkey, l_linenumber, l_quantity,
           CAST(count(*) OVER (ORDER BY l_quantity DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS rank
    FROM lineitem
    """
)
def rank_max_by_range(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return rank_rows(lines, "l_quantity", "max")


@query(
    """
    SELECT 'rank.top_value' AS key, max(p_retailprice) AS value, count(*) AS row_count FROM part
    """
)
def rank_top_fact(spark, sf):
    plan = AnalyticsPlan("rank", value_column="p_retailprice", limit=10)
    return run_plan(table(spark, sf, "part"), plan, "part").facts.select("key", "value", "row_count")


# ---- rolling means ----------------------------------------------------------------------------

_DAILY = "SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, round(sum(value), 2) AS total FROM events GROUP BY ALL"


def _daily(spark, sf):
    days = table(spark, sf, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day"))
    return days.agg(F.round(F.sum("value"), 2).alias("total"))


@query(
    f"""
    SELECT event_type, day, total,
           CASE WHEN count(*) OVER w = 7 THEN round(avg(total) OVER w, 6) END AS rolling_mean
    FROM ({_DAILY}) WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
    """
)
def rolling_mean_daily(spark, sf):
    return rounded(rolling_mean(_daily(spark, sf), "total", "day", 7, ["event_type"]), skip=("total",))


_EVENTS_ROLLING = """
    SELECT user_id, event_id, CASE WHEN count(value) OVER w = 5 THEN round(avg(value) OVER w, 6) END AS rolling_mean
    FROM (SELECT user_id, event_id, ts, nullif(value, 10.0) AS value FROM events)
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
"""


def _events_rolling(spark, sf, **options):
    events = table(spark, sf, "events").selectExpr("user_id", "event_id", "ts", "nullif(value, 10.0) AS value")
    rolled = rolling_mean(events, "value", "ts", 5, ["user_id"], **options)
    return rounded(rolled.select("user_id", "event_id", "rolling_mean"))


@query(_EVENTS_ROLLING)
def rolling_mean_per_user(spark, sf):
    return _events_rolling(spark, sf)


@query(
    """
    SELECT event_id, CASE WHEN count(value) OVER w = 30 THEN round(avg(value) OVER w, 6) END AS rolling_mean
    FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
    """
)
def rolling_mean_global_by_blocks(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts", "value")
    return rounded(rolling_mean(events, "value", "ts", 30).select("event_id", "rolling_mean"))


@query(
    f"""
    WITH r AS (SELECT event_type, day, CASE WHEN count(*) OVER w = 7 THEN avg(total) OVER w END AS m
               FROM ({_DAILY}) WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
    SELECT 'rolling.mean.last.group.' || substr(sha256('{{"event_type":"' || event_type || '"}}'), 1, 16) AS key,
           round(arg_max(m, day), 6) AS value, count(m) AS row_count
    FROM r WHERE m IS NOT NULL GROUP BY event_type
    """
)
def rolling_mean_facts(spark, sf):
    plan = AnalyticsPlan("rolling_mean", group_by=["event_type"], value_column="total", order_column="day", window=7)
    return rounded(run_plan(_daily(spark, sf), plan, "events").facts.select("key", "value", "row_count"))


# ---- period changes ---------------------------------------------------------------------------

_MONTHLY = """
    SELECT strftime(o_orderdate, '%Y-%m') AS month_text, date_trunc('month', o_orderdate)::TIMESTAMP AS month,
           round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL
"""


def _monthly(spark, sf):
    months = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return months.agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


_CHANGE = f"""
    SELECT month, total, round((total - p) / p * 100, 6) AS percent_change, round((total - p) / p, 6) AS growth_rate
    FROM (SELECT month, total, lag(total) OVER (ORDER BY month) AS p FROM ({_MONTHLY}))
"""


@query(_CHANGE)
def percent_change_monthly(spark, sf):
    return rounded(series_change(_monthly(spark, sf), "total", "month"), skip=("total",))


@query(
    """
    SELECT event_id, round((value - p) / p, 6) AS growth_rate
    FROM (SELECT event_id, value, lag(value) OVER (ORDER BY ts, event_id) AS p FROM events)
    """
)
def growth_rate_per_event_by_blocks(spark, sf):
    """The change of every event's value; values may be zero, and the change from one is infinite as in the SQL."""
    events = table(spark, sf, "events").select("event_id", "ts", "value")
    return rounded(series_change(events, "value", "ts", refuse_zero=False).select("event_id", "growth_rate"))


@query(
    f"""
    SELECT 'growth_rate.last' AS key, round(arg_max(g, month), 6) AS value, count(g) AS row_count, 'ratio' AS unit
    FROM (SELECT month, (total - lag(total) OVER (ORDER BY month)) / lag(total) OVER (ORDER BY month) AS g FROM ({_MONTHLY}))
    """
)
def growth_rate_fact(spark, sf):
    plan = AnalyticsPlan("growth_rate", value_column="total", order_column="month")
    return rounded(run_plan(_monthly(spark, sf), plan, "orders").facts.select("key", "value", "row_count", "unit"))
