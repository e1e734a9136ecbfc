"""Named pipelines on whole tables: sales reports, grades, dataset roles and source-to-target tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditframe.plans.grades import GradePolicy, required_finals
from auditframe.plans.mapping import (
    clarifications, export_target, field_candidates, field_options, identify_roles, propose_mappings, run_transform,
)
from auditframe.plans.sales import clean_transactions, sales_report
from auditframe.plans.specs import (
    DerivationRule, FieldMapping, FieldReference, JoinRule, TargetColumn, TransformPlan,
)
from auditframe.session import work_path
from auditframe.sources.scans import read_csv
from auditframe.workload.metrics import rounded
from auditframe.workload.registry import query, table

POLICY = "Monthly commission policy: Salespeople earn a commission rate of 5% of completed net sales after discounts."

# Orders as transactions: finished orders are complete, urgent ones carry a discount, low
# priority has none stated. Customers in debt carry another key, which leaves their sales unassigned.
_TRANSACTIONS = """
    SELECT 'T' || o_orderkey AS transaction_id, o_orderdate AS date, o_orderpriority AS salesperson, 'C' || o_custkey AS customer_id,
           o_totalprice AS amount, CASE o_orderpriority WHEN '1-URGENT' THEN 10.5 WHEN '5-LOW' THEN NULL ELSE 0 END AS discount,
           CASE o_orderstatus WHEN 'F' THEN ' Complete ' WHEN 'O' THEN 'open' ELSE 'cancelled' END AS status
    FROM orders
"""
_CUSTOMERS = """
    SELECT CASE WHEN c_acctbal >= 0 THEN 'C' ELSE 'D' END || c_custkey AS customer_id, r_name AS region
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""
_NET = f"""
    SELECT t.*, strftime(date, '%B %Y') AS period, amount - coalesce(discount, 0) AS net_sales, coalesce(region, 'Unassigned') AS region
    FROM ({_TRANSACTIONS}) t LEFT JOIN ({_CUSTOMERS}) c ON t.customer_id = c.customer_id WHERE lower(trim(status)) = 'complete'
"""
_REGIONAL = f"""
    WITH net AS ({_NET}),
    a AS (SELECT period, region, count(*) AS n, sum(net_sales) AS s FROM net GROUP BY ALL),
    g AS (SELECT period, r_name AS region, r_regionkey * 250000.0 AS target FROM region, (SELECT DISTINCT period FROM net)),
    m AS (SELECT coalesce(a.period, g.period) AS period, coalesce(a.region, g.region) AS region, coalesce(n, 0) AS n,
                 coalesce(s, 0.0) AS s, target FROM a FULL JOIN g ON a.period = g.period AND a.region = g.region),
    u AS (SELECT *, CASE WHEN target IS NOT NULL THEN greatest(target - s, 0) END AS under FROM m)
    SELECT period, region, n AS transaction_count, round(s, 2) AS net_sales, target, round(s - target, 2) AS variance,
           round(CASE WHEN target <> 0 THEN s / target * 100 END, 6) AS attainment_pct, round(under, 2) AS underperformance,
           CASE WHEN target IS NULL THEN 'Target missing' WHEN s < target THEN 'Under target' WHEN s > target THEN 'Over target'
                ELSE 'On target' END AS performance_status,
           round(CASE WHEN sum(under) OVER (PARTITION BY period) <> 0 THEN under / sum(under) OVER (PARTITION BY period) * 100
                 ELSE 0 END, 6) AS share_of_shortfall_pct
    FROM u
"""


def _transactions(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "concat('T', o_orderkey) AS transaction_id", "o_orderdate AS date", "o_orderpriority AS salesperson",
        "concat('C', o_custkey) AS customer_id", "o_totalprice AS amount",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 10.5D WHEN '5-LOW' THEN NULL ELSE 0D END AS discount",
        "CASE o_orderstatus WHEN 'F' THEN ' Complete ' WHEN 'O' THEN 'open' ELSE 'cancelled' END AS status",
    )


def _customers(spark, sf):
    customers = table(spark, sf, "customer")
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.selectExpr("concat(CASE WHEN c_acctbal >= 0 THEN 'C' ELSE 'D' END, c_custkey) AS customer_id", "r_name AS region")


def _report(spark, sf, transactions=None):
    targets = table(spark, sf, "region").select(F.col("r_name").alias("region"), (F.col("r_regionkey") * 250000.0).alias("target"))
    evidence = spark.createDataFrame([("policy-1", POLICY)], "chunk_id string, text string")
    return sales_report(_transactions(spark, sf) if transactions is None else transactions, _customers(spark, sf), targets, evidence, single_period=False)


@query(_REGIONAL)
def sales_regional_performance(spark, sf):
    """Every month's regional report in one job."""
    regional = rounded(_report(spark, sf).regional.drop("match_state"), skip=("net_sales", "variance", "underperformance"))
    money = [F.round(c, 2).alias(c) for c in ("net_sales", "variance", "underperformance")]
    return regional.select("period", "region", "transaction_count", "target", "attainment_pct", "performance_status", "share_of_shortfall_pct", *money)


@query(
    f"""
    WITH s AS (SELECT period, salesperson, count(*) AS n, sum(net_sales) AS s FROM ({_NET}) GROUP BY ALL)
    SELECT period, salesperson, n AS transaction_count, round(s, 2) AS net_sales, round(s * 0.05, 4) AS commission,
           round(s / sum(s) OVER (PARTITION BY period) * 100, 6) AS share_of_sales_pct FROM s
    """
)
def sales_commissions(spark, sf):
    c = _report(spark, sf).commissions
    return c.select(
        "period", "salesperson", "transaction_count", F.round("net_sales", 2).alias("net_sales"),
        F.round("commission", 4).alias("commission"), F.round("share_of_sales_pct", 6).alias("share_of_sales_pct"),
    )


@query(
    f"""
    WITH r AS ({_REGIONAL}), s AS (SELECT period, salesperson, sum(net_sales) AS s FROM ({_NET}) GROUP BY ALL)
    SELECT period, 'total.net_sales' AS key, round(sum(s), 4) AS value FROM s GROUP BY period
    UNION ALL SELECT period, 'total.commission', round(sum(s) * 0.05, 4) FROM s GROUP BY period
    UNION ALL SELECT period, 'regional.' || region || '.net_sales', net_sales FROM r
    UNION ALL SELECT period, 'regional.' || region || '.target', target FROM r WHERE target IS NOT NULL
    UNION ALL SELECT period, 'regional.' || region || '.variance', variance FROM r WHERE target IS NOT NULL
    UNION ALL SELECT period, 'regional.' || region || '.underperformance', underperformance FROM r WHERE target IS NOT NULL
    UNION ALL SELECT period, 'salesperson.' || salesperson || '.net_sales', round(s, 4) FROM s
    UNION ALL SELECT period, 'commission.' || salesperson, round(s * 0.05, 4) FROM s
    UNION ALL SELECT period, 'regional.largest_underperformance', max(underperformance) FROM r WHERE target IS NOT NULL GROUP BY period
    """
)
def sales_facts(spark, sf):
    return _report(spark, sf).facts.withColumn("value", F.round("value", 4))


@query(
    f"""
    WITH t AS ({_TRANSACTIONS})
    SELECT 'original_transaction_rows' AS counter, count(*) + count(*) FILTER (WHERE salesperson = '2-HIGH') AS value FROM t UNION ALL
    SELECT 'non_complete_rows_excluded', count(*) + count(*) FILTER (WHERE salesperson = '2-HIGH') FROM t WHERE trim(status) <> 'Complete' UNION ALL
    SELECT 'invalid_date_rows_excluded', 0 UNION ALL SELECT 'invalid_amount_rows_excluded', 0 UNION ALL
    SELECT 'missing_identity_rows_excluded', 0 UNION ALL
    SELECT 'duplicate_transaction_rows_removed', count(*) FROM t WHERE trim(status) = 'Complete' AND salesperson = '2-HIGH' UNION ALL
    SELECT 'missing_discounts_filled_with_zero', count(*) FROM t WHERE discount IS NULL UNION ALL
    SELECT 'cleaned_rows', count(*) FROM t WHERE trim(status) = 'Complete'
    """
)
def sales_data_quality(spark, sf):
    """Quality counters of an input whose high-priority rows were delivered twice."""
    rows = _transactions(spark, sf)
    twice = rows.unionByName(rows.filter("salesperson = '2-HIGH'"))
    quality = clean_transactions(twice, single_period=False).quality
    return spark.createDataFrame(list(quality.items()), "counter string, value long")


@query(
    f"""
    SELECT transaction_id, date, salesperson, customer_id, region, amount, coalesce(discount, 0)::DOUBLE AS discount,
           round(net_sales, 2) AS net_sales, round(net_sales * 0.05, 4) AS commission, trim(status) AS status, o_custkey AS account, period
    FROM ({_NET}) JOIN orders ON transaction_id = 'T' || o_orderkey
    """
)
def sales_cleaned_transactions(spark, sf):
    """Cleaned transactions with their region; an extra source column is carried along."""
    rows = _transactions(spark, sf).join(
        table(spark, sf, "orders").select(F.concat(F.lit("T"), "o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("account")), "transaction_id"
    )
    cleaned = _report(spark, sf, rows).cleaned
    return cleaned.withColumn("net_sales", F.round("net_sales", 2)).withColumn("commission", F.round("commission", 4))


_GRADES = """
    SELECT user_id AS student_id, CASE event_type WHEN 'purchase' THEN 'Final Exam' ELSE event_type END AS category,
           CASE WHEN event_type <> 'purchase' THEN least(max(value), 100) END AS score,
           CASE event_type WHEN 'purchase' THEN 30.0 WHEN 'view' THEN 25.0 WHEN 'click' THEN 20.0 WHEN 'signup' THEN 15.0 ELSE 10.0 END AS weight
    FROM events GROUP BY user_id, event_type
"""


@query(
    f"""
    WITH g AS (SELECT student_id, count(*) FILTER (category = 'Final Exam') AS finals, sum(weight) AS total,
                      sum(CASE WHEN category <> 'Final Exam' THEN score * weight / 100 ELSE 0 END) AS c FROM ({_GRADES}) GROUP BY student_id),
    r AS (SELECT *, CASE WHEN finals <> 1 THEN 'Grade dataset must contain exactly one final-exam category.'
                         WHEN total <> 100 THEN 'Grade category weights must total 100 percent.' END AS reason, (75 - c) / 0.3 AS need FROM g)
    SELECT student_id, CASE WHEN reason IS NOT NULL THEN 'invalid' WHEN need > 100 THEN 'impossible' WHEN need <= 0 THEN 'already_guaranteed'
                            ELSE 'required' END AS status,
           CASE WHEN reason IS NULL THEN round(c, 4) END AS completed_contribution,
           CASE WHEN reason IS NULL THEN round(need, 4) END AS required_final_percentage, reason
    FROM r
    """
)
def weighted_required_finals(spark, sf):
    """A gradebook per user, built from the event log; users without every category are invalid."""
    grades = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.least(F.max("value"), F.lit(100.0)).alias("s"))
    weights = F.expr("CASE event_type WHEN 'purchase' THEN 30D WHEN 'view' THEN 25D WHEN 'click' THEN 20D WHEN 'signup' THEN 15D ELSE 10D END")
    book = grades.select(
        F.col("user_id").alias("student_id"),
        F.expr("CASE event_type WHEN 'purchase' THEN 'Final Exam' ELSE event_type END").alias("category"),
        F.when(F.col("event_type") != "purchase", F.col("s")).alias("score"),
        weights.alias("weight"),
    )
    return rounded(required_finals(book, GradePolicy(75.0, 30.0)), 4)


# ---- roles and field candidates ---------------------------------------------------------------


@query(
    """
    WITH held AS (SELECT DISTINCT p_brand || '/' || p_size AS dataset, p_type AS c FROM part),
    m AS (SELECT 'budget' AS role, dataset FROM held WHERE c IN ('ECONOMY', 'SMALL', 'PROMO') GROUP BY dataset HAVING count(*) = 3
          UNION ALL SELECT 'full', dataset FROM held WHERE c IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD') GROUP BY dataset HAVING count(*) = 6
          UNION ALL SELECT 'exotic', dataset FROM held WHERE c = 'EXOTIC' GROUP BY dataset)
    SELECT role, count(dataset) AS matching_datasets, CASE WHEN count(dataset) = 1 THEN min(dataset) END AS dataset
    FROM (SELECT unnest(['budget', 'full', 'exotic']) AS role) LEFT JOIN m USING (role) GROUP BY role
    """
)
def dataset_roles(spark, sf):
    """Brands and sizes as datasets and product types as their columns: which dataset fills which role?"""
    catalog = table(spark, sf, "part").select(F.concat_ws("/", "p_brand", "p_size").alias("dataset"), F.col("p_type").alias("column_name"))
    roles = {
        "budget": ["ECONOMY", "SMALL", "PROMO"],
        "full": ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"],
        "exotic": ["EXOTIC"],
    }
    return identify_roles(catalog, roles)


_MAP_TARGETS = """
    SELECT DISTINCT CASE WHEN p_type = 'PROMO' THEN replace(p_name, ' ', '_') ELSE 'type_' || lower(p_type) END AS target_field,
           CASE WHEN p_type = 'PROMO' AND p_name LIKE 'red%' THEN 'number' ELSE 'text' END AS target_type
    FROM part
"""
_MAP_SOURCES = """
    SELECT DISTINCT p_brand AS source_role, CASE WHEN p_size > 49 THEN p_name ELSE 'size ' || p_size END AS source_field,
           CASE WHEN p_size > 49 AND p_name LIKE '%bolt' THEN 'boolean' ELSE 'string' END AS data_type
    FROM part
"""
_MAPPED = f"""
    WITH t AS ({_MAP_TARGETS}), s AS ({_MAP_SOURCES}),
    n AS (SELECT target_field, target_type, source_role, source_field, data_type,
                 NOT (target_type = 'number' AND data_type = 'boolean') AS fits
          FROM t JOIN s ON replace(target_field, '_', '') = replace(source_field, ' ', '')),
    nc AS (SELECT target_field, count(*) AS n FROM n GROUP BY ALL),
    w AS (SELECT DISTINCT t.target_field, source_role, source_field FROM t JOIN s
          ON len(list_intersect([x FOR x IN split(target_field, '_') IF length(x) > 2], [x FOR x IN split(source_field, ' ') IF length(x) > 2])) > 0
          WHERE t.target_field NOT IN (SELECT target_field FROM nc) AND NOT (target_type = 'number' AND data_type = 'boolean')),
    wc AS (SELECT target_field, count(*) AS n FROM w GROUP BY ALL)
    SELECT t.target_field, t.target_type,
           CASE WHEN nc.n = 1 THEN 'normalized' WHEN nc.n IS NULL AND wc.n = 1 THEN 'semantic_candidate' ELSE 'unmapped' END AS mapping_type,
           CASE WHEN nc.n = 1 THEN n1.source_role WHEN nc.n IS NULL AND wc.n = 1 THEN w1.source_role END AS source_role,
           CASE WHEN nc.n = 1 THEN n1.source_field WHEN nc.n IS NULL AND wc.n = 1 THEN w1.source_field END AS source_field,
           CASE WHEN nc.n = 1 AND n1.fits THEN 0.97 WHEN nc.n IS NULL AND wc.n = 1 THEN 0.75 ELSE 0.0 END::DOUBLE AS confidence,
           CASE WHEN nc.n > 1 THEN 'ambiguous' WHEN nc.n = 1 THEN CASE WHEN n1.fits THEN 'proposed_high_confidence' ELSE 'incompatible' END
                WHEN wc.n >= 1 THEN 'ambiguous' ELSE 'missing' END AS status
    FROM t LEFT JOIN nc USING (target_field) LEFT JOIN wc USING (target_field)
    LEFT JOIN n n1 ON nc.n = 1 AND n1.target_field = t.target_field
    LEFT JOIN w w1 ON nc.n IS NULL AND wc.n = 1 AND w1.target_field = t.target_field
"""


def _catalog(spark, sf):
    parts = table(spark, sf, "part")
    targets = parts.selectExpr(
        "CASE WHEN p_type = 'PROMO' THEN replace(p_name, ' ', '_') ELSE concat('type_', lower(p_type)) END AS target_field",
        "CASE WHEN p_type = 'PROMO' AND p_name LIKE 'red%' THEN 'number' ELSE 'text' END AS target_type",
    ).distinct()
    sources = parts.selectExpr(
        "p_brand AS source_role", "CASE WHEN p_size > 49 THEN p_name ELSE concat('size ', p_size) END AS source_field",
        "CASE WHEN p_size > 49 AND p_name LIKE '%bolt' THEN 'boolean' ELSE 'string' END AS data_type",
    ).distinct()
    return targets, sources


@query(_MAPPED)
def mapping_candidates(spark, sf):
    """Product names as a column catalog: which source field fits which target field?"""
    targets, sources = _catalog(spark, sf)
    return propose_mappings(field_candidates(targets, sources), targets)


@query(
    f"""
    WITH t AS ({_MAP_TARGETS}), s AS ({_MAP_SOURCES}),
    o AS (SELECT DISTINCT target_field, source_role, source_field FROM t JOIN s
          ON replace(target_field, '_', '') = replace(source_field, ' ', '')
          OR (len(list_intersect([x FOR x IN split(target_field, '_') IF length(x) > 2], [x FOR x IN split(source_field, ' ') IF length(x) > 2])) > 0
              AND NOT (target_type = 'number' AND data_type = 'boolean'))
          WHERE target_field IN ('red_bolt', 'red_gear', 'cold_rod', 'new_plate', 'hot_ring')),
    k AS (SELECT *, row_number() OVER (PARTITION BY target_field ORDER BY source_role, source_field) AS place FROM o),
    l AS (SELECT target_field, string_agg(source_role || '.' || source_field, '|' ORDER BY source_role, source_field) AS options FROM k WHERE place <= 5 GROUP BY target_field)
    SELECT target_field, CASE status WHEN 'ambiguous' THEN 'ambiguous_mapping' WHEN 'missing' THEN 'missing_required_field'
           ELSE 'incompatible_type' END AS code, status, CASE WHEN status = 'ambiguous' THEN coalesce(options, '') ELSE '' END AS options
    FROM ({_MAPPED}) LEFT JOIN l USING (target_field)
    WHERE status IN ('ambiguous', 'missing', 'incompatible') AND target_field IN ('red_bolt', 'red_gear', 'cold_rod', 'new_plate', 'hot_ring')
    """
)
def mapping_clarifications(spark, sf):
    """Open required fields, each ambiguous one with the first five columns it may mean."""
    targets, sources = _catalog(spark, sf)
    wanted = ["red_bolt", "red_gear", "cold_rod", "new_plate", "hot_ring", "derived"]
    options = field_options(targets.filter(F.col("target_field").isin(wanted)), sources, k=5)
    asked = clarifications(propose_mappings(field_candidates(targets, sources), targets), wanted, ["derived"], options)
    return asked.withColumn("options", F.array_join("options", "|"))


# ---- source-to-target table -------------------------------------------------------------------


@query(
    """
    SELECT o_orderkey::DOUBLE AS "Order ID", upper(c_name) AS "Customer Name", lower(c_mktsegment) AS "Segment",
           o_totalprice AS "Gross Sales", o_totalprice - 25.0 AS "Net Sales", (o_totalprice - 25.0) * 0.05 AS "Commission",
           trim(c_name || ' / ' || coalesce(c_mktsegment, '')) AS "Label", o_totalprice / o_share AS "Parts", o_orderdate AS "Order Date",
           CAST(NULL AS VARCHAR) AS "Note", o_orderstatus = 'F' AS "Done"
    FROM (SELECT *, length(o_orderpriority) AS o_share FROM orders) LEFT JOIN customer ON o_custkey = c_custkey
    """
)
def source_to_target_table(spark, sf):
    """Orders and customers mapped, cleaned and derived into a fixed target table, exported, checked and read back."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("gross"),
        F.length("o_orderpriority").alias("o_share"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ordered"),
        F.when(F.col("o_orderstatus") == "F", " Yes ").otherwise("no").alias("done"),
    )
    customers = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit(" "), "c_name").alias("c_name"), "c_mktsegment")
    plan = TransformPlan(
        source_roles=["orders", "customers"],
        expected_source_columns={"orders": orders.columns, "customers": customers.columns},
        target=[
            TargetColumn("Order ID", "number"), TargetColumn("Customer Name", "text"), TargetColumn("Segment", "text"),
            TargetColumn("Gross Sales", "number"), TargetColumn("Net Sales", "number"), TargetColumn("Commission", "number"),
            TargetColumn("Label", "text"), TargetColumn("Parts", "number"), TargetColumn("Order Date", "date"), TargetColumn("Note"),
            TargetColumn("Done", "boolean"),
        ],
        mappings=[
            FieldMapping("Order ID", "orders", "o_orderkey"),
            FieldMapping("Customer Name", "customers", "c_name", "upper"),
            FieldMapping("Segment", "customers", "c_mktsegment", "lower"),
            FieldMapping("Gross Sales", "orders", "gross", "normalize_currency"),
            FieldMapping("Net Sales"), FieldMapping("Commission"), FieldMapping("Label"), FieldMapping("Parts"),
            FieldMapping("Order Date", "orders", "ordered", "normalize_date"),
            FieldMapping("Note"),
            FieldMapping("Done", "orders", "done"),
        ],
        joins=[JoinRule("customers", ["o_custkey"], ["c_custkey"], block_row_multiplication=False, max_unmatched_left_percentage=0.0)],
        derivations=[
            DerivationRule("Net Sales", "subtract", [FieldReference("target", "Gross Sales")], constant=25.0),
            DerivationRule("Commission", "policy_multiply", [FieldReference("target", "Net Sales")], policy_query="commission rate"),
            DerivationRule("Label", "concat", [FieldReference("customers", "c_name", "trim"), FieldReference("customers", "c_mktsegment")], separator=" / "),
            DerivationRule("Parts", "divide", [FieldReference("target", "Gross Sales"), FieldReference("orders", "o_share")]),
        ],
        required_fields=["Order ID", "Customer Name", "Net Sales"],
        unique_fields=["Order ID"],
    )
    evidence = spark.createDataFrame([("policy-1", POLICY)], "chunk_id string, text string")
    export = export_target(run_transform(plan, {"orders": orders, "customers": customers}, evidence), work_path(spark, "target-csv"))
    types = {"Order ID": "double", "Gross Sales": "double", "Net Sales": "double", "Commission": "double", "Parts": "double", "Order Date": "timestamp", "Done": "boolean"}
    frame = read_csv(spark, export.path, types=types, line_sep="\n")
    return frame.withColumn("Customer Name", F.trim("`Customer Name`"))
