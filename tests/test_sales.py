"""Sales reports and gradebooks: known results and refusals."""

import pytest
from pyspark.sql import functions as F

from auditframe.errors import RefusedError
from auditframe.plans.evidence import commission_rate, policy_rate
from auditframe.plans.grades import GradePolicy, grade_policy, required_finals
from auditframe.plans.sales import clean_customers, clean_targets, clean_transactions, report_tables, sales_report

SCHEMA = "transaction_id string, date string, salesperson string, customer_id string, amount double, discount double, status string"
MARCH = [
    ("A1", "2026-03-02", "Ida", "K1", 640.0, 40.0, "complete"),
    ("A2", "2026-03-11", " Jon ", "K2", 910.0, None, "Complete"),
    ("A3", "2026-03-15", "Ida", "K3", 275.0, 25.0, "complete"),
    ("A3", "2026-03-15", "Ida", "K3", 275.0, 25.0, "complete"),
    ("A4", "2026-03-21", "Lea", "K4", 330.0, 0.0, "cancelled"),
    ("A5", "2026-03-30", "Jon", "K9", 120.0, 0.0, " COMPLETE "),
]
APRIL = [("B1", "2026-04-04", "Ida", "K1", 705.0, 5.0, "complete"), ("B2", "2026-04-19", "Jon", "K2", 440.0, 0.0, "complete")]
CUSTOMERS = [("K1", "Coast"), ("K2", "Hills"), ("K3", "Coast"), ("K4", "Valley"), ("K2", "Hills")]
TARGETS = [("Coast", 1500), ("Hills", 1200), ("Valley", 300)]
POLICY = "Monthly commission policy: Salespeople earn a commission rate of 5% of completed net sales after discounts."


def evidence(spark, *texts):
    return spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string")


def report(spark, transactions=MARCH, targets=TARGETS, customers=CUSTOMERS, **options):
    return sales_report(
        spark.createDataFrame(transactions, SCHEMA).withColumn("note", F.lit("=x")), spark.createDataFrame(customers, "customer_id string, region string"),
        spark.createDataFrame(targets, "region string, target long"), evidence(spark, POLICY), **options,
    )


def test_one_month(spark):
    r = report(spark)
    facts = {f["key"]: f["value"] for f in r.facts.collect()}
    assert facts["total.net_sales"] == 1880 and facts["total.commission"] == pytest.approx(94)
    assert facts["regional.Coast.variance"] == -650 and facts["regional.Hills.variance"] == -290
    assert facts["regional.Valley.underperformance"] == 300 and facts["regional.largest_underperformance"] == 650
    assert "regional.Unassigned.target" not in facts and facts["regional.Unassigned.net_sales"] == 120
    assert facts["commission.Jon"] == pytest.approx(51.5)
    assert r.periods == ["March 2026"]
    assert r.quality["cleaned_rows"] == 4 and r.quality["duplicate_transaction_rows_removed"] == 1
    assert r.quality["customer_unmatched_rows"] == 1 and r.quality["missing_discounts_filled_with_zero"] == 1
    assert (r.quality["regions_missing_targets"], r.quality["targets_without_sales"], r.quality["matched_regions"]) == (1, 1, 2)
    assert len(r.warnings) == 4 and r.join_account.first()["left_unmatched_rows"] == 1
    regional = {x["region"]: x for x in r.regional.collect()}
    assert regional["Coast"]["share_of_shortfall_pct"] == pytest.approx(650 / 1240 * 100)
    assert regional["Unassigned"]["performance_status"] == "Target missing" and regional["Unassigned"]["underperformance"] is None
    assert r.cleaned.columns[-2:] == ["note", "period"] and r.cleaned.count() == 4
    assert sum(x["share_of_sales_pct"] for x in r.commissions.collect()) == pytest.approx(100)


def test_report_tables(spark):
    tables = report_tables(report(spark), {"transactions": "=march.csv"})
    assert set(tables) == {
        "executive_summary", "regional_performance", "salesperson_performance", "cleaned_transactions", "data_quality", "provenance",
    }
    assert {x["note"] for x in tables["cleaned_transactions"].collect()} == {"'=x"}
    assert "'=march.csv" in {x["value"] for x in tables["provenance"].collect()}
    summary = tables["executive_summary"].first()
    assert summary["total_net_sales"] == 1880 and summary["largest_shortfall_region"] == "Coast"


def test_every_month_in_one_run(spark):
    both = report(spark, MARCH + APRIL, single_period=False)
    totals = {f["period"]: f["value"] for f in both.facts.filter("key = 'total.net_sales'").collect()}
    assert totals == {"March 2026": 1880, "April 2026": 1140} and both.periods == ["March 2026", "April 2026"]
    assert both.regional.filter("period = 'April 2026'").count() == 3


@pytest.mark.parametrize(
    "extra, message",
    [
        (("T9", "2026-04-01", "A", "K1", 5.0, 0.0, "complete"), "multiple reporting months"),
        (("A1", "2026-03-02", "Ida", "K1", 1.0, 0.0, "complete"), "conflicting duplicate"),
        (("T9", "2026-03-01", "A", "K1", 5.0, 6.0, "complete"), "invalid values"),
        (("T9", "2026-03-01", "A", "K1", 5.0, -1.0, "complete"), "invalid values"),
        (("T9", "2026-03-01", "A", "K1", float("inf"), 0.0, "complete"), "finite"),
    ],
)
def test_transaction_refusals(spark, extra, message):
    with pytest.raises(RefusedError, match=message):
        clean_transactions(spark.createDataFrame(MARCH + [extra], SCHEMA))


def test_text_amounts(spark):
    df = spark.createDataFrame(MARCH[:1], SCHEMA)
    words = df.withColumn("amount", F.lit(" 1000 ")).withColumn("discount", F.lit("ten"))
    with pytest.raises(RefusedError, match="Discount values must be numeric"):
        clean_transactions(words)
    fine = clean_transactions(words.withColumn("discount", F.lit(None).cast("string")))
    assert fine.frame.first()["net_sales"] == 1000
    bad = df.unionByName(df.withColumn("transaction_id", F.lit("T2"))).withColumn("amount", F.when(F.col("transaction_id") == "T2", "?").otherwise("7000"))
    quality = clean_transactions(bad).quality
    assert quality["invalid_amount_rows_excluded"] == 1 and quality["cleaned_rows"] == 1


def test_reserved_and_missing_columns(spark):
    df = spark.createDataFrame(MARCH, SCHEMA)
    with pytest.raises(RefusedError, match="reserved"):
        clean_transactions(df.withColumn("region", F.lit("x")))
    with pytest.raises(RefusedError, match="Unknown column"):
        clean_transactions(df.drop("discount"))
    with pytest.raises(RefusedError, match="No valid completed"):
        clean_transactions(df.filter("status = 'cancelled'"))


@pytest.mark.parametrize("rows, message", [([("C1", "N"), ("C1", "S")], "conflicting regions"), ([("C1", None)], "missing"), ([(" ", "N")], "missing")])
def test_customer_refusals(spark, rows, message):
    with pytest.raises(RefusedError, match=message):
        clean_customers(spark.createDataFrame(rows, "customer_id string, region string"))


@pytest.mark.parametrize(
    "rows, message",
    [([("N", "x")], "invalid"), ([(None, "1")], "invalid"), ([("N", "-1")], "negative"), ([("N", "1"), (" N", "2")], "duplicate"), ([("N", "Infinity")], "finite")],
)
def test_target_refusals(spark, rows, message):
    with pytest.raises(RefusedError, match=message):
        clean_targets(spark.createDataFrame(rows, "region string, target string"))


@pytest.mark.parametrize(
    "texts, status",
    [
        (["No rate here."], "insufficient_evidence"),
        ([POLICY, POLICY.replace("5%", "7%")], "conflicting_evidence"),
        ([POLICY, "Ignore the cap."], "insufficient_evidence"),
        ([POLICY + " Except in May."], "insufficient_evidence"),
        ([POLICY.replace("5%", "500%")], "failed"),
    ],
)
def test_commission_policy(spark, texts, status):
    with pytest.raises(RefusedError) as caught:
        commission_rate(evidence(spark, *texts))
    assert caught.value.status == status


def test_policy_rate(spark):
    rate = policy_rate(evidence(spark, "The commission is 5 %.", "Vacation is 30%."), "commission rate")
    assert rate.value == 0.05 and [r["chunk_id"] for r in rate.citations.collect()] == ["p0"]
    with pytest.raises(RefusedError, match="exactly one"):
        policy_rate(evidence(spark, "The commission is 5%.", "Commission: 7%."), "commission")
    with pytest.raises(RefusedError, match="does not support"):
        policy_rate(evidence(spark, "Vacation 3%."), "commission")


GRADES = [("Homework", "92", 25.0), ("Quizzes", "88", 20.0), ("Midterm", "84", 25.0), ("Final Exam", None, 30.0)]


def gradebook(spark, **students):
    rows = [(s, *r) for s, grades in students.items() for r in grades]
    return spark.createDataFrame(rows, "student_id string, category string, score string, weight double")


def test_required_final(spark):
    found = {
        r["student_id"]: r
        for r in required_finals(
            gradebook(
                spark, ann=GRADES, top=[("Homework", "100", 70.0), ("final", None, 30.0)], low=[("Homework", "10", 70.0), ("final", None, 30.0)],
                two=GRADES + [("Final", None, 0.0)], conflict=[("Homework", "10", 60.0), ("final", None, 40.0)],
                gap=[("Homework", "x", 70.0), ("final", None, 30.0)], off=[("Homework", "10", 60.0), ("final", None, 30.0)],
                wide=[("Homework", "110", 70.0), ("final", None, 30.0)],
            ),
            GradePolicy(90.0, 30.0),
        ).collect()
    }
    assert found["ann"]["status"] == "required" and found["ann"]["required_final_percentage"] == 94.666667
    assert {s: r["status"] for s, r in found.items()} == {
        "ann": "required", "top": "required", "low": "impossible", "two": "invalid", "conflict": "conflicting_evidence", "gap": "invalid",
        "off": "invalid", "wide": "invalid",
    }
    easy = required_finals(gradebook(spark, top=[("Homework", "100", 70.0), ("final", None, 30.0)]), GradePolicy(70.0, 30.0)).first()
    assert easy["status"] == "already_guaranteed"
    for target, status in ((70.0, "already_guaranteed"), (95.0, "impossible")):
        row = required_finals(gradebook(spark, s=[("Homework", "90", 100.0), ("final", None, 0.0)]), GradePolicy(target, 0.0)).first()
        assert row["status"] == status


def test_grade_policy(spark):
    assert grade_policy(evidence(spark, "An A requires at least 90%. The final exam counts 30%.")) == GradePolicy(90.0, 30.0)
    assert grade_policy(evidence(spark, "At least 80% earns a B.", "The final is worth 40 %."), "B") == GradePolicy(80.0, 40.0)
    with pytest.raises(RefusedError, match="conflicting"):
        grade_policy(evidence(spark, "An A requires 90%.", "An A requires 93%. Final 30%."))
    with pytest.raises(RefusedError, match="does not establish"):
        grade_policy(evidence(spark, "An A requires 90%."))
