"""Sales reports per reporting month: cleaning, regional performance, commissions and facts."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from auditframe.errors import RefusedError
from auditframe.functions.identity import row_digest
from auditframe.functions.columns import family, ref, require_columns
from auditframe.functions.scalars import blank, moment, neutralize_formulas, strip, to_number
from auditframe.guards import Guard, refuse_if
from auditframe.operators.joins import join_diagnostics, match_counts, one_to_one_outer
from auditframe.plans.evidence import commission_rate
from auditframe.plans.specs import JoinSpec
from auditframe.session import materialize

TRANSACTION_COLUMNS = ["transaction_id", "date", "salesperson", "customer_id", "amount", "discount", "status"]
IDENTITY_COLUMNS = ["transaction_id", "salesperson", "customer_id"]
RESERVED_COLUMNS = {"net_sales", "commission", "region"}
UNASSIGNED = "Unassigned"


@dataclass(frozen=True)
class CleanTransactions:
    frame: DataFrame
    quality: dict[str, int]


@dataclass(frozen=True)
class SalesReport:
    periods: list[str]
    cleaned: DataFrame
    regional: DataFrame
    commissions: DataFrame
    facts: DataFrame
    quality: dict[str, int]
    join_account: DataFrame
    commission_rate: float
    citations: DataFrame
    warnings: list[str]


def _number(df: DataFrame, column: str) -> Column:
    return to_number(ref(column)) if family(df.schema[column].dataType) == "text" else F.nanvl(ref(column).cast("double"), F.lit(None))


def _text(df: DataFrame, column: str) -> Column:
    return strip(ref(column).cast("string")) if family(df.schema[column].dataType) == "text" else ref(column).cast("string")


def _prepared(transactions: DataFrame) -> DataFrame:
    """Typed transactions with an ``__eligible`` flag; extra source columns stay as they are."""
    typed = {
        **{c: _text(transactions, c) for c in [*IDENTITY_COLUMNS, "status"]},
        "date": moment(transactions, "date"),
        "amount": _number(transactions, "amount"),
        "discount": F.coalesce(_number(transactions, "discount"), F.lit(0.0)),
    }
    prepared = transactions.select(*[typed.get(c, ref(c)).alias(c) for c in transactions.columns])
    complete = F.coalesce(F.lower(strip(F.col("status"))) == "complete", F.lit(False))
    identified = reduce(lambda a, b: a & b, [~blank(F.col(c)) for c in IDENTITY_COLUMNS])
    return prepared.withColumn("__complete", complete).withColumn("__identified", identified).withColumn(
        "__eligible", complete & identified & F.col("date").isNotNull() & F.col("amount").isNotNull()
    )


def clean_transactions(transactions: DataFrame, single_period: bool = True) -> CleanTransactions:
    """Completed, valid and unique transactions with ``period`` and ``net_sales``.

    ``period`` is the reporting month; a source column of that name gives way to it.

    All refusals and quality counters come from one job: a count per transaction id, whose
    hashes tell equal copies from conflicting ones, summed up to one row.
    """
    require_columns(transactions, TRANSACTION_COLUMNS, "transactions")
    reserved = RESERVED_COLUMNS & set(transactions.columns)
    if reserved:
        raise RefusedError(f"Transactions contain reserved report output columns: {', '.join(sorted(reserved))}.")
    given = _number(transactions, "discount")
    raw_amount = _number(transactions, "amount")
    infinite = F.abs(raw_amount) == float("inf")
    infinite = infinite | (F.abs(given) == float("inf"))
    bad_discount = ref("discount").isNotNull() & given.isNull()
    digests = {"__digest": row_digest(transactions), "__digest2": row_digest(transactions, 1)}
    flagged = transactions.withColumns(
        digests | {"__bad_discount": bad_discount, "__infinite": infinite, "__no_discount": ref("discount").isNull()}
    )
    prepared = _prepared(flagged)
    month = F.date_trunc("month", "date")
    eligible = F.col("__eligible")
    per_id = prepared.groupBy("transaction_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("__digest").alias("h1"),
        F.max("__digest").alias("h2"),
        F.min("__digest2").alias("h3"),
        F.max("__digest2").alias("h4"),
        F.count_if(eligible).alias("eligible"),
        F.count_if("__bad_discount").alias("bad_discount"),
        F.count_if("__infinite").alias("infinite"),
        F.count_if(eligible & ((F.col("discount") < 0) | (F.col("amount") < F.col("discount")))).alias("invalid"),
        F.count_if(~F.col("__complete")).alias("non_complete"),
        F.count_if(F.col("date").isNull()).alias("bad_date"),
        F.count_if(F.col("amount").isNull()).alias("bad_amount"),
        F.count_if(~F.col("__identified")).alias("unidentified"),
        F.count_if("__no_discount").alias("no_discount"),
        F.min(F.when(eligible, month)).alias("first_month"),
        F.max(F.when(eligible, month)).alias("last_month"),
    )
    sums = ["n", "eligible", "bad_discount", "infinite", "invalid", "non_complete", "bad_date", "bad_amount", "unidentified", "no_discount"]
    row = per_id.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
        F.count_if((F.col("h1") != F.col("h2")) | (F.col("h3") != F.col("h4"))).alias("conflicting"),
        F.count_if(F.col("eligible") > 0).alias("kept"),
        F.min("first_month").alias("first_month"),
        F.max("last_month").alias("last_month"),
    ).first()
    if row["bad_discount"]:
        raise RefusedError("Discount values must be numeric when provided; invalid discounts cannot be assumed to be zero.")
    if row["infinite"]:
        raise RefusedError("Amounts and discounts must be finite numbers.")
    if row["conflicting"]:
        raise RefusedError(f"{row['conflicting']} transaction id(s) have conflicting duplicate rows; deduplication is unsafe.")
    if not row["kept"]:
        raise RefusedError("No valid completed transactions remain after bounded cleaning.")
    if single_period and row["first_month"] != row["last_month"]:
        raise RefusedError("Completed transactions span multiple reporting months; the reporting period is ambiguous.")
    if row["invalid"]:
        raise RefusedError("Amounts and discounts contain invalid values.")
    cleaned = (
        prepared.filter("__eligible")
        .dropDuplicates(["transaction_id"])
        .withColumn("period", F.date_format("date", "MMMM yyyy"))
        .withColumn("net_sales", F.col("amount") - F.col("discount"))
        .drop("__eligible", "__complete", "__identified", "__bad_discount", "__infinite", "__no_discount")
    )
    quality = {
        "original_transaction_rows": row["n"],
        "non_complete_rows_excluded": row["non_complete"],
        "invalid_date_rows_excluded": row["bad_date"],
        "invalid_amount_rows_excluded": row["bad_amount"],
        "missing_identity_rows_excluded": row["unidentified"],
        "duplicate_transaction_rows_removed": row["eligible"] - row["kept"],
        "missing_discounts_filled_with_zero": row["no_discount"],
        "cleaned_rows": row["kept"],
    }
    return CleanTransactions(cleaned, quality)


def clean_customers(customers: DataFrame) -> tuple[DataFrame, list[str]]:
    """Customer to region, each customer once; conflicting regions are refused."""
    require_columns(customers, ["customer_id", "region"], "customers")
    pairs = customers.select(_text(customers, "customer_id").alias("customer_id"), _text(customers, "region").alias("region"))
    grouped = pairs.groupBy("customer_id").agg(
        F.min("region").alias("region"), F.max("region").alias("other"), F.count(F.lit(1)).alias("n"),
        F.count_if(blank(F.col("region")) | blank(F.col("customer_id"))).alias("blank"),
    )
    row = grouped.agg(
        F.sum("blank").alias("blank"),
        F.count_if(F.col("region") != F.col("other")).alias("conflicting"),
        (F.sum("n") - F.count(F.lit(1))).alias("repeated"),
    ).first()
    if row["blank"]:
        raise RefusedError("Customer data contains missing customer_id or region values.")
    if row["conflicting"]:
        raise RefusedError(f"{row['conflicting']} customer id(s) map to conflicting regions.")
    warnings = []
    if row["repeated"]:
        warnings.append(f"Removed {row['repeated']} duplicate customer row(s) with identical region mappings.")
    return grouped.select("customer_id", "region"), warnings


def clean_targets(targets: DataFrame) -> DataFrame:
    """One finite, non-negative target per region."""
    require_columns(targets, ["region", "target"], "targets")
    cleaned = targets.select(_text(targets, "region").alias("region"), _number(targets, "target").alias("target"))
    refuse_if(
        cleaned,
        [
            Guard("Target data contains missing or invalid region/target values.", blank(F.col("region")) | F.col("target").isNull()),
            Guard("Regional targets must be finite numbers.", F.abs("target") == float("inf")),
            Guard("Regional targets cannot be negative.", F.col("target") < 0),
        ],
    )
    if cleaned.groupBy("region").count().filter("count > 1").limit(1).count():
        raise RefusedError("Target data contains duplicate regions; one target per region is required.")
    return cleaned


def performance_status(target: Column, variance: Column) -> Column:
    return (
        F.when(target.isNull(), "Target missing")
        .when(variance < 0, "Under target")
        .when(variance > 0, "Over target")
        .otherwise("On target")
    )


def sales_totals(assigned: DataFrame, rate: float) -> DataFrame:
    """Totals per period, region and salesperson: the one pass both report tables are folded from.

    ``region`` is null where the customer is unknown.
    """
    return assigned.groupBy("period", "region", "salesperson").agg(
        F.count("transaction_id").alias("transaction_count"),
        F.sum("net_sales").alias("net_sales"),
        F.sum(F.col("net_sales") * F.lit(rate)).alias("commission"),
    )


def regional_performance(totals: DataFrame, targets: DataFrame, periods: list[str]) -> DataFrame:
    """Net sales against target per period and region; ``match_state`` tells which sides exist."""
    actuals = totals.groupBy("period", F.coalesce("region", F.lit(UNASSIGNED)).alias("region")).agg(
        F.sum("transaction_count").alias("transaction_count"), F.sum("net_sales").alias("net_sales")
    )
    keyed_actuals = actuals.select(F.struct("period", "region").alias("k"), "transaction_count", "net_sales")
    every_period = F.explode(F.array(*[F.lit(p) for p in periods]))
    keyed_targets = targets.select(every_period.alias("period"), "region", "target").select(
        F.struct("period", "region").alias("k"), "target"
    )
    merged = one_to_one_outer(keyed_actuals, keyed_targets, "k", checked=True)
    net = F.coalesce("net_sales", F.lit(0.0))
    variance = net - F.col("target")
    shaped = merged.select(
        F.col("k.period").alias("period"),
        F.col("k.region").alias("region"),
        F.coalesce("transaction_count", F.lit(0)).alias("transaction_count"),
        net.alias("net_sales"),
        "target",
        variance.alias("variance"),
        (F.try_divide(net, F.col("target")) * 100).alias("attainment_pct"),
        # greatest() skips nulls, so a missing target must be kept missing here
        F.when(variance.isNotNull(), F.greatest(-variance, F.lit(0.0))).alias("underperformance"),
        performance_status(F.col("target"), variance).alias("performance_status"),
        "match_state",
    )
    shortfalls = shaped.groupBy("period").agg(F.coalesce(F.sum("underperformance"), F.lit(0.0)).alias("__total"))
    share = F.when(F.col("__total") != 0, F.col("underperformance") / F.col("__total") * 100).otherwise(F.lit(0.0))
    return shaped.join(shortfalls, "period").withColumn("share_of_shortfall_pct", share).drop("__total")


def salesperson_commissions(totals: DataFrame) -> DataFrame:
    """Net sales, commission and share of sales per period and salesperson."""
    grouped = totals.groupBy("period", "salesperson").agg(
        F.sum("transaction_count").alias("transaction_count"),
        F.sum("net_sales").alias("net_sales"),
        F.sum("commission").alias("commission"),
    )
    # The total is joined in; a window would gather all salespeople of a month in one task.
    per_period = totals.groupBy("period").agg(F.sum("net_sales").alias("__total"))
    total = F.col("__total")
    share = F.when(total != 0, F.col("net_sales") / total * 100).otherwise(F.lit(0.0))
    return grouped.join(per_period, "period").withColumn("share_of_sales_pct", share).drop("__total")


def report_facts(regional: DataFrame, commissions: DataFrame) -> DataFrame:
    """(period, key, value) facts of a report."""

    def facts(df: DataFrame, items: list[tuple[Column, Column]]) -> DataFrame:
        structs = [F.struct(k.alias("key"), v.cast("double").alias("value")) for k, v in items]
        return df.select("period", F.explode(F.array(*structs)).alias("f")).select("period", "f.key", "f.value")

    def key(prefix: str, name: str, suffix: str = "") -> Column:
        return F.concat(F.lit(prefix), F.col(name), F.lit(suffix))

    totals = commissions.groupBy("period").agg(F.sum("net_sales").alias("s"), F.sum("commission").alias("c"))
    targeted = regional.filter(F.col("target").isNotNull())
    largest = targeted.groupBy("period").agg(F.max("underperformance").alias("u"))
    return reduce(
        DataFrame.unionByName,
        [
            facts(totals, [(F.lit("total.net_sales"), F.col("s")), (F.lit("total.commission"), F.col("c"))]),
            facts(regional, [(key("regional.", "region", ".net_sales"), F.col("net_sales"))]),
            facts(targeted, [(key("regional.", "region", f".{m}"), F.col(m)) for m in ("target", "variance", "underperformance")]),
            facts(
                commissions,
                [
                    (key("salesperson.", "salesperson", ".net_sales"), F.col("net_sales")),
                    (key("commission.", "salesperson"), F.col("commission")),
                ],
            ),
            facts(largest, [(F.lit("regional.largest_underperformance"), F.col("u"))]),
        ],
    )


def sales_report(
    transactions: DataFrame, customers: DataFrame, targets: DataFrame, evidence: DataFrame, single_period: bool = True
) -> SalesReport:
    """The whole report. With ``single_period=False`` every month of the input gets its own."""
    rate = commission_rate(evidence)
    clean = clean_transactions(transactions, single_period)
    regions, warnings = clean_customers(customers)
    goals = clean_targets(targets)
    assigned = clean.frame.join(regions, "customer_id", "left")
    totals = materialize(sales_totals(assigned, rate.value))
    unmatched = totals.filter("region is null").agg(F.coalesce(F.sum("transaction_count"), F.lit(0)).alias("n")).first()["n"]
    if unmatched:
        warnings.append(
            f"{unmatched} cleaned transaction row(s) had no matching customer; "
            f"their sales remain visible under {UNASSIGNED} and still contribute to salesperson commissions."
        )
    labels = [r["period"] for r in totals.select("period").distinct().collect()]  # one per month
    periods = sorted(labels, key=lambda label: datetime.strptime(label, "%B %Y"))
    regional = materialize(regional_performance(totals, goals, periods))
    matched = match_counts(regional).first()
    if matched["left_only"]:
        warnings.append(f"{matched['left_only']} region(s) with sales had no target; variance and attainment remain unreported.")
    if matched["right_only"]:
        warnings.append(f"{matched['right_only']} target region(s) had no completed sales.")
    commissions = salesperson_commissions(totals)
    assigned = assigned.withColumn("region", F.coalesce("region", F.lit(UNASSIGNED)))
    account = join_diagnostics(clean.frame, regions, JoinSpec(["customer_id"], ["customer_id"], "left"))
    fixed = ["transaction_id", "date", "salesperson", "customer_id", "region", "amount", "discount", "net_sales", "commission", "status"]
    extras = [c for c in transactions.columns if c not in fixed]
    cleaned = assigned.withColumn("commission", F.col("net_sales") * F.lit(rate.value)).select(
        *[ref(c) for c in [*fixed, *extras, "period"]]
    )
    quality = {
        **clean.quality,
        "customer_unmatched_rows": unmatched,
        "actual_regions": matched["matched"] + matched["left_only"],
        "target_regions": matched["matched"] + matched["right_only"],
        "matched_regions": matched["matched"],
        "regions_missing_targets": matched["left_only"],
        "targets_without_sales": matched["right_only"],
    }
    return SalesReport(
        periods, cleaned, regional, commissions, report_facts(regional, commissions), quality, account, rate.value,
        rate.citations, warnings,
    )


def report_tables(report: SalesReport, sources: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The six tables of a report, with formula-like text neutralised."""
    spark = report.regional.sparkSession
    targeted = report.regional.filter(F.col("target").isNotNull())
    summary = (
        report.commissions.groupBy("period")
        .agg(F.sum("net_sales").alias("total_net_sales"), F.sum("commission").alias("total_commission"),
             F.sum("transaction_count").alias("completed_transactions"), F.count(F.lit(1)).alias("salespeople"))
        .join(
            targeted.groupBy("period").agg(
                F.sum("target").alias("total_target"), F.sum("variance").alias("net_variance"),
                F.max("underperformance").alias("largest_shortfall"),
                F.min_by("region", F.struct(-F.col("underperformance"), F.col("region"))).alias("largest_shortfall_region"),
            ),
            "period", "left",
        )
    )
    lines = [("Data quality", k, str(v), "Info") for k, v in report.quality.items()]
    lines += [("Customer join", k, str(v), "Info") for k, v in report.join_account.first().asDict().items() if k != "warning"]
    lines += [("Warning", "attention_required", w, "Warning") for w in report.warnings]
    origin = [(k, v, None) for k, v in (sources or {}).items()]
    origin += [("commission_rate", f"{report.commission_rate * 100:g}%", None), ("periods", ", ".join(report.periods), None)]
    provenance = spark.createDataFrame(origin, "property string, value string, chunk_id string").unionByName(
        report.citations.select(F.lit("commission_policy").alias("property"), F.lit("cited evidence").alias("value"), "chunk_id")
    )
    tables = {
        "executive_summary": summary,
        "regional_performance": report.regional,
        "salesperson_performance": report.commissions,
        "cleaned_transactions": report.cleaned,
        "data_quality": spark.createDataFrame(lines, "category string, metric string, value string, severity string"),
        "provenance": provenance,
    }
    return {name: neutralize_formulas(df) for name, df in tables.items()}
