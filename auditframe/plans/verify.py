"""Checking stated values against computed facts, and aggregating scored results and call usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from auditframe.errors import RefusedError
from auditframe.functions.columns import require_columns
from auditframe.functions.scalars import is_close, sum_available
from auditframe.operators.quantiles import grouped_percentiles, join_on_keys, sketches
from auditframe.session import materialize

PRECEDENCE = ("failed", "conflicting", "unsupported", "insufficient_evidence")


# ---- claims -----------------------------------------------------------------------------------


def verify_claims(claims: DataFrame, facts: DataFrame, sources: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """One finding per claim: verified, unsupported or insufficient_evidence.

    ``claims``: claim_id, kind (numeric or document), value, unit, evidence_keys, source_ids.
    ``facts``: key, value, unit as observed - a key observed twice is ambiguous.
    ``sources``: source_id as observed. ``values``: numbers a claim without keys may match, used
    only when there are no named facts at all.
    """
    require_columns(claims, ["claim_id", "kind", "value", "unit", "evidence_keys", "source_ids"], "claims")
    known = facts.groupBy("key").agg(
        F.max("value").alias("fact_value"),
        F.min(F.lower("unit")).alias("fact_unit"),
        ((F.count("value") > 1) | (F.min(F.lower("unit")) != F.max(F.lower("unit")))).alias("ambiguous"),
    )
    keyed = claims.select("claim_id", "value", F.lower("unit").alias("unit"), F.explode("evidence_keys").alias("key"))
    commission = F.col("key").startswith("commission.") | (F.col("key") == "total.commission")
    found = F.col("fact_value").isNotNull()
    per_claim = keyed.join(known, "key", "left").groupBy("claim_id").agg(
        F.coalesce(F.max("ambiguous"), F.lit(False)).alias("ambiguous"),
        F.count_if(~found).alias("missing"),
        F.coalesce(F.min(is_close(F.col("value"), F.col("fact_value"))), F.lit(False)).alias("matches"),
        F.min("fact_unit").alias("unit_low"),
        F.max("fact_unit").alias("unit_high"),
        F.max(commission).alias("commission"),
    )
    cited = _citation_state(claims, sources)
    state = claims.join(per_claim, "claim_id", "left").join(cited, "claim_id", "left")
    if values is not None and not facts.limit(1).count():
        state = state.join(_loose_matches(claims, values), "claim_id", "left")
    else:
        state = state.withColumn("loose", F.lit(False))
    unit_ok = F.col("unit_low").isNull() | (
        (F.col("unit_low") == F.col("unit_high")) & F.coalesce(F.lower("unit") == F.col("unit_low"), F.lit(False))
    )
    with_keys = F.col("matches").isNotNull()
    match = F.when(with_keys, F.col("matches") & (F.col("missing") == 0)).otherwise(F.coalesce("loose", F.lit(False)))
    cited_ok = F.coalesce("observed", F.lit(False))
    grounded = ~F.coalesce("commission", F.lit(False)) | cited_ok
    # The value test of a partly resolved claim does not require every key to be known.
    value_match = F.when(with_keys, F.col("matches")).otherwise(F.coalesce("loose", F.lit(False)))
    numeric = (
        F.when(F.coalesce("ambiguous", F.lit(False)), "unsupported")
        .when(match & grounded & unit_ok, "verified")
        .when(match & ~unit_ok, "unsupported")
        .when(value_match & ~grounded, "insufficient_evidence")
        .otherwise("unsupported")
    )
    document = F.when(cited_ok, "verified").when(F.coalesce("cited", F.lit(0)) == 0, "insufficient_evidence").otherwise("unsupported")
    return state.select("claim_id", "kind", F.when(F.col("kind") == "numeric", numeric).otherwise(document).alias("status"))


def _citation_state(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Per claim: the number of cited ids and whether all of them were observed."""
    cited = claims.select("claim_id", F.explode("source_ids").alias("source_id"))
    seen = sources.select("source_id").distinct().withColumn("seen", F.lit(True))
    joined = cited.join(seen, "source_id", "left")
    return joined.groupBy("claim_id").agg(F.count(F.lit(1)).alias("cited"), F.min(F.coalesce("seen", F.lit(False))).alias("observed"))


def _loose_matches(claims: DataFrame, values: DataFrame) -> DataFrame:
    """Claims without keys that are close to any value.

    The tolerance is absolute below 1000 and relative above, so numbers are bucketed on a linear
    scale there and on a logarithmic one beyond; neighbours in adjacent buckets join by equality.
    """

    def bucket(v: Column) -> Column:
        linear = F.floor(v * 1e5)
        logarithmic = F.signum(v).cast("long") * (F.floor(F.log(F.greatest(F.abs(v), F.lit(1.0))) * 1e8) + F.lit(10**12))
        return F.when(F.abs(v) < 1000, linear).otherwise(logarithmic)

    c = claims.filter((F.size("evidence_keys") == 0) & F.col("value").isNotNull()).select("claim_id", "value")
    around = F.array_distinct(
        F.concat(*[F.array(bucket(F.col("value") + d * F.greatest(F.abs("value") * 2e-9, F.lit(2e-6)))) for d in (-1, 0, 1)])
    )
    probes = c.select("claim_id", "value", F.explode(around).alias("b"))
    observed = values.select(F.col("value").cast("double").alias("observed")).filter("observed is not null").distinct()
    joined = probes.join(observed.withColumn("b", bucket(F.col("observed"))), "b")
    return joined.filter(is_close(F.col("value"), F.col("observed"))).select("claim_id", F.lit(True).alias("loose")).distinct()


def overall_status(findings: DataFrame, warnings: int = 0) -> DataFrame:
    """One row: the worst status by precedence, or verified (with warnings)."""
    rank = F.lit(len(PRECEDENCE))
    for i, status in reversed(list(enumerate(PRECEDENCE))):
        rank = F.when(F.col("status") == status, i).otherwise(rank)
    worst = findings.agg(F.min(rank).alias("r"), F.count_if(F.col("status") == "verified").alias("v"))
    named = F.element_at(F.array(*[F.lit(s) for s in PRECEDENCE]), F.col("r") + 1)
    clean = F.when(F.col("v") == 0, "insufficient_evidence").otherwise("verified_with_warnings" if warnings else "verified")
    return worst.select(F.when(F.col("r") < len(PRECEDENCE), named).otherwise(clean).alias("status"))


# ---- scored results and usage -----------------------------------------------------------------


def score_results(results: DataFrame, checks: list[str], counters: list[str] = ()) -> DataFrame:
    """One row: passed and failed cases, success rate, the rate of every boolean check, summed counters."""
    require_columns(results, ["passed", *checks, *counters], "results")
    return results.agg(
        F.count(F.lit(1)).alias("completed_case_count"),
        F.count_if("passed").alias("passed_count"),
        F.count_if(~F.col("passed")).alias("failed_count"),
        F.avg(F.col("passed").cast("double")).alias("task_success_rate"),
        *[F.avg(F.col(c).cast("double")).alias(f"rate_{c}") for c in checks],
        *[F.sum(c).alias(c) for c in counters],
    )


def call_usage(
    calls: DataFrame, group_by: list[str], input_cost_per_million: float, output_cost_per_million: float
) -> DataFrame:
    """Per group: latency total, mean, median and nearest-rank p95; token sums that are null when
    any call lacks them; cost from the token sums."""
    require_columns(calls, [*group_by, "latency_ms", "input_tokens", "output_tokens"], "calls")
    tokens_in, tokens_out = sum_available(F.col("input_tokens")), sum_available(F.col("output_tokens"))
    wanted = [("latency_ms_median", "latency_ms", 50.0), ("latency_ms_p95", "latency_ms", 95.0)]
    base = calls.groupBy(*group_by).agg(
        F.count(F.lit(1)).alias("measured_call_count"),
        F.sum("latency_ms").alias("latency_ms_total"),
        F.avg("latency_ms").alias("latency_ms_mean"),
        tokens_in.alias("input_tokens"),
        tokens_out.alias("output_tokens"),
        ((tokens_in * F.lit(input_cost_per_million) + tokens_out * F.lit(output_cost_per_million)) / 1_000_000).alias("cost"),
        *sketches(calls, wanted),
    )
    base = materialize(base)
    found = grouped_percentiles(calls, group_by, wanted, nearest_rank=["latency_ms_p95"], sketched=base)
    shown = base.select(*[c for c in base.columns if not c.startswith("__")])
    return join_on_keys(shown, found, group_by, "left")


def judgement_mean(results: DataFrame, judgements: DataFrame, key: str = "case_id") -> DataFrame:
    """Mean human score and whether every case is judged; unknown or repeated case ids are refused."""
    if judgements.groupBy(key).count().filter("count > 1").limit(1).count():
        raise RefusedError("Human judgment case IDs must be unique.")
    unknown = judgements.join(results.select(key), key, "left_anti").limit(1).collect()
    if unknown:
        raise RefusedError(f"Human judgments name unknown cases: {unknown[0][key]}.")
    joined = results.select(key).join(judgements.select(key, "score"), key, "left")
    scored = F.count("score")
    status = F.when(scored == 0, "not_supplied").when(scored < F.count(F.lit(1)), "partial").otherwise("complete")
    return joined.agg(status.alias("status"), F.avg("score").alias("mean_score"), scored.alias("scored_case_count"))
