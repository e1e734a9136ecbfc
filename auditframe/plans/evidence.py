"""Rates stated in policy text. Anything but one clear rate is refused."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from auditframe.errors import RefusedError
from auditframe.functions.scalars import collapse_spaces, name_tokens, percent_rates

# Fixed patterns: how a commission rate is stated, and the only supported policy sentence.
COMMISSION_RATE = r"(?i)commission rate(?: of| is)?\s*(\d+(?:\.\d+)?)\s*%"
SUPPORTED_POLICY = (
    r"(?i)^(?:Monthly commission policy:\s*)?Salespeople earn a commission rate(?: of| is)?\s*"
    r"\d+(?:\.\d+)?\s*% of completed net sales after discounts\.?$"
)


@dataclass(frozen=True)
class Rate:
    value: float
    citations: DataFrame


def commission_rate(evidence: DataFrame) -> Rate:
    """The one flat commission rate of (chunk_id, text) evidence."""
    found = F.transform(F.regexp_extract_all("text", F.lit(COMMISSION_RATE), 1), lambda t: t.cast("double"))
    row = evidence.agg(
        F.min(F.array_min(found)).alias("low"),
        F.max(F.array_max(found)).alias("high"),
        F.count_if(~collapse_spaces(F.col("text")).rlike(SUPPORTED_POLICY)).alias("unsupported"),
    ).first()
    if row["low"] is None:
        raise RefusedError("Commission policy evidence does not establish a commission rate.", "insufficient_evidence")
    if row["low"] != row["high"]:
        raise RefusedError("Commission policy evidence contains conflicting rates.", "conflicting_evidence")
    if row["unsupported"]:
        raise RefusedError(
            "Unsupported or ambiguous commission policy: require one flat rate of completed net sales after discounts.",
            "insufficient_evidence",
        )
    value = row["low"] / 100
    if not 0 <= value <= 1:
        raise RefusedError("Commission rate must be between 0 and 100 percent.")
    cited = evidence.filter(F.size(found) > 0).select("chunk_id").distinct()
    return Rate(value, cited)


def relevant_evidence(evidence: DataFrame, query: str) -> DataFrame:
    """Evidence sharing a word with the query; a query without words accepts all."""
    words = F.array_distinct(name_tokens(F.lit(query)))
    return evidence.filter((F.size(words) == 0) | F.arrays_overlap(words, name_tokens(F.col("text"))))


def policy_rate(evidence: DataFrame, query: str) -> Rate:
    """The one percentage that relevant evidence states."""
    relevant = relevant_evidence(evidence, query)
    rates = percent_rates(F.col("text"))
    row = relevant.agg(
        F.count(F.lit(1)).alias("relevant"), F.min(F.array_min(rates)).alias("low"), F.max(F.array_max(rates)).alias("high")
    ).first()
    if not row["relevant"]:
        raise RefusedError("Retrieved policy evidence does not support the requested derivation.", "insufficient_evidence")
    if row["low"] is None or row["low"] != row["high"] or not 0 <= row["low"] <= 1:
        raise RefusedError("Policy evidence must establish exactly one unambiguous percentage rate.", "conflicting_evidence")
    return Rate(row["low"], relevant.select("chunk_id").distinct())
