"""Score still required in a final, for any number of gradebooks at once."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from auditframe.errors import RefusedError
from auditframe.functions.columns import require_columns
from auditframe.functions.scalars import strip


@dataclass(frozen=True)
class GradePolicy:
    target: float
    final_weight: float


def _policy_patterns(letter: str) -> tuple[str, str, str]:
    """Fixed patterns: a letter's threshold in both word orders, and the weight of the final."""
    name = re.escape(letter)
    return (
        rf"(?i)\b{name}\b[^.\n]{{0,80}}?(?:at least|minimum(?: of)?|requires?)\s*(\d+(?:\.\d+)?)\s*%",
        rf"(?i)(?:at least|minimum(?: of)?)\s*(\d+(?:\.\d+)?)\s*%[^.\n]{{0,50}}?\b{name}\b",
        r"(?i)final(?: exam)?[^.\n]{0,80}?(\d+(?:\.\d+)?)\s*%",
    )


def grade_policy(evidence: DataFrame, letter: str = "A") -> GradePolicy:
    """Threshold and final weight from policy text; conflicting or missing statements are refused."""
    forward, backward, final = (
        F.transform(F.regexp_extract_all("text", F.lit(p), 1), lambda t: t.cast("double")) for p in _policy_patterns(letter)
    )
    targets = F.concat(forward, backward)
    row = evidence.agg(
        F.min(F.array_min(targets)).alias("t1"), F.max(F.array_max(targets)).alias("t2"),
        F.min(F.array_min(final)).alias("f1"), F.max(F.array_max(final)).alias("f2"),
    ).first()
    if row["t1"] != row["t2"] or row["f1"] != row["f2"]:
        raise RefusedError("Policy evidence contains conflicting thresholds or final-exam weights.", "conflicting_evidence")
    if row["t1"] is None or row["f1"] is None:
        raise RefusedError("The evidence does not establish both the target and the final-exam weight.", "insufficient_evidence")
    if not (0 <= row["f1"] <= 100 and 0 <= row["t1"] <= 100):
        raise RefusedError("Policy percentages must be between 0 and 100.")
    return GradePolicy(row["t1"], row["f1"])


def required_finals(grades: DataFrame, policy: GradePolicy, student: str = "student_id") -> DataFrame:
    """Per student: the completed contribution, the required final score and a status.

    A gradebook that cannot be computed gets status ``invalid`` and the reason, so that one bad
    gradebook does not block the others.
    """
    require_columns(grades, [student, "category", "score", "weight"], "grades")
    category = F.lower(strip(F.col("category").cast("string")))
    score, weight = F.col("score").try_cast("double"), F.col("weight").try_cast("double")
    final = F.coalesce(category.rlike("\\bfinal(?: exam)?\\b"), F.lit(False))
    per_student = grades.groupBy(student).agg(
        F.count_if(final).alias("finals"),
        F.sum(F.when(final, weight)).alias("final_weight"),
        F.count_if(~final & (score.isNull() | weight.isNull())).alias("gaps"),
        F.count_if(~final & ((weight < 0) | (score < 0) | (score > 100))).alias("out_of_range"),
        F.coalesce(F.sum(F.when(~final, weight)), F.lit(0.0)).alias("other_weight"),
        F.coalesce(F.sum(F.when(~final, score * weight / 100)), F.lit(0.0)).alias("contribution"),
    )
    total = F.col("other_weight") + F.col("final_weight")
    reason = (
        F.when(F.col("finals") != 1, "Grade dataset must contain exactly one final-exam category.")
        .when(F.col("final_weight").isNull(), "The final-exam weight is missing.")
        .when(F.abs(F.col("final_weight") - policy.final_weight) > 1e-9, "conflict")
        .when(F.col("gaps") > 0, "Completed grade categories require numeric scores and weights.")
        .when(F.col("out_of_range") > 0, "Scores must be 0-100 and weights cannot be negative.")
        .when(F.abs(total - 100) > 1e-6, "Grade category weights must total 100 percent.")
    )
    if policy.final_weight == 0:
        required = F.when(F.col("contribution") >= policy.target, F.lit(0.0))
        outcome = F.when(F.col("contribution") >= policy.target, "already_guaranteed").otherwise("impossible")
    else:
        required = (F.lit(policy.target) - F.col("contribution")) / (policy.final_weight / 100)
        outcome = F.when(required > 100, "impossible").when(required <= 0, "already_guaranteed").otherwise("required")
    valid = F.col("reason").isNull()
    return per_student.withColumn("reason", reason).select(
        student,
        F.when(valid, outcome).when(F.col("reason") == "conflict", "conflicting_evidence").otherwise("invalid").alias("status"),
        F.when(valid, F.round("contribution", 6)).alias("completed_contribution"),
        F.when(valid, F.round(required, 6)).alias("required_final_percentage"),
        F.when(F.col("reason") == "conflict", "The dataset final weight conflicts with the grading policy.")
        .otherwise(F.col("reason")).alias("reason"),
    )
