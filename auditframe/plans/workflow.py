"""Whole table workflows: operations around an audited join, and bounded previews."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from auditframe.operators.joins import Joined, join_datasets
from auditframe.operators.transforms import apply_operations
from auditframe.plans.specs import JoinSpec

PREVIEW_ROWS = 200


def join_workflow(
    left: DataFrame, right: DataFrame, join: JoinSpec, left_operations: list = (), right_operations: list = (),
    operations: list = (),
) -> Joined:
    """Operations on both sides, the join with its row accounting, operations on the result."""
    joined = join_datasets(apply_operations(left, list(left_operations)), apply_operations(right, list(right_operations)), join)
    return Joined(apply_operations(joined.frame, list(operations)), joined.diagnostics)


@dataclass(frozen=True)
class Preview:
    rows: DataFrame
    row_count: int
    columns: list[str]


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> Preview:
    """The first rows for display, next to the true row count."""
    return Preview(df.limit(rows), df.count(), df.columns)
