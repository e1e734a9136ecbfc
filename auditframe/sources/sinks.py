"""Sinks: checked CSV export, Parquet table sets and integrity manifests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from auditframe.errors import RefusedError
from auditframe.functions.columns import null_safe_equal
from auditframe.functions.scalars import neutralize_formulas
from auditframe.sources.scans import file_fingerprints


#: How exports are written and re-opened; text keeps its line breaks, so rows end at a plain line feed only.
CSV_OPTIONS = {"header": True, "escape": '"', "lineSep": "\n"}


@dataclass(frozen=True)
class Export:
    path: str
    row_count: int
    column_count: int


def export_csv(df: DataFrame, path: str) -> Export:
    """Write a table as CSV with formula-like text neutralised; rows are counted in the same job."""
    seen = Observation()
    safe = neutralize_formulas(df).observe(seen, F.count(F.lit(1)).alias("rows"))
    safe.write.mode("errorifexists").options(**CSV_OPTIONS).csv(path, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return Export(path, seen.get["rows"], len(df.columns))


def check_export(spark: SparkSession, export: Export, expected_columns: list[str]) -> DataFrame:
    """Re-open an export and compare its columns, their order and the row count."""
    reopened = spark.read.options(**CSV_OPTIONS).csv(export.path, multiLine=True)
    rows = reopened.count()
    checks = [
        ("artifact_reopens", True, "CSV artifact reopened successfully."),
        ("artifact_schema", reopened.columns == expected_columns, "Reopened CSV schema/order matches the target."),
        ("artifact_rows", rows == export.row_count, f"Reopened CSV contains {rows} rows."),
    ]
    return spark.createDataFrame(checks, "name string, passed boolean, detail string")


def require_checks(checks: DataFrame) -> None:
    failed = [row["detail"] for row in checks.filter(~F.col("passed")).collect()]
    if failed:
        raise RefusedError("; ".join(failed))


def write_tables(tables: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Write a set of report tables as Parquet directories below one path."""
    written = {}
    for name, df in tables.items():
        written[name] = f"{path}/{name}"
        df.write.mode("errorifexists").parquet(written[name])
    return written


def integrity_findings(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Files that are missing, unexpected, or differ in size or sha256 from a manifest."""
    now = file_fingerprints(spark, path).withColumnsRenamed({"path": "p", "byte_size": "size_now", "sha256": "sha_now"})
    joined = manifest.join(now, null_safe_equal([F.col("path")], [F.col("p")]), "full_outer")
    finding = (
        F.when(F.col("p").isNull(), "missing")
        .when(F.col("path").isNull(), "unexpected")
        .when(F.col("byte_size") != F.col("size_now"), "size_changed")
        .when(F.col("sha256") != F.col("sha_now"), "content_changed")
    )
    return joined.select(F.coalesce("path", "p").alias("path"), finding.alias("finding")).filter("finding is not null")
