"""A saved plan over a growing folder: files that drift are named, and only changed periods are computed again.

The folder is partitioned by period. Its state is one row per file (period, path, size, time of change), listed without
opening a file. Files that are new or changed since the last refresh have their schema compared with the contract, from
their footers; one that differs is refused by name, and nothing is stored. The periods of such files, and periods that
lost a file, are read again, which is a partition filter on the folder; the results of all others are taken over.

Every refresh writes a version of its own, the results and the listing, and then the mark that makes it count and that
only one refresh can create. A refresh that dies in between leaves the version before it in place.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from auditframe.errors import RefusedError
from auditframe.plans.analytics import run_plan
from auditframe.plans.runlog import SharedFiles
from auditframe.plans.runs import Contract, DriftError, DriftFinding
from auditframe.plans.specs import AnalyticsPlan

#: Footers read at a time.
FOOTERS_AT_ONCE = 16
KEYED_ANALYSES = ("metrics", "group_compare", "target_variance")


def list_files(spark: SparkSession, path: str, period: str) -> DataFrame:
    """(period, path, byte_size, changed_at) of the Parquet files below ``path``/``period``=…; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    # Spark writes a period that is missing as a fixed folder name, which reads as text like any other here.
    named = F.regexp_extract("path", f"/{period}=([^/]*)/", 1)
    return files.select(named.alias("period"), "path", F.col("length").alias("byte_size"), F.col("modificationTime").alias("changed_at"))


def check_files(spark: SparkSession, paths: list[str], contract: Contract, period: str, input_key: str = "step.1.input") -> None:
    """Refuse the first file, by name, whose columns, their order or types differ from the contract's."""
    expected = [(c, contract.types.get(c)) for c in contract.columns if c != period]

    def found(path: str) -> tuple[str, list]:
        return path, [(f.name, f.dataType.simpleString()) for f in spark.read.parquet(path).schema.fields if f.name != period]

    with ThreadPoolExecutor(FOOTERS_AT_ONCE) as pool:
        for path, fields in pool.map(found, sorted(paths)):
            if fields != expected:
                kind = "schema" if [n for n, _ in fields] != [n for n, _ in expected] else "type"
                text = f"File {path} holds {fields} instead of {expected}."
                raise DriftError(DriftFinding(kind, input_key, "incompatible", text))


class PeriodStore:
    """Results of one plan by period, refreshed from a folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.files = SharedFiles(spark, self.root)

    def _version(self) -> int:
        """The newest version that counts; 0 without one."""
        return max((int(name) for name in self.files.names("versions")), default=0)

    def results(self) -> DataFrame:
        """The stored results of all periods."""
        version = self._version()
        if not version:
            raise RefusedError("Nothing has been computed yet.")
        return self.spark.read.parquet(f"{self.root}/results/{version}")

    def refresh(self, path: str, plan: AnalyticsPlan, period: str, contract: Contract) -> list[str]:
        """Bring the results up to date with the folder; returns the periods that were computed."""
        if plan.analysis not in KEYED_ANALYSES:
            raise RefusedError(f"Analysis '{plan.analysis}' cannot be keyed by period.")
        now, version = list_files(self.spark, path, period), self._version()
        before = self.spark.read.parquet(f"{self.root}/files/{version}") if version else now.limit(0)
        renamed = before.withColumnsRenamed({c: f"old_{c}" for c in before.columns})
        both = now.join(renamed, (F.col("path") == F.col("old_path")) & (F.col("period") == F.col("old_period")), "full_outer")
        differs = F.col("path").isNull() | F.col("old_path").isNull() | (F.col("byte_size") != F.col("old_byte_size")) | (F.col("changed_at") != F.col("old_changed_at"))
        changed = both.where(differs).select(F.coalesce("period", "old_period").alias("period"), "path").collect()  # of the changed files only
        check_files(self.spark, [r["path"] for r in changed if r["path"] is not None], contract, period)
        periods = sorted({r["period"] for r in changed})
        if not periods:
            return []
        text = T.StructType([T.StructField(c, T._parse_datatype_string(contract.types[c])) for c in contract.columns if c != period])
        rows = self.spark.read.schema(text.add(period, T.StringType())).option("basePath", path).parquet(path)
        parts = []
        if [r for r in now.where(F.col("period").isin(periods)).limit(1).collect()]:
            keyed = replace(plan, group_by=[period, *[k for k in plan.group_by if k != period]], expected_columns=[])
            parts.append(run_plan(rows.where(F.col(period).isin(periods)), keyed, "recurring").table)
        if version:
            parts.append(self.results().where(~F.col(period).isin(periods)))
        whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        whole.write.mode("overwrite").parquet(f"{self.root}/results/{version + 1}")
        now.write.mode("overwrite").parquet(f"{self.root}/files/{version + 1}")
        if not self.files.create(f"versions/{version + 1}", ""):
            raise RefusedError("Another refresh was finished in the meantime.")
        return periods
