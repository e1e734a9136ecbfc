"""The run log: saved runs never change, one commit per id, and readers open only what they need.

A save writes its tables below a folder of its own attempt. Then it creates the commit of its run id, a small file that
names the attempt and that can be created only once: whoever is second is refused, and what it wrote is never read. An
attempt that dies before its commit leaves nothing but such a folder, and the id can be saved again.

    attempts/<attempt>/<table>/        tables of one attempt, as Parquet
    commits/<run>                      create-only; names attempt, workflow and tables
    loose/<workflow>/<attempt>/        the run's row, for the history
    segments/<workflow>/<number>/      compacted rows of many runs, in order of their start
    ranges/<workflow>/<number>         create-only; first and last start of a segment and its number of runs

Looking up a run reads its commit and its own folder. A page of the history reads the loose rows of its workflow and
those segments whose range of starts can hold rows of the page.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from auditframe.errors import RefusedError
from auditframe.plans import runs

RUN_TABLES = ("facts", "inputs", "missing", "categories", "category_values", "diagnostics", "warnings", "steps")
RUN_SCHEMA = (
    "run_id string, workflow_id string, version int, status string, error string, started_at timestamp, "
    "completed_at timestamp, verification string, fact_count long, warning_count long, "
    "drift_kind string, drift_explanation string"
)
LOOSE_SCHEMA = f"{RUN_SCHEMA}, attempt string"
COMPARED = {
    "metrics": ("facts", runs.metric_changes), "inputs": ("inputs", runs.input_changes), "row_counts": ("inputs", runs.row_count_changes),
    "duplicates": ("inputs", runs.duplicate_changes), "missing": ("missing", runs.missing_changes),
    "unique_counts": ("categories", runs.unique_count_changes), "categories": ("categories", runs.category_changes),
    "category_values": ("category_values", runs.category_value_changes), "warnings": ("warnings", runs.warning_changes),
    "diagnostics": ("diagnostics", runs.diagnostic_changes), "steps": ("steps", runs.step_changes),
}


class SharedFiles:
    """Small files in the shared folder, through Hadoop's file system API."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(root)
        self.system = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def create(self, name: str, text: str) -> bool:
        """Create a file with ``text``; False if there is one. Only one of several callers succeeds."""
        path = self._path(name)
        self.system.mkdirs(path.getParent())
        if self.system.getUri().getScheme() == "file":
            # Plain creation is no single step here; a hard link is, and is made only if its name is free.
            aside = self._path(f"aside/{uuid.uuid4().hex}")
            self._write(aside, text)
            files, paths = self.jvm.java.nio.file.Files, self.jvm.java.nio.file.Path
            try:
                files.createLink(*[paths.of(self.jvm.java.net.URI.create(f"file://{p.toUri().getPath()}")) for p in (path, aside)])
                return True
            except Exception as exc:
                if "FileAlreadyExists" in str(exc):
                    return False
                raise
            finally:
                self.system.delete(aside, False)
        try:
            stream = self.system.create(path, False)
        except Exception as exc:
            if "AlreadyExists" in str(exc) or "already exists" in str(exc):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def _write(self, path, text: str) -> None:
        stream = self.system.create(path, True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def read(self, name: str) -> str | None:
        path = self._path(name)
        if not self.system.exists(path):
            return None
        stream = self.system.open(path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        found = [s.getPath().getName() for s in self.system.listStatus(path)] if self.system.exists(path) else []
        return sorted(name for name in found if not name.startswith("."))

    def remove(self, folder: str) -> None:
        self.system.delete(self._path(folder), True)


def _key(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:32]


class RunLog:
    """Append-only: ``save``, ``table`` of one run, ``page`` of a workflow's history, ``compare`` two runs."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.files = SharedFiles(spark, self.root)

    # ---- saving

    def save(self, run_id: str, workflow_id: str, version: int = 1, status: str = "completed", error: str | None = None,
             started_at: datetime | None = None, drift: runs.DriftFinding | None = None, warnings: list[str] = (),
             **tables: DataFrame) -> None:
        """Save a run. A run that failed or was blocked keeps its finding but no facts; a saved id is refused."""
        if self.commit_of(run_id) is not None:
            raise self._recorded(run_id)
        unknown = sorted(set(tables) - set(RUN_TABLES))
        if unknown:
            raise RefusedError(f"Unknown run table(s): {', '.join(unknown)}.")
        if status != "completed" and "facts" in tables:
            raise RefusedError("A run that did not complete has no facts.")
        attempt = uuid.uuid4().hex
        if warnings:
            tables["warnings"] = self.spark.createDataFrame([(w,) for w in warnings], "warning string")
        for name, df in tables.items():
            keyed = df.withColumn("workflow_id", F.lit(workflow_id)).withColumn("run_id", F.lit(run_id))
            keyed.write.parquet(f"{self.root}/attempts/{attempt}/{name}")
        facts = self.spark.read.parquet(f"{self.root}/attempts/{attempt}/facts").count() if "facts" in tables else 0
        now = datetime.now(timezone.utc)
        row = (
            run_id, workflow_id, version, status, error, started_at or now, now,
            runs.verification_status(facts, len(warnings), status != "completed"), facts, len(warnings),
            drift.kind if drift else None, drift.explanation if drift else None,
        )
        self.spark.createDataFrame([row], RUN_SCHEMA).withColumn("attempt", F.lit(attempt)).write.parquet(f"{self.root}/loose/{_key(workflow_id)}/{attempt}")
        commit = {"attempt": attempt, "run_id": run_id, "workflow_id": workflow_id, "status": status, "tables": sorted(tables)}
        if not self.files.create(f"commits/{_key(run_id)}", json.dumps(commit)):
            raise self._recorded(run_id)

    @staticmethod
    def _recorded(run_id: str) -> RefusedError:
        return RefusedError(f"Run '{run_id}' is already recorded; saved runs are immutable.")

    # ---- single runs

    def commit_of(self, run_id: str) -> dict | None:
        text = self.files.read(f"commits/{_key(run_id)}")
        return json.loads(text) if text else None

    def table(self, name: str, run_id: str) -> DataFrame | None:
        """One table of one run, read from the run's own folder; None if the run has none."""
        commit = self.commit_of(run_id)
        if commit is None:
            raise RefusedError(f"Run '{run_id}' is not recorded.")
        return self.spark.read.parquet(f"{self.root}/attempts/{commit['attempt']}/{name}") if name in commit["tables"] else None

    def completed_pair(self, previous: str, current: str) -> None:
        """Only two distinct completed runs of one workflow compare."""
        if previous == current:
            raise RefusedError("Select two distinct workflow runs to compare.")
        found = [self.commit_of(x) for x in (previous, current)]
        if None in found:
            raise RefusedError("Both runs must be recorded.")
        if found[0]["workflow_id"] != found[1]["workflow_id"]:
            raise RefusedError("Only runs of the same workflow can be compared.")
        if any(x["status"] != "completed" for x in found):
            raise RefusedError("Only completed workflow runs can be compared.")

    def compare(self, previous: str, current: str) -> dict[str, DataFrame]:
        """All change tables of two runs; a table that only one of them has is compared with an empty one."""
        self.completed_pair(previous, current)
        results = {}
        for label, (name, compare) in COMPARED.items():
            pair = self.table(name, previous), self.table(name, current)
            there = next((df for df in pair if df is not None), None)
            if there is not None:
                results[label] = compare(*[there.limit(0) if df is None else df for df in pair])
        return results

    # ---- history

    def page(self, workflow_id: str, limit: int = 20, offset: int = 0) -> DataFrame:
        """Newest runs first, with their ``position`` in the whole history, from 0."""
        newest = self._history(workflow_id, offset + limit).orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(offset + limit)
        rows = newest.collect()[offset:]  # at most the page and what is before it
        return self.spark.createDataFrame([(*row, offset + i) for i, row in enumerate(rows)], f"{RUN_SCHEMA}, position long")

    def compact(self, workflow_id: str) -> int:
        """Gather the loose rows of a workflow in a new segment; returns their number.

        The segment counts once its range is written; only then do the loose rows go. A row that is in
        both, or in two segments of compactions at once, is read once.
        """
        loose = self._loose(workflow_id)
        if not loose:
            return 0
        number = uuid.uuid4().hex
        rows = self.spark.createDataFrame(loose, LOOSE_SCHEMA)
        rows.orderBy("started_at", "run_id").write.parquet(f"{self.root}/segments/{_key(workflow_id)}/{number}")
        starts = [r["started_at"].timestamp() for r in loose]
        self.files.create(f"ranges/{_key(workflow_id)}/{number}", json.dumps({"first": min(starts), "last": max(starts), "n": len(loose)}))
        for r in loose:
            self.files.remove(f"loose/{_key(workflow_id)}/{r['attempt']}")
        return len(loose)

    def segments_for(self, workflow_id: str, newest: int) -> list[str]:
        """The segments that the ``newest`` runs can lie in."""
        folder = f"ranges/{_key(workflow_id)}"
        found = [(json.loads(self.files.read(f"{folder}/{name}")), name) for name in self.files.names(folder)]
        found.sort(key=lambda x: (-x[0]["last"], x[1]))
        taken, rows, floor = [], 0, float("inf")
        for entry, name in found:
            if rows >= newest and entry["last"] < floor:
                break
            taken.append(name)
            if rows < newest:
                rows, floor = rows + entry["n"], min(floor, entry["first"])
        return taken

    def _loose(self, workflow_id: str) -> list[Row]:
        """Rows that no compaction has gathered yet; an attempt that did not become its run's commit has none."""
        folder = f"loose/{_key(workflow_id)}"
        attempts = self.files.names(folder)
        if not attempts:
            return []
        rows = self.spark.read.schema(LOOSE_SCHEMA).parquet(*[f"{self.root}/{folder}/{a}" for a in attempts]).collect()
        return [r for r in rows if (self.commit_of(r["run_id"]) or {}).get("attempt") == r["attempt"]]

    def _history(self, workflow_id: str, newest: int) -> DataFrame:
        loose = self.spark.createDataFrame(self._loose(workflow_id), LOOSE_SCHEMA)  # before the segments, as rows move there
        segments = [f"{self.root}/segments/{_key(workflow_id)}/{name}" for name in self.segments_for(workflow_id, newest)]
        whole = loose.unionByName(self.spark.read.schema(LOOSE_SCHEMA).parquet(*segments)) if segments else loose
        return whole.dropDuplicates(["attempt"]).drop("attempt")
