"""Session building, the shared work folder and lineage cutting."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from auditframe.errors import RefusedError


def build_session(app_name: str = "auditframe", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the library relies on; a cluster's own settings stay untouched."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def work_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediates.

    ``spark.checkpoint.dir`` names it, or the checkpoint folder that the context already has. Only a
    local session may fall back to a folder of its own; on a cluster a machine-local folder would not
    survive a lost node.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured is None:
        if not context.master.startswith("local"):
            raise RefusedError("Set spark.checkpoint.dir to a shared folder before running on a cluster.")
        configured = tempfile.mkdtemp(prefix="auditframe-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(work_root(spark), "auditframe", f"{label}-{uuid.uuid4().hex}")


def session_with(spark: SparkSession, settings: dict[str, object]) -> SparkSession:
    """A session of its own with the settings of ``spark``, except for those given."""
    session = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            session.conf.set(name, value)
    for name, value in settings.items():
        session.conf.set(name, str(value))
    return session


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint.

    Used where one result is both inspected (refusal checks) and returned, so that the
    input is scanned once, and where later steps need the very same partitions again.
    """
    work_root(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_with_tasks(module_name: str) -> None:
    """Send a module's functions along with the tasks that call them.

    Executors then need no copy of this package on their path.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
