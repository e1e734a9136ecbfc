"""All registered queries."""

from auditframe.workload import (  # noqa: F401  (importing registers the queries)
    boundaries, documents, joins, metrics, operations, pipelines, quality, runs, sources, windows,
)
from auditframe.workload.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
