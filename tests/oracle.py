"""Run registered queries next to their SQL and compare rows; usable from pytest and by hand.

    python tests/oracle.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(value):
        if value is None:
            return "~"
        if isinstance(value, bool):
            return str(value)
        if isinstance(value, float):
            return repr(value + 0.0)
        if isinstance(value, int):
            return str(value)
        return str(value)

    return sorted(tuple(text(r[i]) for i in order) for r in records), [columns[i] for i in order]


def compare(spark, con, name, function, sql, sf_dir):
    """None when both sides agree, otherwise a description of the difference."""
    df = function(spark, sf_dir)
    mine, my_columns = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if mine else "no rows"
    cursor = con.execute(sql)
    theirs, their_columns = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if my_columns != their_columns:
        return f"columns {my_columns} != {their_columns}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(wrong)} of {len(mine)} rows differ, first: {wrong[0][0]} != {wrong[0][1]}"[:1500] if wrong else None


def main() -> None:
    from auditframe.session import build_session
    from auditframe.workload import QUERIES, SQL

    sf_dir, wanted = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session("oracle", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            found = compare(spark, con, name, QUERIES[name], SQL.get(name), sf_dir)
        except Exception:
            found = traceback.format_exc()[-1800:]
        bad += found is not None
        print(f"{'ok ' if found is None else 'BAD'} {time.time() - start:6.2f}s {name} {found or ''}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")


if __name__ == "__main__":
    main()
