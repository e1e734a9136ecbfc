"""Files read by byte ranges in which a record may span lines or ranges.

Spark's text reader cuts a file into ranges and gives every chunk (what lies between two separators) to the range in
which it begins. Whether a chunk begins inside a quoted text or an array is not known there. So a first pass gives every
range's state function, what it does to either state that it may begin in, as a row of fixed meaning; these compose
associatively, and one fold over the ranges of each file fixes the state at the start of every range. The second pass
parses each range from that state.

Both passes must see the same ranges. A session of its own pins their size, which otherwise follows the number of
cores; a range that the first pass did not see fails the job. There are at most ``MAX_RANGES`` ranges plus one per
file and ``MAX_RANGES`` files, whatever the size of the input, so their states fit on the driver and in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from auditframe.errors import RefusedError
from auditframe.session import session_with, ship_with_tasks

ship_with_tasks(__name__)

#: Bytes of a range; more where the input would have more than ``MAX_RANGES`` of them.
RANGE_BYTES = 64 << 20
MAX_RANGES = 100_000

Place = tuple[int, int]


def open_ranges(spark: SparkSession, path: str, separator: str, range_bytes: int | None = None) -> DataFrame:
    """(file, start, value): chunks of all files below ``path`` in order, without their separator."""
    listed = spark.read.format("binaryFile").load(path).agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    if listed[0] > MAX_RANGES:
        raise RefusedError(f"More than {MAX_RANGES} files are read below one path; read them in parts.")
    size = max(range_bytes or RANGE_BYTES, -(-listed[1] // MAX_RANGES))
    pinned = session_with(
        spark, {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": 0, "spark.sql.files.minPartitionNum": 1}
    )
    chunks = pinned.read.text(path, lineSep=separator)
    return chunks.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def by_range(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Place, pa.Array]]:
    """The chunks of each batch, cut where the range changes."""
    for batch in batches:
        files, starts, values = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        begin = 0
        for at in [*((files[1:] != files[:-1]) | (starts[1:] != starts[:-1])).nonzero()[0].tolist(), len(files) - 1]:
            if at >= begin:
                yield (int(files[at]), int(starts[at])), values.slice(begin, at + 1 - begin)
                begin = at + 1


def states_at_start(functions: Iterable[tuple[Place, Callable]], first: object) -> dict[Place, object]:
    """The state in which every range begins, from (place, state function) of all ranges."""
    states: dict[Place, object] = {}
    file, state = None, first
    for place, function in sorted(functions, key=lambda x: x[0]):
        if place[0] != file:
            file, state = place[0], first
        states[place] = state
        state = function(state)
    return states


def range_digests(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """(file, start, size, ended, unended): sha256 of the lines that begin in each range, with and without a last line end."""

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, place = [], None
        for at, values in by_range(batches):
            if at != place:
                if place is not None:
                    rows.append((*place, size, digest.hexdigest(), before.hexdigest()))
                place, size, digest = at, 0, hashlib.sha256()
            lines = values.to_pylist()
            text = b"\n".join(lines)
            digest.update(text)
            before = digest.copy()
            digest.update(b"\n")
            size += len(text) + 1
        if place is not None:
            rows.append((*place, size, digest.hexdigest(), before.hexdigest()))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [()] * 5, kinds)], ["file", "start", "size", "ended", "unended"])

    chunks = open_ranges(spark, path, "\n", range_bytes)
    return chunks.mapInArrow(over, "file long, start long, size long, ended string, unended string")
