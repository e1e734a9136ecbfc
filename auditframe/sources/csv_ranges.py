"""CSV whose quoted texts hold line breaks, read by many tasks per file.

A range of lines either begins between records or inside a quoted field. The first pass finds its state function, whether
it ends inside for each, and keeps no text. With the states at the start of all ranges known, the second pass cuts the
records out of each range, and one more over the ranges whose borders cut a record keeps the pieces of those: the text up
to the end of the record in which the range begins, and an unfinished last record. Spark's own parser reads every record.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from auditframe.errors import RefusedError
from auditframe.session import ship_with_tasks
from auditframe.sources.ranges import Place, by_range, open_ranges, states_at_start

ship_with_tasks(__name__)

_QUOTED = re.compile(rb'(?:[^"]|"")*+')

RANGE = "file long, start long, ends_inside boolean, ends_inside_if_inside boolean"
_PIECES = "file long, start long, part int, text binary"
#: Lines that are Python objects at one time.
STEP_LINES = 1024


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a quoted field is open at the end of ``line``. A quote opens a field only as its first character."""
    if b'"' not in line:
        return inside
    if inside:
        at = _QUOTED.match(line).end()
    elif line[:1] == b'"':
        at = _QUOTED.match(line, 1).end()
    else:
        at = 0
    while at < len(line):
        field = line.find(b',"', at)
        if field < 0:
            return False
        at = _QUOTED.match(line, field + 2).end()
    return True if inside or b'"' in line else False


def _lines(values: pa.Array, crlf: bool) -> Iterator[bytes]:
    for begin in range(0, len(values), STEP_LINES):
        for line in values.slice(begin, STEP_LINES).to_pylist():
            yield line[:-1] if crlf and line[-1:] == b"\r" else line


def _functions(crlf: bool):
    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, place, outside, inside = [], None, False, True
        for at, values in by_range(batches):
            if at != place:
                if place is not None:
                    rows.append((*place, outside, inside))
                place, outside, inside = at, False, True
            for line in _lines(values.filter(pc.match_substring(values, '"')), crlf):  # others change neither state
                outside, inside = ends_inside(line, outside), ends_inside(line, inside)
        if place is not None:
            rows.append((*place, outside, inside))
        kinds = [pa.int64()] * 2 + [pa.bool_()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [()] * 4, kinds)], [x.split()[0] for x in RANGE.split(", ")])

    return over


def given_names(header: list[str | None]) -> list[str]:
    """The names of a header line; an empty one is its position."""
    return [(name or "").lstrip("\ufeff") or f"Unnamed: {i}" for i, name in enumerate(header)]


def _header_of(record: bytes) -> list[str]:
    return given_names(next(csv.reader(io.StringIO(record.decode("utf-8", "replace").lstrip("\ufeff"), newline="")), []))


def _records(inside: dict[Place, bool], header: list[str], crlf: bool):
    """Records that lie in one range; the first of each file is its header, which must be the expected one."""

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, open_lines, state, in_head, at_header = None, [], False, False, False
        for at, values in by_range(batches):
            if at != place:
                if at not in inside:
                    raise ValueError("The ranges of a CSV file changed between its two passes.")
                place, open_lines, state = at, [], inside[at]
                in_head, at_header = state, at[1] == 0
            plain = not (crlf or state or at_header or open_lines or in_head)
            if plain and not pc.any(pc.match_substring(values, '"')).as_py():
                yield pa.RecordBatch.from_arrays([values.filter(pc.greater(pc.binary_length(values), 0))], ["record"])
                continue
            found = []
            for line in _lines(values, crlf):
                state = ends_inside(line, state)
                if in_head:
                    in_head = state
                    continue
                if state or open_lines:
                    open_lines.append(line)
                    if state:
                        continue
                    line, open_lines = b"\n".join(open_lines), []
                if at_header:
                    at_header = False
                    if _header_of(line) != header:
                        raise ValueError(f"A CSV file has another header: {_header_of(line)} instead of {header}.")
                elif line:
                    found.append(line)
                if len(found) == STEP_LINES:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["record"])
                    found = []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["record"])
        if at_header:
            raise ValueError("A CSV header is longer than a range.")

    return over


def _pieces(inside: dict[Place, bool], crossed: set[Place], crlf: bool):
    """What the borders of ranges cut: part 0 is the end of a record that began before, part 1 begins one that goes on."""

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, state, in_head = None, [], False, False

        def piece() -> pa.RecordBatch:
            columns = [[place[0]], [place[1]], [0 if in_head else 1], [b"\n".join(held)]]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], ["file", "start", "part", "text"])

        for at, values in by_range(batches):
            if at != place:
                if held:
                    yield piece()
                place, held, state = at, [], inside[at]
                in_head = state
            if at not in crossed:
                continue
            for line in _lines(values, crlf):
                state = ends_inside(line, state)
                if state or in_head:
                    held.append(line)
                if not state:
                    if in_head:
                        yield piece()
                        in_head = False
                    held = []
        if held:
            yield piece()

    return over


def _across(pieces: DataFrame) -> DataFrame:
    """Records that cross ranges: an unfinished last record and all that follows it up to its end."""
    pieces = pieces.select("file", F.struct("start", "part", "text").alias("piece"))
    begins = F.sum(F.col("piece.part")).over(Window.partitionBy("file").orderBy("piece.start", "piece.part"))
    whole = pieces.withColumn("record", begins).groupBy("file", "record").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    return whole.select(F.array_join(F.transform("pieces", lambda x: x["text"].cast("string")), "\n").cast("binary").alias("record"))


def read_records(spark: SparkSession, path: str, header: list[str], line_sep: str = "\n", range_bytes: int | None = None) -> DataFrame:
    """(record): the text of every record of the CSV files below ``path``, without their headers; empty lines are left out.

    A file whose first line ends in CR and LF has both taken for one line end, also within quotes.
    """
    lines = open_ranges(spark, path, line_sep, range_bytes)
    first = lines.where("start = 0").select("value").first()
    crlf = line_sep == "\n" and first is not None and bytes(first[0]).endswith(b"\r")
    if first is not None and line_sep == "\n" and b"\r" in bytes(first[0])[:-1]:
        raise RefusedError("The CSV text ends its lines with CR alone; name it as line_sep.")
    seen = lines.mapInArrow(_functions(crlf), RANGE).collect()  # one row per range
    inside = states_at_start((((r[0], r[1]), lambda state, r=r: r[3] if state else r[2]) for r in seen), False)
    within = lines.mapInArrow(_records(inside, header, crlf), "record binary")
    crossed = {(r[0], r[1]) for r in seen if inside[r[0], r[1]] or r[2]}
    if not crossed:
        return within
    return within.unionByName(_across(lines.mapInArrow(_pieces(inside, crossed, crlf), _PIECES)))


def parse_records(records: DataFrame, names: list[str]) -> DataFrame:
    """Text columns of the records; a record with another number of fields fails the job."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    options = {"escape": '"', "mode": "FAILFAST", "maxCharsPerColumn": "-1", "maxColumns": str(max(20480, len(names) + 1))}
    parsed = records.select(F.from_csv(F.col("record").cast("string"), schema.simpleString()[7:-1].replace(":", " "), options).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(name) for i, name in enumerate(names)])
