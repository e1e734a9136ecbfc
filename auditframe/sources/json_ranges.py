"""Large JSON arrays read by many tasks: elements of one file are cut out of its byte ranges.

Files are cut at commas. What a range does to its reader's state is a pair, whether it flips "inside a string" and by how
much it changes the bracket depth under either assumption; these compose associatively, so the first pass fixes both at
every range's start. The second pass finds the members of wrapping objects, which name the array, and the third cuts
the array's elements at the commas of its depth. Within a range all of this is array arithmetic on its bytes: quotes that
no backslash escapes, their running parity, and running sums of brackets outside strings. An element that crosses ranges
is put together from its pieces.

The elements are staged as one JSON text a line, which Spark's reader splits, checks and types.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType

from auditframe.errors import RefusedError
from auditframe.session import materialize, ship_with_tasks, work_path
from auditframe.sources.ranges import Place, by_range, open_ranges

ship_with_tasks(__name__)

#: Bytes of a range; a task holds a few arrays of this many numbers.
JSON_RANGE_BYTES = 16 << 20
QUOTE, BACKSLASH, COMMA, OPENING, CLOSING = 34, 92, 44, (91, 123), (93, 125)
_SPACE = b" \t\r\n"
_MEMBER = re.compile(rb'\s*("(?:[^"\\]|\\.)*+")\s*:\s*(\[?)\s*(.?)', re.S)


def joined(values: pa.Array) -> bytes:
    """The chunks of a range with a comma behind each, as one text."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    commas = offsets[1:] - offsets[0] + np.arange(len(values))
    text = np.full(len(data) + len(values), COMMA, np.uint8)
    plain = np.ones(len(text), bool)
    plain[commas] = False
    text[plain] = data
    return text.tobytes()


def whole_ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Place, bytes]]:
    place, parts = None, []
    for at, values in by_range(batches):
        if at != place and place is not None:
            yield place, b"".join(parts)
            parts = []
        place = at
        parts.append(joined(values))
    if place is not None:
        yield place, b"".join(parts)


class Structure:
    """Places and kinds of the structural characters of a range, for either state at its start."""

    def __init__(self, text: bytes):
        data = np.frombuffer(text, np.uint8)
        quotes = np.flatnonzero(data == QUOTE)
        slashes = np.flatnonzero(data == BACKSLASH)
        if len(slashes):
            first = np.append(True, np.diff(slashes) != 1)
            run_start = slashes[np.maximum.accumulate(np.where(first, np.arange(len(slashes)), 0))]
            escaped = slashes[(slashes - run_start) % 2 == 0] + 1
            quotes = quotes[~np.isin(quotes, escaped)]
        self.flips = bool(len(quotes) % 2)
        kind = np.zeros(256, np.int8)
        kind[list(OPENING)], kind[list(CLOSING)], kind[COMMA] = 1, -1, 2
        self.at = np.flatnonzero(kind[data])
        self.kind = kind[data[self.at]]
        self.odd = (np.searchsorted(quotes, self.at) & 1).astype(bool)

    def outside(self, in_string: bool) -> np.ndarray:
        return self.odd if in_string else ~self.odd

    def change(self, in_string: bool) -> int:
        kinds = self.kind[self.outside(in_string)]
        return int(kinds[kinds != 2].sum())


@dataclass(frozen=True)
class State:
    """How a range begins: inside a string or not, its depth, and the wrapping member that is open."""

    in_string: bool = False
    depth: int = 0
    chosen: bool = False


def _functions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for place, text in whole_ranges(batches):
        found = Structure(text)
        lead = text.removeprefix(b"\xef\xbb\xbf").lstrip(_SPACE)
        lead = (lead[:1] + lead[1:].lstrip(_SPACE)[:1]).decode("latin-1") if place[1] == 0 else None
        rows.append((*place, found.flips, found.change(False), found.change(True), lead, b"\0" in text, len(text)))
    names = ["file", "start", "flips", "outside", "inside", "lead", "nulls", "size"]
    kinds = [pa.int64()] * 2 + [pa.bool_()] + [pa.int64()] * 2 + [pa.string(), pa.bool_(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [()] * 8, kinds)], names)


_FUNCTION = "file long, start long, flips boolean, outside long, inside long, lead string, nulls boolean, size long"


def _members(states: dict[Place, State]) -> Callable:
    """Members of wrapping objects that begin in a range: name, whether an array begins there, and its first character."""

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for place, text in whole_ranges(batches):
            state, found = _known(states, place), Structure(text)
            outside = found.outside(state.in_string)
            at, kind = found.at[outside], found.kind[outside]
            depth = state.depth + np.cumsum(np.where(kind == 2, 0, kind))
            begins = at[((kind == 2) & (depth == 1)) | ((kind == 1) & (depth == 1))].tolist()
            if place[1] and state.depth == 1 and not state.in_string:
                begins = [-1, *begins]  # the comma before this range
            for begin in begins:
                member = _MEMBER.match(text, begin + 1)
                if member is not None:
                    rows.append((*place, begin, json.loads(member[1]), bool(member[2]), member[3].decode("latin-1")))
                elif text[begin + 1 :].strip(_SPACE + b","):
                    rows.append((*place, begin, None, False, ""))
        kinds = [pa.int64()] * 3 + [pa.string(), pa.bool_(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [()] * 6, kinds)], ["file", "start", "begin", "name", "array", "lead"])

    return over


_MEMBERS = "file long, start long, begin long, name string, array boolean, lead string"


def _known(states: dict[Place, State], place: Place) -> State:
    if place not in states:
        raise ValueError("The ranges of a JSON file changed between its passes.")
    return states[place]


def _elements(states: dict[Place, State], level: int, key: str | None) -> Callable:
    """Pieces of the array's elements: (file, start, part, text). Whole elements have part null.

    Part 0 continues what the range before left open, part 1 is left open itself.
    """

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, text in whole_ranges(batches):
            rows = list(_cut(_known(states, place), text, level, key))
            for begin in range(0, len(rows), 10_000):
                part, pieces = zip(*rows[begin : begin + 10_000])
                n = len(part)
                columns = [pa.array([place[0]] * n, pa.int64()), pa.array([place[1]] * n, pa.int64()), pa.array(part, pa.int32()), pa.array(pieces, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["file", "start", "part", "text"])

    return over


_PIECES = "file long, start long, part int, text binary"


def _cut(state: State, text: bytes, level: int, key: str | None) -> Iterator[tuple[int | None, bytes]]:
    found = Structure(text)
    outside = found.outside(state.in_string)
    at, kind = found.at[outside], found.kind[outside]
    depth = state.depth + np.cumsum(np.where(kind == 2, 0, kind))
    opens = at[(kind == 1) & (depth == level) & (np.frombuffer(text, np.uint8)[at] == OPENING[0])] if level == 2 else at[(kind == 1) & (depth == 1)]
    closes = at[(kind == -1) & (depth == level - 1)]
    commas, inner = at[(kind == 2) & (depth == level)], at[(kind == -1) & (depth == level)]
    arrays = []
    if state.depth >= level and (level == 1 or state.chosen):
        arrays.append((-1, True))
    arrays += [(begin, False) for begin in opens.tolist() if level == 1 or _name_before(text, begin) == key]
    for begin, continued in arrays:
        close = int(np.searchsorted(closes, begin, side="right"))
        open_ended = close == len(closes)
        end = len(text) if open_ended else int(closes[close])
        edges = [begin, *commas[slice(*np.searchsorted(commas, [begin + 1, end]))].tolist(), end]
        ends = np.searchsorted(inner, edges)
        if (np.diff(ends) > 1).any():
            raise ValueError("The JSON is malformed: two records stand without a comma between them.")
        if len(edges) == 2 and not continued and not open_ended and not text[begin + 1 : end].strip(_SPACE):
            continue  # an empty array
        for number, (a, b) in enumerate(zip(edges, edges[1:])):
            continues, stays_open = continued and number == 0, open_ended and number == len(edges) - 2
            yield (2 if stays_open else 0) if continues else (1 if stays_open else None), text[a + 1 : b]


def _name_before(text: bytes, at: int) -> str | None:
    """The member name in front of an opening bracket."""
    head = text[:at].rstrip(_SPACE)
    if not head.endswith(b":"):
        return None
    head = head[:-1].rstrip(_SPACE)
    begin = len(head) - 1
    while begin > 0:
        begin = head.rfind(b'"', 0, begin)
        slashes = len(head[:begin]) - len(head[:begin].rstrip(b"\\"))
        if begin < 0 or slashes % 2 == 0:
            break
    return json.loads(head[begin:]) if begin >= 0 else None


@F.pandas_udf(StringType())
def _single(texts: pd.Series) -> pd.Series:
    """The text of one JSON value, checked; for the few elements that cross ranges."""
    for text in texts:
        json.loads(text)
    return texts


def _whole(pieces: DataFrame) -> DataFrame:
    """(text): whole elements, and those put together from the pieces of several ranges."""
    crossing = pieces.where("part is not null")
    by_place = Window.partitionBy("file").orderBy("start", F.col("part") == 1)
    begun = F.sum(F.when(F.col("part") == 1, 1).otherwise(0)).over(by_place)
    groups = crossing.withColumn("element", begun).groupBy("file", "element").agg(F.sort_array(F.collect_list(F.struct("start", (F.col("part") == 1).alias("last"), "text"))).alias("pieces"))
    text = _single(F.array_join(F.transform("pieces", lambda x: x["text"].cast("string")), ""))
    return pieces.where("part is null").select(F.col("text").cast("string").alias("text")).unionByName(groups.select(text.alias("text")))


def _fold(functions: list, members: list | None, key: str | None) -> dict[Place, State]:
    last: dict[Place, tuple[int, bool]] = {}
    for m in members or ():
        place = (m["file"], m["start"])
        if place not in last or last[place][0] < m["begin"]:
            last[place] = (m["begin"], m["array"] and m["name"] == key)
    states, file, state = {}, None, State()
    for f in sorted(functions, key=lambda r: (r["file"], r["start"])):
        place = (f["file"], f["start"])
        if f["file"] != file:
            if state.depth > 0 or state.in_string:
                raise RefusedError("The JSON is malformed or holds values that are not accepted.")
            file, state = f["file"], State()
        states[place] = state
        chosen = last[place][1] if place in last else state.chosen
        state = State(state.in_string != f["flips"], state.depth + (f["inside"] if state.in_string else f["outside"]), chosen)
    if state.depth != 0 or state.in_string:
        raise RefusedError("The JSON is malformed or holds values that are not accepted.")
    return states


@dataclass(frozen=True)
class Staged:
    """Where the elements were written, one JSON text a line; scalars as the member ``value`` of a record."""

    path: str
    records: bool
    wrapped: bool


def stage_elements(spark: SparkSession, path: str, records_key: str | None = None, range_bytes: int | None = None) -> Staged:
    """Write the elements of the JSON arrays below ``path`` as lines."""
    chunks = open_ranges(spark, path, ",", range_bytes or JSON_RANGE_BYTES)
    functions = chunks.mapInArrow(_functions, _FUNCTION).collect()  # one row per range
    if any(f["nulls"] for f in functions):
        raise RefusedError("JSON datasets containing null bytes are not accepted.")
    leads = {f["lead"] for f in functions if f["lead"] is not None}
    tops = {lead[:1] for lead in leads}
    if tops == {"["}:
        if records_key:
            raise RefusedError("records_key is only valid for a JSON object wrapping a record array.")
        seconds = {lead[1:] for lead in leads}
        if "{" in seconds and seconds != {"{"}:
            raise RefusedError("The JSON top-level array mixes objects and scalars; the structure is ambiguous.")
        if "]" in seconds:
            raise RefusedError("The JSON top-level array is empty.")
        level, key, records, label = 1, None, seconds == {"{"}, "top-level array"
        states = _fold(functions, None, None)
    elif tops == {"{"}:
        level = 2
        members = chunks.mapInArrow(_members(_fold(functions, None, None)), _MEMBERS)
        members = materialize(members)
        key, records = _choose(members, records_key)
        label = key
        states = _fold(functions, members.where("name is not null").groupBy("file", "start").agg(F.max(F.struct("begin", "name", "array")).alias("m")).select("file", "start", "m.*").collect(), key)
    else:
        raise RefusedError("JSON must be an array of records or an object wrapping one record array.")
    pieces = materialize(chunks.mapInArrow(_elements(states, level, key), _PIECES))
    texts = _whole(pieces).select(F.trim(F.regexp_replace("text", "[\\r\\n\\t]", " ")).alias("value"))
    staged = work_path(spark, "json-elements")
    texts.select(F.col("value") if records else F.concat(F.lit('{"value": '), "value", F.lit("}"))).write.text(staged)
    first = F.substring("value", 1 if records else 11, 1)
    broken = (first == "{") & ~F.col("value").endswith("}" if records else "}}")
    lead = spark.read.text(staged).agg(F.count_if((F.col("value") == ("" if records else '{"value": }')) | broken).alias("broken"), F.count_if(first == "{").alias("objects"), F.count_if(first != "{").alias("others"), F.count_if(first == "[").alias("arrays")).first()
    if lead["broken"]:
        raise RefusedError("The JSON is malformed or holds values that are not accepted.")
    if lead["objects"] and lead["others"]:
        raise RefusedError(f"The JSON {label} mixes objects and scalars; the structure is ambiguous.")
    if lead["arrays"]:
        raise RefusedError(f"The JSON {label} holds arrays; nested arrays are not flattened.")
    return Staged(staged, records, level == 2)


def _choose(members: DataFrame, records_key: str | None) -> tuple[str, bool]:
    """The array's name, and whether it holds records; names are compared over all files."""
    found = members.groupBy("name").agg(F.max("array").alias("array"), F.collect_set(F.when(F.col("array"), F.col("lead"))).alias("leads")).where("array or name is null").collect()
    if any(m["name"] is None for m in found):
        raise RefusedError("The JSON is malformed or holds values that are not accepted.")
    arrays = {m["name"]: set(m["leads"]) - {"]"} for m in found}
    if records_key:
        if not members.where(F.col("name") == records_key).limit(1).count():
            raise RefusedError(f"JSON object does not contain records_key '{records_key}'.")
        if records_key not in arrays:
            raise RefusedError(f"records_key '{records_key}' must contain an array of records.")
        chosen = records_key
    else:
        candidates = sorted(n for n, leads in arrays.items() if leads and leads != {"["})
        if len(candidates) > 1:
            raise RefusedError(f"JSON object contains multiple record arrays ({', '.join(candidates)}); specify records_key.")
        if not candidates:
            raise RefusedError("JSON object does not contain a clearly selected array of records.")
        chosen = candidates[0]
    if not arrays[chosen]:
        raise RefusedError(f"The JSON {chosen} is empty.")
    return chosen, arrays[chosen] == {"{"}
