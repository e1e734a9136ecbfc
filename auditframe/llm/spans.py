"""Removal of repeated passages: sliding runs of pieces, joined by hash over the whole corpus.

A text is cut into sentences at sentence ends and line breaks, and a sentence of more than
``SHORT_SENTENCE`` words into pieces at words that its content alone chooses: before each word whose hash
is the smallest of some ``CUT_WINDOW`` consecutive words of the sentence. So equal passages are cut alike
wherever they stand, except within their first and last 13 words, which words outside can sway; what
lies before the first or after the last common cut stays. A run is a window of at least two consecutive
pieces that reaches over a sentence end and has at least ``RUN_WORDS`` words, or has at least
``LONG_SENTENCE`` words; so every repeated passage of over 50 words has one. Two windows slide: the
shortest run that begins at each piece, and the shortest that ends at each; together they reach every
piece of a repeated passage that is long enough, up to both ends. Runs compare by words, letter case and
white space aside.

The first occurrence of a run is the one of smallest (id, text key, position). Every piece that any
later occurrence covers goes, also within the same text; the rest of the text stays as it was.

Defined cases: null texts stay null; texts too short for a run stay whole; rows that share id and text
are one document and are cleaned alike; an id with several texts has its texts in text-key order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.llm.common import fresh, map_arrow, rows_in_passes, settle, text_key
from auditframe.session import ship_with_tasks

ship_with_tasks(__name__)

RUN_WORDS = 20
RUN_SENTENCES = 2
LONG_SENTENCE = 25
SHORT_SENTENCE = 14
CUT_WINDOW = 7
BASE = 0x9E3779B97F4A7C15
# A sentence ends with white space after its marks, which these may close, or with white space that breaks a line.
MARKS, CLOSERS = ".!?", "\"')]"
#: Characters of the texts that one numpy pass cuts together; a longer text is a pass of its own.
PASS_CHARS = 200_000


SPACES = np.array([chr(x).isspace() for x in range(0x3001)] + [False])


def powers_of(base: int, count: int) -> np.ndarray:
    """The first powers of a number modulo 2**64."""
    out = np.full(count, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def range_hashes(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of every range of ``values``, from polynomial prefix sums; an odd base can be divided out again."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers_of(BASE, len(values)), out=sums[1:])
    return (sums[stop] - sums[start]) * powers_of(pow(BASE, -1, 1 << 64), len(values) + 1)[start] + (stop - start).astype(np.uint64)


def mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return hashes ^ (hashes >> np.uint64(32))


def each_lower(text: str) -> str:
    """The text in lower case, but for letters whose lower case is longer."""
    return "".join(low if len(low := c.lower()) == 1 else c for c in text)


def lower_codes(texts: list[str]) -> np.ndarray:
    """The code points of all texts in lower case, a line break after each."""
    lower = "\n".join([*(x if len(x) == len(text) else each_lower(text) for text, x in zip(texts, map(str.lower, texts))), ""])
    return np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def ends_sentence(codes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Whether the white space after a word (start, stop), but the last, ends a sentence."""
    breaks = np.concatenate([[0], np.cumsum(codes == 10)])
    last = np.arange(len(codes))
    for x in CLOSERS:
        last[codes == ord(x)] = -1
    last = np.maximum.accumulate(last)[stop[:-1] - 1]  # before the closing marks of the word
    marked = (last >= start[:-1]) & np.isin(codes[last], [ord(x) for x in MARKS])
    return marked | (breaks[start[1:]] > breaks[stop[:-1]])


@dataclass(frozen=True)
class Pieces:
    """The pieces of some texts, one after the other: where they begin and end in their text, and of each its hash, words and sentence."""

    first: np.ndarray  # of text i the pieces first[i] to first[i + 1]
    edges: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray
    sentence: np.ndarray


def pieces(texts: list[str]) -> Pieces:
    """Where texts are cut; an empty text has no piece."""
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    after = np.cumsum(sizes + 1)
    begin = after - sizes - 1
    codes = lower_codes(texts)
    black = np.zeros(len(codes) + 2, dtype=np.int8)
    black[1:-1] = ~SPACES[np.minimum(codes, len(SPACES) - 1)]
    change = np.diff(black)
    start, stop = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    hashes = mixed(range_hashes(codes.astype(np.uint64) + np.uint64(1), start, stop))
    text = np.searchsorted(after, start, side="right")
    ends = begin[sizes > 0]
    if len(start):
        inside = ends_sentence(codes, start, stop) & (text[1:] == text[:-1])
        ends = np.sort(np.concatenate([ends, start[1:][inside]]))
    edges = ends
    if len(start) >= CUT_WINDOW:
        sentence = np.searchsorted(ends, start, side="right") - 1
        windows = np.lib.stride_tricks.sliding_window_view(hashes, CUT_WINDOW)
        lowest = np.arange(CUT_WINDOW - 1, len(start)) - windows[:, ::-1].argmin(axis=1)  # of equal words the last
        inside = (sentence[CUT_WINDOW - 1:] == sentence[:len(windows)]) & (np.bincount(sentence)[sentence[:len(windows)]] > SHORT_SENTENCE)
        cut = np.zeros(len(start), dtype=bool)
        cut[lowest[inside]] = True
        cut[0] = False
        cut[1:] &= sentence[1:] == sentence[:-1]  # a sentence's first word is an edge already
        edges = np.sort(np.concatenate([ends, start[cut]]))
    own = np.searchsorted(after, edges, side="right")
    first = np.searchsorted(own, np.arange(len(texts) + 1))
    place = np.searchsorted(start, np.append(edges, len(codes)))
    # A piece ends where the next one of its text begins, or with the text.
    until = np.append(edges[1:], 0)
    final = first[1:][sizes > 0] - 1
    until[final] = (after - 1)[sizes > 0]
    return Pieces(first, edges - begin[own], until - begin[own], range_hashes(hashes, place[:-1], place[1:]), np.diff(place), np.searchsorted(ends, edges, side="right") - 1)


def sentence_edges(text: str) -> list[int]:
    """Positions that cut the whole text into pieces, 0 and its length included."""
    return [0, *pieces([text]).ends.tolist()]


def runs(found: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, first, length) of every distinct run of each text."""
    size, sentence = len(found.hashes), found.sentence
    text = np.repeat(np.arange(len(found.first) - 1), np.diff(found.first))
    low, high = found.first[text], found.first[text + 1]
    words = np.concatenate([[0], np.cumsum(found.counts)])
    place = np.arange(size)
    over = np.searchsorted(sentence, sentence, side="right") + 1  # a stop that reaches into the next sentence
    stop = np.maximum(np.searchsorted(words, words[:-1] + RUN_WORDS), over)
    stop = np.maximum(np.minimum(stop, np.searchsorted(words, words[:-1] + LONG_SENTENCE)), place + RUN_SENTENCES)
    forward = stop <= high
    under = np.searchsorted(sentence, sentence) - 1  # a start in the sentence before
    start = np.minimum(np.searchsorted(words, words[1:] - RUN_WORDS, side="right") - 1, under)
    start = np.minimum(np.maximum(start, np.searchsorted(words, words[1:] - LONG_SENTENCE, side="right") - 1), place + 1 - RUN_SENTENCES)
    backward = start >= low
    first = np.concatenate([place[forward], start[backward]])
    after = np.concatenate([stop[forward], place[backward] + 1])
    pair = np.sort(first * (size + 1) + after)
    pair = pair[np.diff(pair, prepend=-1) > 0]
    first, after = pair // (size + 1), pair % (size + 1)
    return text[first], range_hashes(mixed(found.hashes), first, after), first - low[first], after - first


def in_passes(texts: list[str | None]) -> Iterator[tuple[int, Pieces]]:
    """(row of the first text, pieces) of consecutive texts; null texts are empty."""
    lengths = np.array([len(x or "") for x in texts], dtype=np.int64)
    return ((a, pieces([x or "" for x in texts[a:b]])) for a, b in rows_in_passes(lengths, PASS_CHARS))


def run_rows(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(run, id, text_key, first, length): every run of every text."""

    def step(batch):
        parts = [[np.zeros(0, np.int64)] * 4]
        for start, found in in_passes(batch.column(2).to_pylist()):
            row, *rest = runs(found)
            parts.append([row + start, rest[0].view(np.int64), *rest[1:]])
        row, run, first, length = (np.concatenate(x) for x in zip(*parts))
        taken = pa.array(row)
        return {
            "run": pa.array(run), "id": batch.column(0).take(taken), "text_key": batch.column(1).take(taken),
            "first": pa.array(first.astype(np.int32)), "length": pa.array(length.astype(np.int32)),
        }

    rows = df.select(F.col(id_column).alias("id"), text_key(text).alias("text_key"), F.col(text).alias("text"))
    return map_arrow(rows, step, f"run bigint, id {dict(df.dtypes)[id_column]}, text_key bigint, first int, length int")


def repeated_spans(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_key, spans): per document the (first, length) of its runs that occur earlier in the corpus."""
    every = run_rows(df, id_column, text)
    again = settle(every.groupBy("run").count().where("count > 1").select("run"), "repeated-runs")
    rows = settle(every.join(again, "run"), "run-occurrences")
    place = F.struct(F.col("id").isNotNull().alias("named"), "id", "text_key", "first")
    # Written, so that the join sees two plain shuffles and Spark can split a run that is everywhere.
    starts = settle(rows.groupBy("run").agg(F.min(place).alias("start")), "run-starts")
    own = F.struct(F.col("id").isNotNull().alias("named"), "id", "text_key", "first")
    later = rows.join(starts, "run").where(~own.eqNullSafe(F.col("start")))
    return later.groupBy("id", "text_key").agg(F.collect_set(F.struct("first", "length")).alias("spans"))


def without_repeats(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with its texts cleaned, and n_sentences and n_removed added (names lengthened on a clash)."""
    total, removed = fresh(df, "n_sentences"), fresh(df, "n_removed")
    spans = repeated_spans(df, id_column, text)
    names = [fresh(df, x) for x in ("span_id", "span_key", "spans", "own_key")]
    found = spans.select(F.col("id").alias(names[0]), F.col("text_key").alias(names[1]), F.col("spans").alias(names[2]))
    keyed = df.withColumn(names[3], text_key(text))
    joined = keyed.join(found, keyed[id_column].eqNullSafe(found[names[0]]) & (keyed[names[3]] == found[names[1]]), "left").select(*df.columns, names[2])
    kept = df.columns
    at, spans_at = kept.index(text), len(kept)

    def step(batch):
        texts = batch.column(at).to_pylist()
        spans = batch.column(spans_at)
        row = np.repeat(np.arange(len(texts)), spans.value_lengths().fill_null(0).to_numpy())
        spans = spans.flatten()
        begin, length = (spans.field(x).to_numpy() for x in ("first", "length"))
        sizes, gone = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        for start, found in in_passes(texts):
            rows = slice(start, start + len(found.first) - 1)
            sizes[rows] = np.diff(found.first)
            own = slice(*np.searchsorted(row, [rows.start, rows.stop]))
            piece = found.first[row[own] - start] + begin[own]
            drop = np.bincount(piece, minlength=len(found.ends) + 1) - np.bincount(piece + length[own], minlength=len(found.ends) + 1)
            covered = np.cumsum(drop)[:-1] > 0
            gone[rows] = np.diff(np.concatenate([[0], np.cumsum(covered)])[found.first])
            for i in np.flatnonzero(gone[rows]).tolist():
                stays = np.flatnonzero(~covered[found.first[i]:found.first[i + 1]]) + found.first[i]
                value = texts[start + i]
                texts[start + i] = "".join([value[a:b] for a, b in zip(found.edges[stays].tolist(), found.ends[stays].tolist())]).rstrip()
        columns = {name: batch.column(i) for i, name in enumerate(kept)}
        return columns | {text: pa.array(texts, pa.string()), total: pa.array(sizes, pa.int64()), removed: pa.array(gone, pa.int64())}

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)
    return map_arrow(joined, step, f"{kinds}, {total} bigint, {removed} bigint")
