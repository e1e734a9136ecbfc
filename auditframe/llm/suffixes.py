"""Removal of repeated byte strings: suffix order of shards by external induced sorting.

Which suffixes are sorted. Every window of ``width`` bytes has an anchor: the gram of ``ANCHOR_BYTES`` bytes of smallest
hash in it. Equal windows have equal anchors, so a window is compared only with windows of the same anchor. Neighbouring
windows that share one anchor form a segment, the bytes from the first window's start to the last one's end. Segments
whose anchor is nowhere else cannot repeat. Equal segments are folded to one with a count before any text is shipped;
an anchor that is left with one segment needs no order.

Sorting. Segments of an anchor go to one shard, where ``induced.suffix_order`` yields the suffixes in order with their
common prefixes, out of queues on disk. A run of suffixes that share ``width`` bytes is a class of equal windows; a class
whose segments count two or more marks its windows. An anchor with more than ``SHARD_SEGMENTS`` different segments is
dealt to several shards by content; what such a shard finds alone goes on, one 128-bit hash per class, and meets the
classes of the anchor's other shards.

Marked windows join back to the places of their segments in all documents, and every byte below one goes. A null text
is empty. Texts shorter than ``width`` stay whole. Repeated rows count as further documents, so both go where they are
long enough; null and repeated ids do no harm, as rows are told apart by numbers of their own. An empty table gives no
row. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.llm import induced
from auditframe.llm.common import byte_texts, map_arrow, ragged, rows_in_passes, settle
from auditframe.llm.spans import powers_of
from auditframe.session import ship_with_tasks

ship_with_tasks(__name__)

#: Bytes of the gram that anchors a window.
ANCHOR_BYTES = 100
#: Bytes of text in a shard, about.
SHARD_BYTES = 1_500_000
#: Different segments of one anchor that go to one shard.
SHARD_SEGMENTS = 2_000
BASE = 0x9E3779B97F4A7C15
SEGMENT = ["anchor", "d1", "d2"]


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A mixed 64-bit hash of the ``size`` bytes at every place, from polynomial prefix sums."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers_of(BASE, len(data)), out=sums[1:])
    found = (sums[size:] - sums[:-size]) * powers_of(pow(BASE, -1, 1 << 64), len(sums) - size)  # an odd base can be divided out again
    found ^= found >> np.uint64(31)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    return found ^ (found >> np.uint64(29))


def least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, by doubling."""
    reach, found = 1, values
    while reach * 2 <= width:
        found = np.minimum(found[:-reach], found[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(found[: len(found) - rest], found[rest:]) if rest else found


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of texts that lie one after another in ``data``: first window, number of windows, hash of the anchor.

    Places and hashes share 64 bits for the search of the least, so equal 32-bit hashes fall to the leftmost gram.
    """
    lengths = np.maximum(ends - starts - width + 1, 0)
    windows = ragged(starts, lengths)
    if not len(windows):
        return windows, windows, windows
    hashes = gram_hashes(data, ANCHOR_BYTES)
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (least_in_window(keys, width - ANCHOR_BYTES + 1)[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    return windows[first], np.diff(np.append(first, len(windows))), hashes[anchor[first]].view(np.int64)


def _segment_rows(width: int):
    def over(batch: pa.RecordBatch) -> dict:
        import xxhash

        numbers, texts = np.asarray(batch.column(0)), byte_texts(batch.column(1))
        out: list[list] = [[], [], [], []]
        digests = []
        for start, stop in rows_in_passes(np.array([len(x) for x in texts])):
            joined = b"".join(texts[start:stop])
            ends = np.cumsum([len(x) for x in texts[start:stop]])
            starts = np.append(0, ends[:-1])
            place, count, anchor = segments(np.frombuffer(joined, np.uint8), starts, ends, width)
            row = np.searchsorted(ends, place, side="right")
            for a, b in zip(place.tolist(), (place + count + width - 1).tolist()):
                digests.append(xxhash.xxh3_128_digest(joined[a:b]))
            for column, values in zip(out, (numbers[start:stop][row], place - starts[row], count, anchor)):
                column.append(values)
        row, place, count, anchor = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in out)
        both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        return {"row": row, "place": place.astype(np.int32), "n": count.astype(np.int32), "anchor": anchor, "d1": both[:, 0].copy(), "d2": both[:, 1].copy()}

    return over


def equal_windows(texts: list[bytes], counts: list[int], weights: list[int], width: int, folder: str) -> Iterator[tuple[np.ndarray, ...]]:
    """The first ``counts`` windows of each text in order: text numbers, places, weight of the class of equal windows, its number."""
    lengths = np.array([len(x) for x in texts])
    ends = np.cumsum(lengths + 1)
    starts = ends - lengths - 1
    shelf = induced.Shelf(folder)
    symbols = np.frombuffer(b"\x00".join(texts) + b"\x00\x00", np.uint8).astype(np.int32) + 2
    symbols[ends - 1] = 1
    symbols[-1] = 0
    weights, counts = np.array(weights), np.array(counts)
    for places, common in induced.suffix_order(shelf.put(symbols), shelf, width):
        owner = np.minimum(np.searchsorted(ends, places, side="right"), len(texts) - 1)
        inner = places - starts[owner]
        group = np.cumsum(common < width)
        keep = inner < counts[owner]
        group, owner, inner = group[keep], owner[keep], inner[keep]
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
        if len(first):
            total = np.add.reduceat(weights[owner], first)
            yield owner, inner, np.repeat(total, np.diff(np.append(first, len(group)))), group


def _runs(owner: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive places of the same text as (text, first place, length)."""
    order = np.lexsort((inner, owner))
    owner, inner = owner[order], inner[order]
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (inner[1:] != inner[:-1] + 1))[: len(owner)])
    return owner[first], inner[first], np.diff(np.append(first, len(owner)))


SORTED = "anchor long, d1 long, d2 long, first int, length int, h1 long, h2 long"


def _sort_shards(width: int):
    """Over a partition of segments: runs of marked windows, and for split anchors the classes that other shards must see."""

    def sort(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        import xxhash

        texts, split = [x[5] for x in held], np.array([x[6] for x in held])
        marked, open_rows = [], []
        with tempfile.TemporaryDirectory() as folder:
            for owner, inner, total, group in equal_windows(texts, [x[4] for x in held], [x[3] for x in held], width, folder):
                again = total > 1
                marked.append((owner[again], inner[again]))
                leads = np.append(True, group[1:] != group[:-1]) & split[owner]
                for who, at, found in zip(owner[leads].tolist(), inner[leads].tolist(), again[leads].tolist()):
                    digest = np.frombuffer(xxhash.xxh3_128_digest(texts[who][at : at + width]), np.int64)
                    open_rows.append((held[who][0], None if found else held[who][1], held[who][2], at, 1, int(digest[0]), int(digest[1])))
        owner, inner = (np.concatenate(x) for x in zip(*marked)) if marked else (np.zeros(0, np.int64),) * 2
        for who, first, length in zip(*(x.tolist() for x in _runs(owner, inner))):
            open_rows.append((*held[who][:3], first, length, None, None))
        names = ["anchor", "d1", "d2", "first", "length", "h1", "h2"]
        kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 2
        for start in range(0, len(open_rows), 50_000):
            columns = zip(*open_rows[start : start + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names)

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held += zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))
        if held:
            yield from sort(held)

    return over


def _cut_out(width: int):
    """Per document its removed spans and what is left, from the marked runs of its windows."""

    def over(batch: pa.RecordBatch) -> dict:
        texts, runs = byte_texts(batch.column(1)), batch.column(2).to_pylist()
        sizes, removed, spans, digests, kept = [], [], [], [], []
        for text, marks in zip(texts, runs):
            rest, at, n_spans = [], 0, 0
            end = -1
            for first, length in sorted((x["first"], x["length"]) for x in marks or ()):
                if first > end:  # touching windows are one span
                    rest.append(text[max(at, 0) : first])
                    n_spans += 1
                end = at = max(end, first + length + width - 1)
            rest.append(text[at:])
            left = b"".join(rest)
            sizes.append(len(text))
            removed.append(len(text) - len(left))
            spans.append(n_spans)
            digests.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        return {"id": batch.column(0), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "kept": pa.array(kept, pa.binary())}

    return over


def _fetch(width: int):
    def over(batch: pa.RecordBatch) -> dict:
        columns: list[list] = [[] for _ in range(7)]
        for text, wanted in zip(byte_texts(batch.column(0)), batch.column(1).to_pylist()):
            for x in wanted:
                values = (x["anchor"], x["d1"], x["d2"], x["m"], x["n"], text[x["place"] : x["place"] + x["n"] + width - 1], x["split"])
                for column, value in zip(columns, values):
                    column.append(value)
        kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary(), pa.bool_()]
        return {str(i): pa.array(x, t) for i, (x, t) in enumerate(zip(columns, kinds))}

    def named(batch: pa.RecordBatch) -> dict:
        return dict(zip(["anchor", "d1", "d2", "m", "n", "bytes", "split"], over(batch).values()))

    return named


def marked_windows(docs: DataFrame, width: int) -> DataFrame:
    """(row, first, length): runs of windows of the numbered ``docs`` (row, text) that start anywhere else too."""
    spark = docs.sparkSession
    every = settle(map_arrow(docs, _segment_rows(width), "row long, place int, n int, anchor long, d1 long, d2 long"), "segments")
    # Written, so that Spark can split a frequent anchor in the joins.
    anchors = settle(every.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"), "anchors")
    places = settle(every.join(anchors, "anchor", "left_semi"), "repeated-anchors")
    folded = settle(places.groupBy(*SEGMENT).agg(F.count("*").alias("m"), F.min(F.struct("row", "place", "n")).alias("at")), "folded")
    kinds = settle(folded.groupBy("anchor").agg(F.count("*").alias("kinds")), "kinds")
    folded = folded.join(kinds, "anchor")
    alone = folded.where("kinds = 1 and m > 1").select(*SEGMENT, F.lit(0).alias("first"), F.col("at.n").alias("length"))
    shared = settle(folded.where("kinds > 1").select(*SEGMENT, "m", "at.*", "kinds"), "shared-anchors")
    size = shared.agg(F.sum(F.col("n") + width)).first()[0] or 0
    wanted = shared.groupBy("row").agg(F.collect_list(F.struct(*SEGMENT, "m", "n", "place", (F.col("kinds") > SHARD_SEGMENTS).alias("split"))).alias("wanted"))
    texts = map_arrow(docs.join(wanted, "row").select("text", "wanted"), _fetch(width), "anchor long, d1 long, d2 long, m long, n int, bytes binary, split boolean")
    part = F.when(F.col("split"), F.pmod(F.col("d1"), F.lit(1 << 20))).otherwise(0)
    parts = max(1, -(-size // SHARD_BYTES))
    dealt = texts.withColumn("deal", F.xxhash64("anchor", part)).repartition(int(parts), "deal").drop("deal")
    ordered = settle(dealt.mapInArrow(_sort_shards(width), SORTED), "ordered")
    seen = ordered.where("h1 is not null")
    again = seen.groupBy("h1", "h2").agg(F.count("*").alias("times")).where("times > 1").select("h1", "h2")
    across = seen.where("d1 is not null").join(again, ["h1", "h2"], "left_semi")
    found = alone.unionByName(ordered.where("h1 is null").select(*SEGMENT, "first", "length")).unionByName(across.select(*SEGMENT, "first", "length"))
    return places.join(settle(found, "marked"), SEGMENT).select("row", (F.col("place") + F.col("first")).alias("first"), "length")


def without_repeated_bytes(docs: DataFrame, width: int = 400, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document n_bytes, n_removed, n_spans, kept_sha256 and ``kept``, the bytes under no repeated window."""
    numbered = settle(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.col(text).alias("text")), "numbered")
    marks = marked_windows(numbered.select("row", "text"), width).groupBy("row").agg(F.collect_list(F.struct("first", "length")).alias("marks"))
    kind = dict(docs.dtypes)[id_column]
    joined = numbered.join(marks, "row", "left").select("id", "text", "marks")
    done = map_arrow(joined, _cut_out(width), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done.withColumnRenamed("id", id_column)
