"""Ranked lexical search over bit-sliced Bloom signatures.

Index. Documents are cut into blocks. A block has one Bloom filter per document, all of the same width, stored by
slices: slice ``i`` is the bitmap of the documents whose filter has bit ``i``. The filters hold every term once for
each level of ``LEVELS`` that its count reaches, so a few slices tell for all documents of a block at once how often a
term occurs at most. Documents are sorted by number of entries before they are cut, so that one width suits a block.
Beside its slices a block keeps the terms and counts of its documents, for rescoring.

Search. Filters overestimate only. A term's slices give an upper bound of its count per document, hence of its score;
the weighted sum over an item's terms bounds the document's score. A first pass scores in every block the ``k``
documents of highest bound exactly; the ``k``-th best score of all blocks is a floor for the item. The second pass
rescores exactly every document whose bound reaches the floor. The others are provably below ``k`` better ones.

Items are read in blocks of at most ``ITEM_TERMS`` terms, so that what goes to the tasks has a fixed size; every block
of items meets the whole index.

Defined cases: null texts have no term; items without a term, or with none that a document holds, give no row; repeated
item rows are ranked each, repeated document rows each take a rank; a null doc_id comes after all others among equal
scores. An empty table gives no row. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditframe.llm.common import byte_texts, settle
from auditframe.session import ship_with_tasks

ship_with_tasks(__name__)

#: Counts that have an entry of their own in a document's filter.
LEVELS = (1, 2, 3, 5, 9, 17, 33)
#: Bits of a filter per entry of the block's largest document, and bits set per entry.
BITS_PER_ENTRY, BITS_SET = 8, 3
BLOCK_DOCS = 256
#: Bits of a block before they are packed; a larger single filter is a block of its own.
BLOCK_BITS = 8_000_000
#: Bytes of text whose documents are sorted and cut into blocks together.
SORT_BYTES = 2_000_000
#: Documents of an Arrow batch that are Python values at a time.
READ_ROWS = 100
#: Terms of an item whose scores are held for a block's documents at a time.
SCORE_TERMS = 1_000
#: Terms of a block of items; a single larger item is a block of its own.
ITEM_TERMS = 10_000
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
ONE = 1_000_000_000

INDEX = "docs array<long>, lengths array<long>, width int, slices binary, offsets array<long>, terms binary, counts binary"


def term_counts(text: bytes) -> Counter:
    """Terms of a UTF-8 text (maximal runs of ASCII letters, digits and everything beyond ASCII), A-Z lower-cased."""
    return Counter(TERM.findall(text.translate(LOWER)))


def entries(terms: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash per (term, level reached), and the term's place."""
    import xxhash

    hashes = np.array([xxhash.xxh64_intdigest(x) for x in terms], dtype=np.uint64)
    reached = np.searchsorted(LEVELS, counts, side="right")
    place = np.repeat(np.arange(len(terms)), reached)
    level = np.arange(len(place)) - np.repeat(np.cumsum(reached) - reached, reached)
    return level_hashes(hashes[place], level), place


def level_hashes(hashes: np.ndarray, level: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ (level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


def bit_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """The ``BITS_SET`` bits of each hash, one row per hash."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return ((hashes[:, None] + step[:, None] * np.arange(BITS_SET, dtype=np.uint64)) >> np.uint64(7)).astype(np.int64) % width


def _held(doc, counted: Counter) -> tuple:
    """(doc, terms, counts, entries): a document's terms as space-joined bytes, its counts as 32-bit numbers, the hashes of its entries."""
    counts = np.fromiter(counted.values(), np.uint32, len(counted))
    return doc, b" ".join(counted), counts, entries(list(counted), counts)[0]


def _block(rows: list[tuple]) -> dict:
    """One index row."""
    docs, terms, counts, hashed = map(list, zip(*rows))
    width = max(8, BITS_PER_ENTRY * max(len(x) for x in hashed))
    bits = np.zeros((width, len(docs)), dtype=np.uint8)
    for column, hashes in enumerate(hashed):
        bits[bit_places(hashes, width).ravel(), column] = 1
    return {
        "docs": docs,
        "lengths": [int(x.sum(dtype=np.int64)) for x in counts],
        "width": width,
        "slices": np.packbits(bits, axis=1).tobytes(),
        "offsets": np.cumsum([0, *(len(x) for x in terms)]).tolist(),
        "terms": b"".join(terms),
        "counts": np.concatenate(counts).tobytes(),
    }


def build_index(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The written index: one row per block; documents without a term are left out, as they never score."""
    schema = pa.schema([("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("width", pa.int32()), ("slices", pa.binary()), ("offsets", pa.list_(pa.int64())), ("terms", pa.binary()), ("counts", pa.binary())])

    def blocks(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda row: len(row[3]))
        start = 0
        while start < len(rows):
            stop = start + 1
            while stop < min(len(rows), start + BLOCK_DOCS) and (stop + 1 - start) * len(rows[stop][3]) * BITS_PER_ENTRY <= BLOCK_BITS:
                stop += 1
            block, start = _block(rows[start:stop]), stop
            yield pa.RecordBatch.from_arrays([pa.array([block[f.name]], f.type) for f in schema], schema=schema)

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, READ_ROWS):
                some = batch.slice(start, READ_ROWS)
                for doc, text in zip(some.column(0).to_pylist(), byte_texts(some.column(1))):
                    if counted := term_counts(text):
                        held.append(_held(doc, counted))
                    size += len(text)
                    if size >= SORT_BYTES:
                        yield from blocks(held)
                        held, size = [], 0
        yield from blocks(held)

    return settle(docs.select(F.col(id_column).cast("long"), F.col(text)).mapInArrow(over, INDEX), "signatures")


@dataclass(frozen=True)
class Items:
    """A block of items: the distinct terms with their weights, and per item the places of its terms."""

    ids: tuple
    terms: tuple[bytes, ...]
    places: tuple[np.ndarray, ...]


def item_blocks(items: DataFrame, id_column: str = "item_id", text: str = "text") -> Iterator[Items]:
    """Items in bounded blocks, read one by one; at no time is more than a block on the driver."""
    ids, terms, places = [], {}, []
    for row in items.select(F.col(id_column), F.col(text)).toLocalIterator():
        found = [x.decode() for x in term_counts((row[1] or "").encode())]
        if not found:
            continue
        if ids and len(terms) + len(found) > ITEM_TERMS:
            yield Items(tuple(ids), tuple(x.encode() for x in terms), tuple(places))
            ids, terms, places = [], {}, []
        ids.append(row[0])
        places.append(np.array([terms.setdefault(x, len(terms)) for x in found]))
    if ids:
        yield Items(tuple(ids), tuple(x.encode() for x in terms), tuple(places))


def _forward(row: dict, doc: int, start: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    terms = row["terms"][row["offsets"][doc] : row["offsets"][doc + 1]].split(b" ")
    return terms, np.frombuffer(row["counts"], np.uint32)[start[doc] : start[doc] + len(terms)].astype(np.int64)


def _firsts(row: dict) -> np.ndarray:
    """Where every document's counts begin."""
    text = np.frombuffer(row["terms"], np.uint8)
    blanks = np.concatenate([[0], np.cumsum(text == 32)])
    ends = np.array(row["offsets"])
    return np.concatenate([[0], np.cumsum(blanks[ends[1:]] - blanks[ends[:-1]] + 1)])


def document_frequencies(index: DataFrame, terms: tuple[bytes, ...]) -> np.ndarray:
    """In how many documents each term stands; one partial count per term and task."""
    known = {x: i for i, x in enumerate(terms)}

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for row in _rows([batch]):
                joined, ends = row["terms"], row["offsets"]
                for start, end in zip(ends, ends[1:]):
                    counts[[known[x] for x in joined[start:end].split(b" ") if x in known]] += 1
        some = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["term", "n"])

    found = index.select("terms", "offsets").mapInArrow(over, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(terms), dtype=np.int64)
    for row in found.toLocalIterator():
        out[row["term"]] = row["n"]
    return out


def term_score(weight, count, m):
    """w * ((1000000000 * tf) div (1000 * tf + 20 * m)), for numbers or arrays."""
    return weight * ((ONE * count) // (1000 * count + 20 * m))


class Searcher:
    """Bounds and exact scores of one block of items over index rows."""

    def __init__(self, items: Items, weights: np.ndarray, n_docs: int, n_terms: int):
        self.items, self.weights, self.n_docs, self.n_terms = items, weights, n_docs, n_terms
        import xxhash

        hashes = np.array([xxhash.xxh64_intdigest(x) for x in items.terms], dtype=np.uint64)
        self.hashes = np.stack([level_hashes(hashes, np.full(len(hashes), i)) for i in range(len(LEVELS))])
        self.known = {x: i for i, x in enumerate(items.terms)}
        self.sets = None

    def lengths(self, row: dict) -> np.ndarray:
        return 100 - 50 + (50 * np.array(row["lengths"], dtype=np.int64) * self.n_docs) // self.n_terms

    def bounds(self, row: dict) -> np.ndarray:
        """An upper bound of the score, per item and document: weighted sums over the slices of the items' terms."""
        docs = len(row["docs"])
        slices = np.frombuffer(row["slices"], np.uint8).reshape(row["width"], -1)
        m, n = self.lengths(row), np.array(row["lengths"], dtype=np.int64)
        most = [np.minimum(n, x - 1) for x in LEVELS[1:]] + [n]
        worth = np.stack([np.zeros(docs, dtype=np.int64), *(term_score(1, x, m) for x in most)])
        reached = np.zeros((len(self.known), docs), dtype=np.uint8)
        still, alive = None, np.arange(len(self.known))
        for hashes in self.hashes:
            own = np.bitwise_and.reduce(slices[bit_places(hashes[alive], row["width"])], axis=1)
            still = own if still is None else still & own
            some = still.any(axis=1)
            alive, still = alive[some], still[some]
            if not len(alive):
                break
            reached[alive] += np.unpackbits(still, axis=1, count=docs)
        # Item by item: scores of all terms at once would take 24 times the memory of ``reached``.
        scores = np.zeros((len(self.items.places), docs), dtype=np.int64)
        for score, places in zip(scores, self.items.places):
            for start in range(0, len(places), SCORE_TERMS):
                some = places[start : start + SCORE_TERMS]
                score += (np.take_along_axis(worth, reached[some], axis=0) * self.weights[some, None]).sum(axis=0)
        return scores

    def exact(self, row: dict, wanted: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, document, score) of the pairs that ``wanted`` (items by documents) marks, if above 0."""
        if self.sets is None:
            self.sets = [frozenset(x.tolist()) for x in self.items.places]
        m, firsts = self.lengths(row).tolist(), _firsts(row)
        for doc in np.nonzero(wanted.any(axis=0))[0].tolist():
            terms, counts = _forward(row, doc, firsts)
            own = {self.known[x]: int(n) for x, n in zip(terms, counts.tolist()) if x in self.known}
            worth = {t: term_score(int(self.weights[t]), n, m[doc]) for t, n in own.items()}
            for item in np.nonzero(wanted[:, doc])[0].tolist():
                score = sum(worth[t] for t in self.sets[item] & worth.keys())
                if score > 0:
                    yield item, doc, score


FOUND = "item int, doc_id long, score long"


def _answers(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for place in range(batch.num_rows):
            yield batch.slice(place, 1).to_pylist()[0]


def search_block(index: DataFrame, searcher: Searcher, k: int) -> DataFrame:
    """(item, doc_id, score) of all documents that can be among the ``k`` best of an item, and a few more."""

    def leading(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        for row in _rows(batches):
            bounds = searcher.bounds(row)
            floors = np.array([best[i][k - 1] if len(best.get(i, ())) >= k else 1 for i in range(len(bounds))])
            take = min(k, bounds.shape[1])
            wanted = np.zeros(bounds.shape, dtype=bool)
            np.put_along_axis(wanted, np.argpartition(-bounds, take - 1, axis=1)[:, :take], True, axis=1)
            for item, _, score in searcher.exact(row, wanted & (bounds >= floors[:, None])):
                best.setdefault(item, []).append(score)
            best = {item: sorted(scores, reverse=True)[:k] for item, scores in best.items()}
        yield _answers([(item, None, score) for item, scores in best.items() for score in scores])

    order = Window.partitionBy("item").orderBy(F.desc("score"))
    ranked = index.mapInArrow(leading, FOUND).select("item", "score", F.row_number().over(order).alias("place")).where(F.col("place") <= k)
    floors = np.ones(len(searcher.items.ids), dtype=np.int64)
    for row in ranked.where(F.col("place") == k).select("item", "score").toLocalIterator():
        floors[row["item"]] = max(1, row["score"])

    def rescored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            found = [x for x in searcher.exact(row, searcher.bounds(row) >= floors[:, None]) if x[2] >= floors[x[0]]]
            yield _answers([(item, row["docs"][doc], score) for item, doc, score in found])

    return index.mapInArrow(rescored, FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_column: str = "doc_id", item_column: str = "item_id", text: str = "text") -> DataFrame:
    """The ``k`` highest-scoring documents of every item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    index = build_index(docs, id_column, text)
    n_docs, n_terms = index.agg(F.sum(F.size("docs")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    kind = dict(items.dtypes)[item_column]
    found = None
    for number, block in enumerate(item_blocks(items, item_column, text)):
        if not n_docs:
            break
        frequency = document_frequencies(index, block.terms)
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) if x else 0 for x in frequency.tolist()], dtype=np.int64)
        answers = search_block(index, Searcher(block, weights, n_docs, n_terms), k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(pd.DataFrame({"item": range(len(block.ids))}).assign(item_id=pd.Series(block.ids, dtype=object)), f"item int, item_id {kind}")
        own = settle(ranked.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), f"found-{number}")
        found = own if found is None else found.unionByName(own)
    return found if found is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
