"""SimHash fingerprints and their groups within a Hamming distance, over a Gray-order hierarchical index.

Fingerprints that differ in at most d bits agree on one of d + 1 blocks of bits. Each block is a mask;
the fingerprints that share a masked pattern stand below one upper node, and a node with too many of
them is split by the blocks of its remaining bits, where again one must agree. So a node is small
however many near copies there are, and no key holds an unbounded group. Below its node a task sorts
the fingerprints by Gray rank, which puts similar ones together, and builds inner nodes over runs of
them: each holds the bits that all below it share. A search adds up the differences along the way down
and drops a whole run as soon as they exceed the distance. From a node leave only the links of a
spanning forest, never its pairs.

Defined cases: texts without words have fingerprint zero and are linked like any other; fewer words
than a shingle are one shingle; null texts count as empty; equal fingerprints are always linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.llm.common import byte_texts, fresh, map_arrow, ragged, settle, text_key
from auditframe.llm.components import components
from auditframe.session import ship_with_tasks

ship_with_tasks(__name__)

BITS = 64
#: A node of the distributed levels is searched in one task once it has no more fingerprints than this.
NODE_SIZE = 256
#: Children of an inner node.
FANOUT = 16
#: Blocks are split no further once this few bits are left: a node then has at most 2**9 fingerprints.
LAST_BITS = 9
#: Upper bound on pairs that one search pass may meet.
PASS_PAIRS = 4_000_000


# ---- fingerprints -------------------------------------------------------------------------------

def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < words_per_shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(words_per_shingle))))
    count = max(1, len(words) - words_per_shingle + 1)
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, count))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a text's hashes: a bit is set if more than half of them have it; zero without any."""
    count = len(hashes)
    # One byte per bit, added eight bytes at a time; 255 rows cannot overflow a byte.
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").view(np.uint64).reshape(count, 8)
    if count <= 255:
        totals = bits.sum(axis=0).view(np.uint8).astype(np.int64)
    else:
        whole = count - count % 255
        totals = bits[:whole].reshape(-1, 255, 8).sum(axis=1).view(np.uint8).sum(axis=0, dtype=np.int64)
        totals += bits[whole:].sum(axis=0).view(np.uint8)
    return int(np.packbits(2 * totals > count, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_column: str = "doc_id", text: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(id, text_key, fp): the fingerprint of every whole text as a signed 64-bit integer."""

    def step(batch):
        found = np.array([fingerprint(x, words_per_shingle) for x in byte_texts(batch.column(2))], dtype=np.uint64)
        return {id_column: batch.column(0), "text_key": batch.column(1), "fp": pa.array(found.view(np.int64))}

    rows = df.select(F.col(id_column).alias(id_column), text_key(text).alias("text_key"), F.col(text).alias("text"))
    return map_arrow(rows, step, f"`{id_column}` {dict(df.dtypes)[id_column]}, text_key bigint, fp bigint")


# ---- the index inside a task --------------------------------------------------------------------

def gray_rank(values: np.ndarray) -> np.ndarray:
    """The rank of each value in Gray-code order: the prefix parities of its bits."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def build_levels(group: np.ndarray, values: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Levels over sorted leaves, lowest first; a node covers up to FANOUT nodes of one group below it.

    Of each node: ``first`` and ``count`` of its children, the mask of bits all its leaves share, and
    the pattern of those bits.
    """
    levels, shared, pattern = [], np.full(len(values), np.iinfo(np.uint64).max), values
    while True:
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(edge, len(group)))
        if levels and sizes.max(initial=1) == 1:
            return levels
        place = np.arange(len(group)) - np.repeat(edge, sizes)
        first = np.flatnonzero(place % FANOUT == 0)
        ones = np.bitwise_and.reduceat(pattern, first)
        zeros = np.bitwise_and.reduceat(~pattern & shared, first)
        shared = np.bitwise_and.reduceat(shared, first)
        shared = shared & (ones | zeros)
        pattern = ones & shared
        levels.append({"first": first, "count": np.diff(np.append(first, len(group))), "mask": shared, "pattern": pattern})
        group = group[first]


def near_pairs(group: np.ndarray, values: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of leaves of one group within ``distance``, found by descent for all i at once."""
    levels = build_levels(group, values)
    # The last leaf below every node, so that a search meets only leaves after its own.
    last = [levels[0]["first"] + levels[0]["count"] - 1]
    for level in levels[1:]:
        last.append(last[-1][level["first"] + level["count"] - 1])
    top_of_group = np.cumsum(np.concatenate([[True], group[1:] != group[:-1]])) - 1
    chunk = 1 << 14
    for start in range(0, len(values), chunk):
        query = np.arange(start, min(len(values), start + chunk))
        node = top_of_group[query]
        spent = np.zeros(len(query), dtype=np.int64)
        known = np.zeros(len(query), dtype=np.uint64)
        for depth in range(len(levels) - 1, -1, -1):
            level = levels[depth]
            fresh_bits = level["mask"][node] & ~known
            spent = spent + np.bitwise_count((values[query] ^ level["pattern"][node]) & fresh_bits)
            go = (spent <= distance) & (last[depth][node] > query)
            query, node, spent = query[go], node[go], spent[go]
            known = level["mask"][node]
            counts = level["count"][node]
            child = ragged(level["first"][node], counts)
            query, spent, known = np.repeat(query, counts), np.repeat(spent, counts), np.repeat(known, counts)
            node = child
        spent = spent + np.bitwise_count((values[query] ^ values[node]) & ~known)
        go = (spent <= distance) & (node > query)
        yield query[go], node[go]


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the classes of all pairs (a, b); a label is the smallest position of its class."""
    while len(a):
        x, y = labels[a], labels[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        apart = low != high
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        np.minimum.at(labels, high, low)
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
    return labels


def spanning_links(group: np.ndarray, values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint linked within its group, a link to one fingerprint of its class."""
    order = np.lexsort((gray_rank(values), group))
    group, values = group[order], values[order]
    labels = np.arange(len(values))
    for a, b in near_pairs(group, values, distance):
        labels = merge_labels(labels, a, b)
    moved = np.flatnonzero(labels != np.arange(len(values)))
    return values[moved], values[labels[moved]]


# ---- the distributed levels ---------------------------------------------------------------------

def block_masks(distance: int, depth: int) -> list[list[int]]:
    """Masks of the nodes of every level: level 0 has distance + 1 of them, each next level that many times more."""
    parts, levels, above = distance + 1, [], [(0, list(range(BITS)))]
    for _ in range(depth):
        here = []
        for mask, free in above:
            cut = [round(i * len(free) / parts) for i in range(parts + 1)]
            for i in range(parts):
                block = free[cut[i]:cut[i + 1]]
                here.append((mask | sum(1 << x for x in block), [x for x in free if x not in block]))
        levels.append([mask - (1 << BITS) if mask >> (BITS - 1) else mask for mask, _ in here])
        above = here
    return levels


def levels_needed(distance: int) -> int:
    left, depth = BITS, 0
    while left > LAST_BITS:
        left -= left // (distance + 1)
        depth += 1
    return depth


def node_links(distance: int):
    """Search whole nodes of rows (node, pattern, fp) that come sorted by node and pattern."""

    def over(batches):
        held: list[np.ndarray] = []

        def search(rows):
            change = np.any(rows[1:, :2] != rows[:-1, :2], axis=1)
            group = np.concatenate([[0], np.cumsum(change)])
            sizes = np.bincount(group)
            start = 0
            pairs = np.cumsum(sizes.astype(np.int64) ** 2)
            while start < len(sizes):  # groups whose pairs add up to a bounded number
                before = pairs[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(pairs, before + PASS_PAIRS, side="right")))
                low, high = np.searchsorted(group, [start, stop])
                a, b = spanning_links(group[low:high], np.ascontiguousarray(rows[low:high, 2]).view(np.uint64), distance)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
                start = stop

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
            rows = np.concatenate([*held, rows])
            held = []
            if not len(rows):
                continue
            other = np.flatnonzero(np.any(rows[:, :2] != rows[-1, :2], axis=1))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from search(rows[:cut])
            held = [rows[cut:]]  # the last node may go on in the next batch; it has a bounded size
        if held and len(held[0]):
            yield from search(held[0])

    return over


def fingerprint_links(values: DataFrame, distance: int = 2, node_size: int = NODE_SIZE) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints (column fp, distinct) within ``distance`` bits."""
    depth = levels_needed(distance)
    masks = block_masks(distance, depth)
    parts = distance + 1
    links = None
    rows = values.select("fp", F.lit(0).alias("above"))
    for level in range(depth):
        table = F.array(*[F.lit(m) for m in masks[level]])
        child = F.explode(F.array(*[F.col("above") * parts + i for i in range(parts)])).alias("node")
        rows = rows.select("fp", child).select("fp", "node", F.col("fp").bitwiseAND(F.element_at(table, F.col("node") + 1)).alias("pattern"))
        counts = settle(rows.groupBy("node", "pattern").count().where("count > 1"), "simhash-nodes")
        last = level == depth - 1
        small = counts if last else counts.where(F.col("count") <= node_size)
        found = (
            rows.join(small.select("node", "pattern"), ["node", "pattern"])
            .select("node", "pattern", "fp")
            .repartition("node", "pattern")
            .sortWithinPartitions("node", "pattern")
            .mapInArrow(node_links(distance), "a bigint, b bigint")
        )
        links = found if links is None else links.unionByName(found)
        large = counts.where(F.col("count") > node_size)
        if last or large.isEmpty():
            return links
        rows = settle(rows.join(large.select("node", "pattern"), ["node", "pattern"]).select("fp", F.col("node").alias("above")), "simhash-large")
    return links


def near_groups(df: DataFrame, id_column: str = "doc_id", text: str = "text", distance: int = 2, words_per_shingle: int = 3) -> DataFrame:
    """(id, text_key, fp, root, component_id): the smallest id whose fingerprint is reachable by links.

    One row per input row; root is the smallest fingerprint of the component. Null ids are members, but
    name a component only where it has no other id. An id with several texts may name several components.
    """
    rows = settle(fingerprints(df, id_column, text, words_per_shingle), "fingerprints")
    distinct = settle(rows.groupBy("fp").agg(F.min(id_column).alias("low_id")), "distinct-fingerprints")
    labels = components(fingerprint_links(distinct.select("fp"), distance))
    rooted = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low_id", F.coalesce("root", "fp").alias("root"))
    rooted = settle(rooted, "rooted-fingerprints")
    lows = settle(rooted.groupBy("root").agg(F.min("low_id").alias("component_id")), "component-names")
    named = rooted.join(lows, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select(id_column, "text_key", "fp", "root", "component_id")


def keep_one_per_group(df: DataFrame, id_column: str = "doc_id", text: str = "text", distance: int = 2) -> DataFrame:
    """The rows of ``df``, one per group of near copies: the one of smallest id.

    Of rows that share id and text one stays; of one id with several texts in a group, the one of
    smallest text key. All columns are kept.
    """
    return keep_first(df, near_groups(df, id_column, text, distance), id_column, text)


def keep_first(df: DataFrame, groups: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that come first in their group; ``groups`` is (id, text_key, root)."""
    first, key = fresh(df, "first_id"), fresh(df, "first_key")
    winners = groups.groupBy("root").agg(
        F.min(F.struct(F.col(id_column).isNull().alias("missing"), F.col(id_column).alias("id"), F.col("text_key").alias("key"))).alias("first")
    )
    winners = winners.select(F.col("first.id").alias(first), F.col("first.key").alias(key))
    keyed = df.withColumn(fresh(df, "own_key"), text_key(text))
    own = keyed.columns[-1]
    kept = keyed.join(winners, keyed[id_column].eqNullSafe(winners[first]) & (keyed[own] == winners[key]))
    return kept.dropDuplicates([first, key]).select(*df.columns)
