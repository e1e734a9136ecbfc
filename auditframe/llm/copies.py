"""Groups of near copies: texts whose sets of word shingles have a Jaccard similarity of a bound or more.

Every set of shingles has a SimHash fingerprint. Those that differ in at most ``DISTANCE`` bits are found in
the Gray-order index of simhash.py, and the links between them are the first candidates. At similarity 0.8
two fingerprints differ in about 10 of 64 bits, where an index over fingerprints no longer separates
anything. So bands of min-hashes add what SimHash cannot reach: two texts agree on a band with probability
similarity ** BAND_ROWS, and meet if they agree on one of BANDS. Every candidate pair is decided by the
exact similarity of its texts.

A bucket of n texts is first compared with one member only, so a large group of near copies costs n
comparisons: with the member that shares its buckets with most, the text from which others were changed
rather than one more copy. Where that leaves the other members of a bucket in several groups, pairs between
groups are found by what each text changes of that member (``crossing_pairs``): similar texts must share rare
changes, and neither texts that have only a passage in common nor copies changed each in its own way do; no
candidate of the bound is left out.

Recall: a pair of similarity 0.8 meets with probability 1 - (1 - 0.8**5)**25 = 0.99995 in the bands alone,
more similar pairs with more. Precision is exact up to 64-bit hashes of the shingles.

Defined cases: shingles are of lower-case words between white space; fewer words than a shingle are one
shingle; texts without words, and null, are equal to each other and to nothing else.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditframe.llm.common import byte_texts, map_arrow, settle, text_key
from auditframe.llm.components import components
from auditframe.llm.simhash import fingerprint_links, majority
from auditframe.session import ship_with_tasks

ship_with_tasks(__name__)

WORDS = 5
SIMILARITY = 0.8
BANDS = 25
BAND_ROWS = 5
#: Bits in which the fingerprints of SimHash candidates may differ.
DISTANCE = 3
#: Shingles that one numpy pass holds.
PASS = 1024
_DRAW = np.random.default_rng(5)
FLIPS = _DRAW.integers(0, 1 << 64, (BANDS * BAND_ROWS, 1), dtype=np.uint64)
FACTORS = _DRAW.integers(0, 1 << 64, (BANDS * BAND_ROWS, 1), dtype=np.uint64) | np.uint64(1)


def shingle_set(text: bytes, words_per_shingle: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = text.lower().split()
    if len(words) < words_per_shingle:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(words_per_shingle))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty sets are equal."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def bands(shingles: np.ndarray) -> np.ndarray:
    """One key per band of min-hashes, each tied to its band; every set has BANDS of them, the empty too."""
    low = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for start in range(0, len(shingles), PASS):
        mixed = (shingles[None, start:start + PASS] ^ FLIPS) * FACTORS
        low = np.minimum(low, (mixed ^ (mixed >> np.uint64(32))).min(axis=1))
    rows = low.reshape(BANDS, BAND_ROWS)
    return np.fromiter((xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(rows)), np.uint64, BANDS).view(np.int64)


def sketches(df: DataFrame, id_column: str, text: str, words_per_shingle: int) -> DataFrame:
    """(id, text_key, node, fp, bands): per row the hash of its set of shingles, its SimHash fingerprint and the keys of its bands."""

    def step(batch):
        sets = [shingle_set(x, words_per_shingle) for x in byte_texts(batch.column(2))]
        nodes = np.fromiter((xxhash.xxh64_intdigest(x.tobytes()) for x in sets), np.uint64, len(sets)).view(np.int64)
        prints = np.array([majority(x) for x in sets], dtype=np.uint64).view(np.int64)
        keys = [bands(x) for x in sets]
        columns = {id_column: batch.column(0), "text_key": batch.column(1), "node": pa.array(nodes), "fp": pa.array(prints)}
        return {**columns, "bands": pa.array(keys, pa.list_(pa.int64()))}

    rows = df.select(F.col(id_column).alias(id_column), text_key(text).alias("text_key"), F.col(text).alias("text"))
    return map_arrow(rows, step, f"`{id_column}` {dict(df.dtypes)[id_column]}, text_key bigint, node bigint, fp bigint, bands array<bigint>")


def fingerprint_pairs(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp) with equal or near fingerprints, as many as connect them."""
    heads = settle(nodes.groupBy("fp").agg(F.min("node").alias("a")), "fingerprint-heads")
    equal = nodes.join(heads, "fp").where("node <> a").select("a", F.col("node").alias("b"))
    links = fingerprint_links(heads.select("fp"), distance).distinct().withColumnsRenamed({"a": "fp", "b": "other"})
    near = links.join(heads, "fp").join(heads.select(F.col("fp").alias("other"), F.col("a").alias("b")), "other")
    return equal.unionByName(near.select("a", "b"))


def crossing_pairs(members: DataFrame, texts: DataFrame, least: float, words_per_shingle: int) -> DataFrame:
    """Pairs (a, b) of members (pivot, node, root) of one pivot with different roots that can have the similarity, and all that have it.

    Members without the column pivot have the empty set for one. A set is taken as the shingles in which it differs from its pivot. Two sets differ in what stands in one of
    these differences only, so where a set is not similar to the pivot, similar ones share some of its
    differences. The differences are ordered by how many sets of the pivot have them, rarest first: a common one
    is among the first few of each, and where it stands bounds what they can share at most. Near copies of one
    text with changes of their own share hardly any, however many they are.
    """
    apart = (1 - least) / (1 + least)  # two similar sets differ in at most this share of their sizes' sum

    def step(batch):
        known: dict[int, np.ndarray] = {}
        rows = []
        for pivot, text, own in zip(batch.column(0).to_pylist(), byte_texts(batch.column(3)), byte_texts(batch.column(4))):
            if pivot not in known:
                known = {pivot: shingle_set(text, words_per_shingle)}
            base, shingles = known[pivot], shingle_set(own, words_per_shingle)
            changes = np.setxor1d(base, shingles, assume_unique=True).view(np.int64)
            rows.append((changes, len(shingles), len(base), len(changes), similarity(base, shingles) >= least))
        changes, *counts, near = zip(*rows) if rows else [()] * 5
        names = dict(zip(("pivot", "node", "root"), batch.columns))
        return names | {"shingles": pa.array(changes, pa.list_(pa.int64()))} | {k: pa.array(v, pa.int64()) for k, v in zip(("size", "base", "changed"), counts)} | {"near": pa.array(near, pa.bool_())}

    if "pivot" in members.columns:
        paired = members.join(texts, "node").join(texts.select(F.col("node").alias("pivot"), F.col("text").alias("pivot_text")), "pivot")
    else:
        paired = members.join(texts, "node").withColumns({"pivot": F.lit(0).cast("long"), "pivot_text": F.lit("")})
    paired = paired.select("pivot", "node", "root", "pivot_text", "text")
    sets = map_arrow(paired, step, "pivot bigint, node bigint, root bigint, shingles array<bigint>, size bigint, base bigint, changed bigint, near boolean")
    held = settle(sets.withColumn("shingle", F.explode("shingles")).drop("shingles"), "open-shingles")
    counts = held.groupBy("pivot", "shingle").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    rarest = Window.partitionBy("pivot", "node").orderBy("holders", "shingle")
    # What one set alone has comes first and meets nothing; it only moves the places of the others.
    alone = F.col("changed") - F.count(F.lit(1)).over(Window.partitionBy("pivot", "node"))
    placed = held.join(counts, ["pivot", "shingle"]).withColumn("place", alone + F.row_number().over(rarest))
    # Common changes that any similar set of another root has at least.
    beside = F.when(F.col("near"), F.col("size") - F.col("base")).otherwise(F.col("size") + F.col("base"))
    common = F.greatest(F.lit(1), F.ceil((F.col("changed") - beside * apart) / 2 - 1e-9))
    first = settle(placed.where(F.col("place") <= F.col("changed") - common + 1).drop("base", "holders"), "rarest-shingles")
    names = ("node", "root", "size", "changed", "near", "place")
    one, two = (first.select("pivot", "shingle", *[F.col(c).alias(f"{side}_{c}") for c in names]) for side in "ab")
    left = F.least(F.col("a_changed") - F.col("a_place"), F.col("b_changed") - F.col("b_place")) + 1
    fits = (
        (F.col("b_near") | (F.col("a_node") < F.col("b_node")))
        & (F.col("a_root") != F.col("b_root"))
        & (F.least("a_size", "b_size") >= F.greatest("a_size", "b_size") * least - 1e-9)
        & (left >= (F.col("a_changed") + F.col("b_changed") - (F.col("a_size") + F.col("b_size")) * apart) / 2 - 1e-9)
    )
    pairs = one.where("not a_near").join(two, ["pivot", "shingle"]).where(fits)
    return pairs.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


def similar_pairs(pairs: DataFrame, texts: DataFrame, least: float, words_per_shingle: int) -> DataFrame:
    """The pairs (a, b) whose texts (node, text) have at least the similarity."""

    def step(batch):
        left, right = (batch.column(i).to_pylist() for i in (0, 1))
        known: dict[int, np.ndarray] = {}
        columns = [byte_texts(batch.column(i)) for i in (2, 3)]

        def of(node, value):
            if node not in known:
                if len(known) > 50:
                    known.clear()
                known[node] = shingle_set(value, words_per_shingle)
            return known[node]

        near = [similarity(of(a, x), of(b, y)) >= least for a, b, x, y in zip(left, right, *columns)]
        return {name: batch.column(i).filter(pa.array(near, pa.bool_())) for i, name in enumerate(("a", "b"))}

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
    return map_arrow(pairs.join(two, "b").join(one, "a").select("a", "b", "a_text", "b_text"), step, "a bigint, b bigint")


def near_copy_groups(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", least: float = SIMILARITY, words_per_shingle: int = WORDS
) -> DataFrame:
    """(id, text_key, root): one row per input row; equal roots name rows linked by pairs of at least the similarity."""
    rows = settle(sketches(df, id_column, text, words_per_shingle), "sketches")
    sets = settle(rows.dropDuplicates(["node"]).select("node", "fp", "bands"), "distinct-sets")
    members = settle(sets.select("node", F.explode("bands").alias("bucket")), "band-members")
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Written, so that the join sees two plain shuffles and Spark can split a bucket that many share.
    shared = settle(members.join(settle(sizes, "band-sizes"), "bucket"), "band-shares")
    met_by = settle(shared.groupBy("node").agg(F.sum("n").alias("degree")), "band-degrees")
    shared = shared.join(met_by, "node")
    starts = shared.groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("start")).select("bucket", F.col("start.node").alias("a"))
    meets = settle(shared.select("bucket", "node").join(settle(starts, "band-starts"), "bucket"), "band-meets")
    met = meets.where("node <> a").select("a", F.col("node").alias("b")).unionByName(fingerprint_pairs(sets.select("node", "fp")))
    first = settle(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "first-pairs")
    wanted = first.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # One text stands for all rows of its set; every text of the same set has the same similarities.
    chosen = rows.select("node", "text_key").join(wanted, "node").groupBy("node").agg(F.min("text_key").alias("text_key"))
    keyed = df.select(text_key(text).alias("text_key"), F.col(text).alias("text"))
    texts = settle(keyed.join(chosen, "text_key").dropDuplicates(["node"]).select("node", "text"), "candidate-texts")
    links = settle(similar_pairs(first, texts, least, words_per_shingle), "first-links")

    labels = components(links)
    rooted = meets.where("node <> a").join(labels, "node", "left").select("bucket", F.col("a").alias("pivot"), "node", F.coalesce("root", "node").alias("root"))
    rooted = settle(rooted, "rooted-members")
    mixed = settle(rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket"), "mixed-buckets")
    open_members = settle(rooted.join(mixed, "bucket").select("pivot", "node", "root").distinct(), "open-members")
    rest = crossing_pairs(open_members, texts, least, words_per_shingle)
    rest = settle(rest.join(first, ["a", "b"], "left_anti"), "other-pairs")
    if not rest.isEmpty():
        labels = components(links.unionByName(similar_pairs(rest, texts, least, words_per_shingle)))
    named = rows.select(id_column, "text_key", "node").join(labels, "node", "left")
    return named.select(id_column, "text_key", F.coalesce("root", "node").alias("root"))
