"""Exact cosine retrieval over dense or sparse vectors, and its evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from auditframe.errors import RefusedError
from auditframe.functions.text import VECTOR_BUCKETS
from auditframe.guards import Guard, refuse_if
from auditframe.session import materialize, ship_with_tasks

ship_with_tasks(__name__)

# Items and queries that meet in one step of a task.
BLOCK_ITEMS, BLOCK_QUERIES = 4096, 1024
# Numbers of a block's vectors; a block of long vectors has fewer of them.
BLOCK_ENTRIES = 1 << 20
# Scores are compared at this precision, so that equal vectors tie and the id decides.
SCORE_DIGITS = 9
# What a bound may miss by rounding.
_SLACK = 10.0 ** (1 - SCORE_DIGITS)


def validate_vectors(df: DataFrame, vector: str, dimension: int) -> None:
    """Refuse vectors of another dimension or with non-finite values."""
    v = F.col(vector)
    refuse_if(
        df,
        [
            Guard(f"{{n}} embedding(s) do not have dimension {dimension}.", v.isNull() | (F.size(v) != dimension)),
            Guard(
                "{n} embedding(s) contain a non-finite value.",
                F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))),
            ),
        ],
    )


def require_space(df: DataFrame, provider: str, model: str, dimensions: int) -> DataFrame:
    """Only vectors of one provider, model and dimension may be compared."""
    return df.filter(
        (F.col("embedding_provider") == provider)
        & (F.col("embedding_model") == model)
        & (F.col("embedding_dimensions") == dimensions)
    )


def top_k(scores: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """Best ``k`` items per query, ties by item id. Tasks drop all but their own best first."""
    best = Window.partitionBy(query).orderBy(F.col("score").desc(), F.col(item))
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def dense_top_k(
    items: DataFrame, queries: DataFrame, item: str, query: str, vector: str, k: int, block_items: int = BLOCK_ITEMS,
    block_queries: int = BLOCK_QUERIES, report: Observation | None = None,
) -> DataFrame:
    """Exact cosine top-k over dense vectors, ties by item id.

    Queries are validated up front; the stored vectors are checked where they are packed, which
    spares a second scan of them.
    """
    first = queries.select(F.size(vector)).first()
    if first is None:
        raise RefusedError("There are no queries to search for.")
    width = first[0]
    validate_vectors(queries, vector, width)
    return _search(items, queries, item, query, [vector], k, partial(_DenseBlock, width), block_items, block_queries, report)


def sparse_top_k(
    items: DataFrame, queries: DataFrame, item: str, query: str, k: int, width: int = VECTOR_BUCKETS, block_items: int = BLOCK_ITEMS,
    block_queries: int = BLOCK_QUERIES, report: Observation | None = None,
) -> DataFrame:
    """Exact cosine top-k over sparse vectors given as ``buckets`` and ``weights`` arrays.

    Texts without a word have an empty vector, score 0 and take part like any other. To search a
    selection of documents, pass only their vectors as ``items``.
    """
    if queries.isEmpty():
        raise RefusedError("There are no queries to search for.")
    return _search(items, queries, item, query, ["buckets", "weights"], k, partial(_SparseBlock, width), block_items, block_queries, report)


class _SparseBlock:
    """An inverted index over the buckets of a block of vectors, with the largest weight of every list.

    A query reads its lists from the one that can add most. Once what the rest can add stays below the
    floor, no new vector can reach it; those already met whose sum and rest stay below it go, and only
    the others get their full score.
    """

    def __init__(self, width: int, block: dict):
        self.width, sizes = width, np.asarray(block["sizes"])
        self.buckets, weights = np.asarray(block["first"], dtype=np.int64), np.asarray(block["second"], dtype=float)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        norms = np.sqrt(np.bincount(self.owner, weights * weights, len(sizes)))
        self.weights = weights / norms[self.owner] if len(weights) else weights
        self.starts, self.count = np.append(0, np.cumsum(sizes)), len(sizes)

    def invert(self) -> None:
        order = np.argsort(self.buckets, kind="stable")
        self.list_owner, self.list_weight = self.owner[order], self.weights[order]
        self.list_start = np.searchsorted(self.buckets[order], np.arange(self.width + 1))
        self.most = np.zeros(self.width)
        np.maximum.at(self.most, self.buckets, np.abs(self.weights))

    def query(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.starts[row], self.starts[row + 1])
        return self.buckets[own], self.weights[own]

    def _sums(self, buckets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [slice(self.list_start[b], self.list_start[b + 1]) for b in buckets.tolist()]
        if not parts:
            return np.zeros(self.count), np.zeros(0, dtype=np.int64)
        owner = np.concatenate([self.list_owner[x] for x in parts])
        added = np.concatenate([self.list_weight[x] * w for x, w in zip(parts, weights.tolist())])
        return np.bincount(owner, added, self.count).astype(float), owner  # of no entries it counts in integers

    def scores(self, query: tuple[np.ndarray, np.ndarray], floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Vectors that can reach ``floor`` and their scores."""
        buckets, weights = query
        can_add = np.abs(weights) * self.most[buckets]
        order = np.argsort(-can_add, kind="stable")
        buckets, weights, can_add = buckets[order], weights[order], can_add[order]
        rest = np.append(np.cumsum(can_add[::-1])[::-1], 0.0)
        if floor <= _SLACK:
            return np.arange(self.count), self._sums(buckets, weights)[0]
        needed = int(np.searchsorted(-rest, -(floor - _SLACK), side="right"))
        if not needed:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        sums, met = self._sums(buckets[:needed], weights[:needed])
        near = np.zeros(self.count, dtype=bool)
        near[met] = True
        found = np.flatnonzero(near & (sums + rest[needed] >= floor - _SLACK))
        if len(found) and needed < len(buckets):
            sums = sums + self._sums(buckets[needed:], weights[needed:])[0]
        return found, sums[found]


class _DenseBlock:
    """Unit vectors by distance from their mean: a score is at most the mean's plus that distance.

    The farthest come first, so the vectors that can reach a floor are a leading part of the block.
    """

    def __init__(self, width: int, block: dict):
        sizes = np.asarray(block["sizes"])
        if (sizes != width).any():
            raise ValueError(f"Stored and query embedding dimensions do not match (expected {width}).")
        matrix = np.asarray(block["second"], dtype=float).reshape(-1, width)
        if not np.isfinite(matrix).all():
            raise ValueError("A stored embedding contains a non-finite value.")
        norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        self.matrix, self.count = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0), len(matrix)

    def invert(self) -> None:
        self.mean = self.matrix.mean(axis=0)
        away = np.sqrt(((self.matrix - self.mean) ** 2).sum(axis=1))
        self.order = np.argsort(-away, kind="stable")
        self.away, self.far_first = away[self.order], self.matrix[self.order]

    def query(self, row: int) -> np.ndarray:
        return self.matrix[row]

    def scores(self, query: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        reach = int(np.searchsorted(-self.away, -(floor - _SLACK - float(query @ self.mean)), side="right"))
        return self.order[:reach], self.far_first[:reach] @ query


def _pack(df: DataFrame, key: str, vector: list[str], rows: int) -> DataFrame:
    """Rows of up to ``rows`` vectors and about ``BLOCK_ENTRIES`` numbers each, packed where they lie: ids, sizes and the numbers."""
    kind = df.schema[key].dataType.simpleString()

    def one(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries = np.cumsum(batch.column(1).value_lengths().fill_null(0).to_numpy())
            start = 0
            while start < batch.num_rows:
                before = entries[start - 1] if start else 0
                full = int(np.searchsorted(entries, before + BLOCK_ENTRIES, side="right"))
                some = batch.slice(start, min(max(full - start, 1), rows))
                start += some.num_rows
                lists = [some.column(i) for i in range(1, some.num_columns)]
                sizes = lists[0].value_lengths().fill_null(0)
                flat = [x.flatten() for x in lists]
                first = flat[0].cast(pa.int32()) if len(flat) == 2 else pa.array([], pa.int32())
                second = flat[-1].cast(pa.float64())
                if second.null_count:
                    raise ValueError("A stored embedding contains a non-finite value.")
                yield pa.RecordBatch.from_arrays([one(x) for x in (some.column(0), sizes, first, second)], ["ids", "sizes", "first", "second"])

    return df.select(key, *vector).mapInArrow(over, f"ids array<{kind}>, sizes array<int>, first array<int>, second array<double>")


def _search(
    items: DataFrame, queries: DataFrame, item: str, query: str, vector: list[str], k: int, block_of: Callable, block_items: int,
    block_queries: int, report: Observation | None,
) -> DataFrame:
    """Blocks of items meet blocks of queries, each pair once and in a task of its own, at every size of either side.

    A first round lets every block of queries meet a few blocks of items. Its ``k``-th best scores are
    floors: in the second round, over all other pairs, a vector whose bound stays below the floor is
    not scored. ``report`` observes ``scored_pairs`` next to the pairs there are.
    """
    item_blocks = _numbered(_pack(items, item, vector, block_items)).withColumnRenamed("__n", "__i")
    query_blocks = _numbered(_pack(queries, query, vector, block_queries)).withColumnRenamed("__n", "__q")
    n_items, n_queries = item_blocks.count(), query_blocks.count()
    types = f"{query} {queries.schema[query].dataType.simpleString()}, {item} {items.schema[item].dataType.simpleString()}, score double, __asked long, __scored long, __pairs long"
    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        stored, asked = block_of(_only_row(left)), block_of(_only_row(right))
        stored.invert()
        ids, names = left.column("ids")[0].values, right.column("ids")[0].values
        floors, number = right.column("floors")[0].as_py() or [], right.column("__q")[0].as_py()
        floors = dict((x["at"], x["floor"]) for x in floors)
        best, scored = [], 0
        for at in range(asked.count):
            found, scores = stored.scores(asked.query(at), floors.get(at, -np.inf))
            scored += len(found)
            scores = np.round(scores, SCORE_DIGITS)
            kept = _leading(scores, ids, found, k)
            best.append((np.full(len(kept), at), found[kept], scores[kept]))
        at, place, score = (np.concatenate(x) for x in zip(*best))
        rows = [names.take(pa.array(at)), ids.take(pa.array(place)), pa.array(score), pa.array(at + number * block_queries), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64())]
        last = [pa.nulls(1, names.type), pa.nulls(1, ids.type), pa.nulls(1, pa.float64()), pa.nulls(1, pa.int64()), pa.array([scored]), pa.array([asked.count * stored.count])]
        return pa.table([pa.chunked_array([x, y]) for x, y in zip(rows, last)], names=[query, item, "score", "__asked", "__scored", "__pairs"])

    def met(pair: Column, asked: DataFrame) -> DataFrame:
        both = _each(item_blocks, "__q", n_queries).where(pair).groupBy("__i", "__q")
        return both.cogroup(_each(asked, "__i", n_items).where(pair).groupBy("__i", "__q")).applyInArrow(meet, types)

    slots = max(1, n_items // 2)
    first_pairs = F.pmod("__i", F.lit(slots)) == F.pmod("__q", F.lit(slots))
    nothing = F.lit(None).cast("array<struct<at:int,floor:double>>")
    first = materialize(met(first_pairs, query_blocks.withColumn("floors", nothing)))
    if n_items > 1:
        ranked = Window.partitionBy("__asked").orderBy(F.col("score").desc())
        placed = first.where("__scored is null").select("__asked", "score", F.row_number().over(ranked).alias("place")).where(F.col("place") == k)
        entry = F.struct((F.col("__asked") % block_queries).cast("int").alias("at"), F.col("score").alias("floor"))
        floors = placed.groupBy(F.floor(F.col("__asked") / block_queries).alias("__q")).agg(F.collect_list(entry).alias("floors"))  # one per query of a block
        first = first.unionByName(met(~first_pairs, query_blocks.join(floors, "__q", "left")))
    if report is not None:
        first = first.observe(report, F.coalesce(F.sum("__scored"), F.lit(0)).alias("scored_pairs"), F.coalesce(F.sum("__pairs"), F.lit(0)).alias("pairs"))
    return top_k(first.where("__scored is null").select(query, item, "score"), query, item, k)


def _only_row(block: pa.Table) -> dict:
    return {name: block.column(name)[0].values.to_numpy(zero_copy_only=False) for name in ("sizes", "first", "second")}


def _leading(scores: np.ndarray, ids: pa.Array, found: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties by id."""
    if len(scores) <= k:
        return np.arange(len(scores))
    kept = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    if len(kept) > k:
        names = ids.take(pa.array(found[kept])).to_numpy(zero_copy_only=False)
        names = names.astype(str) if names.dtype == object else names
        kept = kept[np.lexsort((names, -scores[kept]))[:k]]
    return kept


def _numbered(blocks: DataFrame) -> DataFrame:
    """Written blocks with consecutive numbers ``__n``; a row per partition passes the driver for it."""
    written = materialize(blocks.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = {r[0]: r[1] for r in written.groupBy(part.alias("p")).count().collect()}
    first, firsts = 0, {}
    for p in sorted(sizes):
        firsts[p], first = first, first + sizes[p]
    if not firsts:
        return written.withColumn("__n", F.lit(0).cast("long")).drop("__id")
    starts = written.sparkSession.createDataFrame([(p, n) for p, n in firsts.items()], "__p long, __first long")
    numbered = written.withColumn("__p", part.cast("long")).join(F.broadcast(starts), "__p")  # one row per partition
    return numbered.withColumn("__n", F.col("__first") + F.col("__id") - F.shiftleft("__p", 33)).drop("__id", "__p", "__first")


def _each(blocks: DataFrame, other: str, others: int) -> DataFrame:
    """Every block once for each block of the other side."""
    if not others:
        return blocks.withColumn(other, F.lit(0).cast("long")).where("false")
    return blocks.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))


def hit_metrics(ranked: DataFrame, expected: DataFrame, query: str, item: str) -> DataFrame:
    """Hit@k and mean reciprocal rank of retrieved rankings against one expected item per query."""
    wanted = expected.select(F.col(query), F.col(item).alias("__expected"))
    placed = wanted.join(ranked.select(query, F.col(item).alias("__item"), "rank"), query, "left")
    per_query = placed.groupBy(query).agg(F.min(F.when(F.col("__item") == F.col("__expected"), F.col("rank"))).alias("rank"))
    return per_query.agg(
        F.count(F.lit(1)).alias("query_count"),
        F.avg(F.when(F.col("rank").isNotNull(), 1.0).otherwise(0.0)).alias("hit_at_k"),
        F.avg(F.coalesce(F.try_divide(F.lit(1.0), F.col("rank")), F.lit(0.0))).alias("mean_reciprocal_rank"),
    )
