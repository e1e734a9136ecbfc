"""Cosine near-duplicates of embeddings by a pigeonhole join over rotated subspaces.

For unit vectors, cosine >= c means a squared distance <= 2 - 2c. After a rotation the dimensions are
cut into blocks; a pair within the distance is, in at least one block, within that block's share of it
(its share of the dimensions). So each block is range-joined on its own: vectors fall into grid cells
of the block's leading dimensions, visit the cells that their radius touches, and a cell finds its
pairs with one small matrix product. A pair is verified on the whole vectors in double precision, and
counted in the first block only in which it is within budget. From a cell leave, per vector, a count
and a link to one vector of its class; pairs never leave it.

Equal vectors are folded to one with a weight before anything is joined, so thousands of copies cost
one. A crowded cell is dealt out to several tasks as a grid of residents by visitors, each of bounded
size.

Defined cases: a null label, a null, empty or zero vector, or one with null or non-finite components
links with nothing. Vectors of different lengths never link. Rows that repeat are vectors of their own
and link with each other.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.llm.common import settle
from auditframe.llm.components import components
from auditframe.llm.simhash import merge_labels
from auditframe.session import ship_with_tasks

ship_with_tasks(__name__)

BLOCKS = 8
#: Leading dimensions of a block that make its grid, and the cell width in radii.
GRID_DIMENSIONS = 3
CELL_RADII = 3.0
#: Residents and visitors that one task compares at once.
CELL_ROWS = 4096
#: Added to squared radii, far above the rounding of unit vectors in double precision.
SLACK = 1e-9


def rotation(size: int, seed: int = 7) -> np.ndarray:
    """A random rotation of the given size, the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def block_edges(size: int, blocks: int = BLOCKS) -> list[int]:
    blocks = min(blocks, size)
    return [round(i * size / blocks) for i in range(blocks + 1)]


def usable(vector: str, label: str) -> Column:
    """Whether a row can link at all."""
    value = F.col(vector)
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col(label).isNotNull() & (F.size(value) > 0) & finite & F.exists(value, lambda x: x != 0), F.lit(False))


def _units(vectors: list[np.ndarray]) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that huge and tiny components survive squaring."""
    rows = np.stack(vectors).astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _cells(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All integer cells of the box low..high (one row), as rows."""
    axes = [np.arange(a, b + 1) for a, b in zip(low, high)]
    return np.stack([x.ravel() for x in np.meshgrid(*axes, indexing="ij")], axis=1)


def visits(budget: float):
    """For every vector and block: its home cell, and the other cells its radius touches."""

    def over(batches):
        for batch in batches:
            names, labels, vectors = batch.column(0), batch.column(1), batch.column(2)
            sizes = np.array([len(x) for x in vectors.to_pylist()])
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                units = _units([np.array(x) for x in vectors.take(pa.array(rows)).to_pylist()]) @ rotation(size)
                edges = block_edges(size)
                picked, block_of, cell_of, home_of = [], [], [], []
                for block, (start, stop) in enumerate(zip(edges, edges[1:])):
                    radius = math.sqrt(budget * (stop - start) / size + SLACK)
                    leading = units[:, start:min(stop, start + GRID_DIMENSIONS)] / (radius * CELL_RADII)
                    home = np.floor(leading).astype(np.int64)
                    low, high = np.floor(leading - 1 / CELL_RADII).astype(np.int64), np.floor(leading + 1 / CELL_RADII).astype(np.int64)
                    for i in range(len(rows)):
                        cells = _cells(low[i], high[i])
                        picked += [rows[i]] * len(cells)
                        block_of += [block] * len(cells)
                        cell_of += [",".join(map(str, c)) for c in cells.tolist()]
                        home_of += (cells == home[i]).all(axis=1).tolist()
                taken = pa.array(picked, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [names.take(taken), labels.take(taken), pa.array([size] * len(picked), pa.int32()), pa.array(block_of, pa.int32()), pa.array(cell_of), pa.array(home_of)],
                    ["node", "label", "size", "block", "cell", "home"],
                )

    return over


def search_cell(threshold: float, budget: float):
    """Links inside one share of a cell: (node, weight linked, representative of its class)."""

    def over(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.reset_index(drop=True)
        size, block = int(frame["size"][0]), int(frame["block"][0])
        units = _units([np.asarray(x) for x in frame["vector"]])
        turned = units @ rotation(size)
        edges = block_edges(size)
        parts = [turned[:, a:b] for a, b in zip(edges, edges[1:])]
        limits = [budget * (b - a) / size + SLACK for a, b in zip(edges, edges[1:])]
        squares = [(p * p).sum(axis=1) for p in parts]
        home = np.flatnonzero(frame["home"].to_numpy())
        codes, nodes = pd.factorize(frame["node"], sort=True)  # a resident is also among the visitors
        linked = np.zeros(len(nodes), dtype=np.int64)
        labels = np.arange(len(nodes))
        weight = frame["weight"].to_numpy()
        guests = np.flatnonzero(frame["guest"].to_numpy())
        for start in range(0, len(home), 256):
            rows = home[start:start + 256]

            def near(b):
                return squares[b][rows][:, None] + squares[b][guests][None, :] - 2 * parts[b][rows] @ parts[b][guests].T <= limits[b]

            candidate = near(block) & (codes[rows][:, None] < codes[guests][None, :])
            for earlier in range(block):
                if not candidate.any():
                    break
                candidate &= ~near(earlier)
            i, j = np.nonzero(candidate)
            i, j = rows[i], guests[j]
            true = np.einsum("ij,ij->i", units[i], units[j]) >= threshold
            a, b = codes[i[true]], codes[j[true]]
            np.add.at(linked, a, weight[j[true]])
            np.add.at(linked, b, weight[i[true]])
            labels = merge_labels(labels, a, b)
        found = np.flatnonzero(linked)
        return pd.DataFrame({"node": nodes.to_numpy()[found], "linked": linked[found], "root": nodes.to_numpy()[labels[found]]})

    return over


def near_vectors(df: DataFrame, threshold: float = 0.93, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept): one row per row of ``df``.

    n_links counts the other rows linked directly, component_id is the smallest id reachable, kept
    marks the rows whose id that is. Null ids are members, but name a component only where it has no
    other id.
    """
    budget = 2 - 2 * threshold
    rows = df.select(F.col(id_column).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    node = F.md5(F.concat_ws("|", F.col("label").cast("string"), F.col("vector").cast("string")).cast("binary"))
    rows = settle(rows.withColumn("node", F.when(usable("vector", "label"), node)), "vectors")
    nodes = settle(
        rows.where("node is not null").groupBy("node").agg(F.count("*").alias("weight"), F.min("id").alias("low_id"), F.first("label").alias("label"), F.first("vector").alias("vector")),
        "distinct-vectors",
    )
    kinds = dict(rows.dtypes)
    cell_key = ["label", "size", "block", "cell"]
    placed = settle(
        nodes.select("node", "label", "vector").mapInArrow(visits(budget), f"node string, label {kinds['label']}, size int, block int, cell string, home boolean"),
        "vector-cells",
    )
    crowd = settle(placed.groupBy(*cell_key).agg(F.count(F.when(F.col("home"), 1)).alias("residents"), F.count("*").alias("visitors")).where("residents > 0 and visitors > 1"), "cell-counts")
    # Residents go to one row of the share grid of their cell, visitors (residents too) to one column.
    spread = placed.join(crowd, cell_key).select(
        "*", F.ceil(F.col("residents") / CELL_ROWS).cast("int").alias("down"), F.ceil(F.col("visitors") / CELL_ROWS).cast("int").alias("across"), F.abs(F.xxhash64("node")).alias("deal")
    )
    residents = spread.where("home").select("node", *cell_key, F.lit(True).alias("home"), F.lit(False).alias("guest"), (F.col("deal") % F.col("down")).cast("int").alias("share_row"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("share_column"))
    guests = spread.select("node", *cell_key, F.lit(False).alias("home"), F.lit(True).alias("guest"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("share_row"), (F.col("deal") % F.col("across")).cast("int").alias("share_column"))
    shares = residents.unionByName(guests).join(nodes.select("node", "weight", "vector"), "node")
    found = settle(
        shares.groupBy(*cell_key, "share_row", "share_column").applyInPandas(search_cell(threshold, budget), "node string, linked bigint, root string"),
        "vector-links",
    )
    totals = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    labels = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    rooted = (
        nodes.select("node", "weight", "low_id").join(labels, "node", "left").join(totals, "node", "left")
        .select("node", "weight", "low_id", F.coalesce("root", "node").alias("root"), F.coalesce("linked", F.lit(0)).alias("linked"))
    )
    rooted = settle(rooted, "rooted-vectors")
    lows = settle(rooted.groupBy("root").agg(F.min("low_id").alias("component_id")), "component-names")
    named = rooted.join(lows, "root").select("node", (F.col("linked") + F.col("weight") - 1).alias("n_links"), "component_id")
    linkable = rows.where("node is not null").join(named, "node").select("id", "n_links", "component_id")
    alone = rows.where("node is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linkable.unionByName(alone).select(F.col("id").alias(id_column), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
