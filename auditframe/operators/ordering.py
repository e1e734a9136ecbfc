"""Global row positions over arbitrarily large, arbitrarily skewed tables.

A window without ``PARTITION BY`` runs in one task. The functions here give every row its
position in a global order using only bounded tasks:

1. the rows are range-partitioned on the sort keys. The last key is the number of the source
   partition, so that even a mass of identical rows spreads over many partitions;
2. each partition is sorted and numbered where it lies (no second shuffle);
3. the numbered rows are checkpointed, because sampled range boundaries and numbering must not
   change if a task runs again;
4. one row per partition (its size) gives the offsets, a table bounded by the partition count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from auditframe.session import materialize, shuffle_partitions, ship_with_tasks

ship_with_tasks(__name__)

# Ordered work is cut into partitions of about this many rows.
PARTITION_ROWS = 4_000_000

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the partition above 33 bits of row number


def add_positions(df: DataFrame, order: list[Column], rows: int) -> DataFrame:
    """``df`` plus ``__pos``, the 0-based position of the row in ``order``."""
    numbered = _sorted_ranges(df, order, rows).withColumn("__id", F.monotonically_increasing_id())
    numbered = materialize(numbered).withColumn("__part", F.shiftright("__id", _LOCAL_BITS)).withColumn(
        "__local", F.col("__id").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    )
    offsets = _partition_offsets(numbered, F.max("__local") + 1)
    placed = numbered.join(offsets, "__part").withColumn("__pos", F.col("__first") + F.col("__local"))
    return placed.drop("__id", "__part", "__local", "__first", "__before")


def add_running_counts(counted: DataFrame, order: list[Column], count: str, rows: int) -> DataFrame:
    """A (value, count) table plus ``__from``: the rows counted before it, and ``__pos``: its own position.

    The running sum is carried through the sorted batches of a partition; a window would shuffle
    the partitions once more.
    """
    ranged = _sorted_ranges(counted, order, rows).withColumn("__part", F.spark_partition_id())
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, total = 0, 0
        for batch in batches:
            until = batch[count].cumsum() + total
            yield batch.assign(__local=range(rows, rows + len(batch)), __c=until - batch[count])
            if len(batch):
                rows, total = rows + len(batch), int(until.iloc[-1])

    numbered = materialize(ranged.mapInPandas(carry, f"{types}, __local long, __c long"))
    offsets = _partition_offsets(numbered, F.max("__local") + 1, F.sum(count))
    placed = numbered.join(offsets, "__part")
    return (
        placed.withColumn("__pos", F.col("__first") + F.col("__local"))
        .withColumn("__from", F.col("__before") + F.col("__c"))
        .drop("__part", "__local", "__c", "__first", "__before")
    )


def partitions_for(spark: SparkSession, rows: int) -> int:
    """Partitions of at most ``PARTITION_ROWS`` rows, and enough of them to keep the cores busy."""
    busy = min(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)
    return max(busy, -(-rows // PARTITION_ROWS))


def _sorted_ranges(df: DataFrame, order: list[Column], rows: int) -> DataFrame:
    """Range partitions in ``order``, sorted inside. Equal keys are spread by source partition."""
    partitions = partitions_for(df.sparkSession, rows)
    spread = df.withColumn("__src", F.spark_partition_id())
    return spread.repartitionByRange(partitions, *order, F.col("__src")).drop("__src").sortWithinPartitions(*order)


def _partition_offsets(numbered: DataFrame, rows: Column, total: Column | None = None) -> DataFrame:
    """Per range partition, the rows (and the total) of all earlier partitions.

    Only one row per range partition passes the driver, a number set by the shuffle settings.
    """
    sums = [rows.alias("rows"), (total if total is not None else F.lit(0)).alias("total")]
    sizes = numbered.groupBy("__part").agg(*sums).collect()
    offsets, first, before = [], 0, 0
    for size in sorted(sizes, key=lambda size: size["__part"]):
        offsets.append((size["__part"], first, before))
        first, before = first + size["rows"], before + size["total"]
    table = pd.DataFrame(offsets, columns=["__part", "__first", "__before"], dtype="int64")
    return numbered.sparkSession.createDataFrame(table, "__part long, __first long, __before long")


def with_halo(positioned: DataFrame, reach: int, rows: int, block_rows: int = 65_536) -> DataFrame:
    """Cut a positioned table into equal blocks; each also gets the ``reach`` rows before it.

    Adds ``__block`` and ``__own`` (false for borrowed rows). A frame of at most ``reach``
    preceding rows can then be computed block by block, whatever the group sizes are.
    """
    block_rows = max(block_rows, reach)
    block = F.floor(F.col("__pos") / F.lit(block_rows))
    lends = (F.col("__pos") % block_rows) >= block_rows - reach
    homes = F.when(lends, F.array(block, block + 1)).otherwise(F.array(block))
    lent = positioned.withColumn("__home", block).withColumn("__block", F.explode(homes))
    lent = lent.withColumn("__own", F.col("__block") == F.col("__home")).drop("__home")
    return lent.repartition(partitions_for(positioned.sparkSession, rows), "__block")
