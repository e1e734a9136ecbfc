"""One counting pass: how often every value of every column occurs, by digest.

The columns of a row, and the row as a whole, are unpivoted in one scan and counted by a 128-bit digest, with the first
characters of the value beside it, so neither whole texts nor an expansion by column count moves. Distinct counts,
candidate keys, duplicates, missing counts and top values all follow from the same table of counts; only values that are
shown and longer than their carried beginning are read from the table again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from auditframe.functions.columns import null_safe_equal, present
from auditframe.session import materialize

#: Characters of a value that travel with its digest.
CARRIED = 64
#: The number that stands for the whole row instead of a column.
ROW = -1


def digest_pair(values: Sequence[Column]) -> tuple[Column, Column]:
    """Two 64-bit hashes that also tell which of the values are missing."""
    marked = [x for v in values for x in (v.isNull(), v)]
    return F.xxhash64(F.lit(0), *marked), F.xxhash64(F.lit(1), *marked)


def _entries(df: DataFrame, columns: Sequence[str], whole_rows: bool, carried: bool) -> Column:
    structs = []
    for i, name in enumerate(columns):
        value = present(df, name)
        one, two = digest_pair([value])
        text = value.cast("string") if carried else F.lit(None).cast("string")
        structs.append(
            F.struct(
                F.lit(i).alias("c"), F.when(value.isNotNull(), one).alias("d1"), F.when(value.isNotNull(), two).alias("d2"),
                F.substring(text, 1, CARRIED).alias("begins"), (F.length(text) > CARRIED).alias("longer"),
            )
        )
    if whole_rows:
        one, two = digest_pair([present(df, c) for c in df.columns])
        structs.append(F.struct(F.lit(ROW).alias("c"), one.alias("d1"), two.alias("d2"), F.lit(None).cast("string").alias("begins"), F.lit(None).cast("boolean").alias("longer")))
    return F.array(*structs)


def counting_pass(df: DataFrame, columns: Sequence[str] | None = None, whole_rows: bool = False, carried: bool = True, keys: Sequence[Column] = ()) -> DataFrame:
    """(keys, c, d1, d2, begins, longer, n): one row per column number and distinct value; missing values have no digest.

    ``carried=False`` leaves the beginnings of the values out, where only counts are asked for.
    """
    columns = df.columns if columns is None else columns
    entry = F.explode(_entries(df, columns, whole_rows, carried)).alias("e")
    names = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*[k.alias(n) for k, n in zip(keys, names)], entry).select(*names, "e.*")
    return rows.groupBy(*names, "c", "d1", "d2", "begins", "longer").agg(F.count(F.lit(1)).alias("n"))


def shown_values(df: DataFrame, columns: Sequence[str], shown: DataFrame) -> DataFrame:
    """``shown`` (c, d1, d2, begins, longer, …) plus ``value``: whole texts are looked up by digest, if any is longer."""
    shown = materialize(shown)
    if shown.where("longer").isEmpty():
        return shown.withColumn("value", F.col("begins"))
    structs = []
    for i, name in enumerate(columns):
        value = present(df, name)
        one, two = digest_pair([value])
        structs.append(F.struct(F.lit(i).alias("c"), one.alias("d1"), two.alias("d2"), value.cast("string").alias("value")))
    rows = df.select(F.explode(F.array(*structs)).alias("e")).where(F.length("e.value") > CARRIED)
    wanted = shown.where("longer").select(F.col("c").alias("wc"), F.col("d1").alias("w1"), F.col("d2").alias("w2"))
    match = null_safe_equal([F.col("e.c"), F.col("e.d1"), F.col("e.d2")], [F.col("wc"), F.col("w1"), F.col("w2")])
    texts = rows.join(wanted, match).groupBy("wc", "w1", "w2").agg(F.first("e.value").alias("text"))
    joined = shown.join(texts, (F.col("c") == F.col("wc")) & (F.col("d1") == F.col("w1")) & (F.col("d2") == F.col("w2")), "left")
    return joined.withColumn("value", F.coalesce("text", "begins")).drop("wc", "w1", "w2", "text")
