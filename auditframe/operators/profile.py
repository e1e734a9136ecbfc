"""Inspection, profiling, duplicates, candidate keys and category snapshots.

Counters of all columns share one wide aggregate. Values are counted by digest in one unpivoted pass
(``counting``), from which duplicates, candidate keys, distinct counts and top values follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from auditframe.functions.columns import family, is_numeric, missing, number, present, ref
from auditframe.operators.counting import ROW, counting_pass, shown_values
from auditframe.operators.quantiles import grouped_percentiles, join_on_keys, sketches
from auditframe.session import materialize

TOP_VALUES = 5
MAX_LISTED_VALUES = 100
MAX_LISTED_LENGTH = 200


def _rows_from(one_row: DataFrame, structs: list[Column], fields: list[str]) -> DataFrame:
    """Turn one wide row into one row per struct."""
    return one_row.select(F.explode(F.array(*structs)).alias("s")).select(*[F.col(f"s.{f}").alias(f) for f in fields])


def missing_counts(df: DataFrame) -> DataFrame:
    """One wide row: the row count and the missing count of every column (``m0``, ``m1``, …)."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)],
    )


def inspect_columns(df: DataFrame) -> DataFrame:
    """Per column: position, type, missing count and missing percentage."""
    structs = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col("row_count"),
            F.col(f"m{i}").alias("missing_count"),
            F.coalesce(F.round(F.try_divide(F.col(f"m{i}") * 100.0, F.col("row_count")), 2), F.lit(0.0)).alias(
                "missing_percentage"
            ),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    fields = ["position", "column_name", "data_type", "row_count", "missing_count", "missing_percentage"]
    return _rows_from(missing_counts(df), structs, fields)


def duplicate_rows(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Rows beyond the first of each fully equal row; missing values equal each other.

    ``counts``: a ``counting_pass`` over whole rows that ran already.
    """
    groups = (counting_pass(df, [], True) if counts is None else counts).where(F.col("c") == ROW)
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_row_count"),
    )


def inspect_dataset(df: DataFrame) -> DataFrame:
    """One row: row count, column count, duplicate rows."""
    return duplicate_rows(df).select(
        "row_count", F.lit(len(df.columns)).cast("long").alias("column_count"), "duplicate_row_count"
    )


def uniqueness_violations(df: DataFrame, column: str) -> DataFrame:
    """Number of rows that share their value of ``column`` with another row."""
    groups = counting_pass(df, [column], carried=False)
    return groups.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("violating_rows"))


def candidate_keys(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Per column: whether it has no missing value and as many distinct values as rows."""
    counts = counting_pass(df, carried=False) if counts is None else counts
    per_column = counts.groupBy("c").agg(F.sum("n").alias("rows"), F.count("d1").alias("distinct"), F.sum(F.when(F.col("d1").isNotNull(), F.col("n"))).alias("filled"))
    names = df.sparkSession.createDataFrame(list(enumerate(df.columns)), "c int, column_name string")
    distinct = F.coalesce("distinct", F.lit(0))
    unique = (F.col("rows") > 0) & (F.col("filled") == F.col("rows")) & (F.col("distinct") == F.col("rows"))
    return names.join(per_column, "c", "left").select(
        "column_name", distinct.alias("distinct_count"), F.coalesce(unique, F.lit(False)).alias("is_candidate_key")
    )


def profile_numeric(df: DataFrame) -> DataFrame:
    """Per numeric column: count, missing, mean, minimum, maximum, exact median."""
    columns = [c for c in df.columns if is_numeric(df, c)]
    wanted = [(f"p{i}", c, 50.0) for i, c in enumerate(columns)]
    basics = [
        F.count(F.lit(1)).alias("row_count"),
        *[F.count(number(df, c)).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.avg(number(df, c)).alias(f"a{i}") for i, c in enumerate(columns)],
        *[F.min(number(df, c)).alias(f"l{i}") for i, c in enumerate(columns)],
        *[F.max(number(df, c)).alias(f"h{i}") for i, c in enumerate(columns)],
    ]
    base = materialize(df.agg(*basics, *sketches(df, wanted)))
    wide = join_on_keys(base, grouped_percentiles(df, [], wanted, sketched=base), [], "left")
    structs = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"n{i}").alias("value_count"),
            (F.col("row_count") - F.col(f"n{i}")).alias("missing_count"),
            F.col(f"a{i}").alias("mean"),
            F.col(f"l{i}").alias("minimum"),
            F.col(f"h{i}").alias("maximum"),
            F.col(f"p{i}").alias("median"),
        )
        for i, c in enumerate(columns)
    ]
    fields = ["column_name", "value_count", "missing_count", "mean", "minimum", "maximum", "median"]
    return _rows_from(wide, structs, fields)


def categorical_columns(df: DataFrame, booleans: bool = True) -> list[str]:
    return [c for c in df.columns if not is_numeric(df, c) and (booleans or family(df.schema[c].dataType) != "boolean")]


def profile_categorical(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Top values per non-numeric column with the column's count, missing count and distinct count.

    Ties are broken by value. ``counts``: a written ``counting_pass`` over all columns that ran already.
    """
    columns = categorical_columns(df)
    if counts is None:
        numbers, counted = {c: i for i, c in enumerate(columns)}, materialize(counting_pass(df, columns))
    else:
        numbers = {c: i for i, c in enumerate(df.columns) if c in columns}
        counted = counts.where(F.col("c").isin(*numbers.values()))
    missing_ones = F.col("d1").isNull()
    totals = counted.groupBy("c").agg(
        F.coalesce(F.sum(F.when(missing_ones, F.col("n"))), F.lit(0)).alias("missing_count"),
        F.coalesce(F.sum(F.when(~missing_ones, F.col("n"))), F.lit(0)).alias("value_count"), F.count("d1").alias("unique_count"),
    )
    # Values that begin alike tie here, and are told apart once their texts are known.
    near = Window.partitionBy("c").orderBy(F.col("n").desc(), F.col("begins"))
    leading = counted.where(~missing_ones).withColumn("place", F.rank().over(near)).where(F.col("place") <= TOP_VALUES)
    order = Window.partitionBy("c").orderBy(F.col("n").desc(), F.col("value"))
    all_columns = columns if counts is None else df.columns
    top = shown_values(df, all_columns, leading).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_VALUES)
    names = df.sparkSession.createDataFrame([(i, c) for c, i in numbers.items()], "c int, column_name string")
    # One row per column on two sides and at most five on the third.
    return (
        names.join(totals, "c", "left")
        .join(top.select("c", "rank", "value", "n"), "c", "left")
        .select(
            "column_name",
            F.coalesce("value_count", F.lit(0)).alias("value_count"),
            F.coalesce("missing_count", F.lit(0)).alias("missing_count"),
            F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
            "rank",
            "value",
            F.col("n").alias("frequency"),
        )
    )


def category_snapshot(df: DataFrame) -> DataFrame:
    """Distinct values of every non-numeric column, listed only when the set is small.

    ``category_values`` is complete or empty: more than 100 values, or one longer than 200
    characters, gives the count alone. Only complete sets are ever gathered into one list, and
    long values, which are never listed, are counted by their digest instead of being shuffled.
    """
    columns = categorical_columns(df)
    texts = {c: present(df, c).cast("string") for c in columns}
    long = {c: F.length(v) > MAX_LISTED_LENGTH for c, v in texts.items()}
    entries = [
        F.struct(F.lit(c).alias("c"), F.when(long[c], F.sha2(v, 256)).otherwise(v).alias("v"), long[c].alias("long"))
        for c, v in texts.items()
    ]
    exploded = df.select(F.explode(F.array(*entries)).alias("e")).select(
        F.col("e.c").alias("column_name"), F.col("e.v").alias("value"), F.col("e.long").alias("long")
    )
    distinct = exploded.filter(F.col("value").isNotNull()).distinct()
    sizes = distinct.groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_count"), F.max("long").alias("any_long"))
    complete = (F.col("unique_count") <= MAX_LISTED_VALUES) & ~F.col("any_long")
    listable = sizes.filter(complete).select("column_name")  # at most one row per column
    listed = (
        distinct.join(F.broadcast(listable), "column_name")
        .groupBy("column_name")
        .agg(F.sort_array(F.collect_list("value")).alias("category_values"))
    )
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return (
        names.join(sizes, "column_name", "left")
        .join(listed, "column_name", "left")
        .select(
            "column_name",
            F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
            F.coalesce(complete, F.lit(True)).alias("values_complete"),
            F.coalesce("category_values", F.array().cast("array<string>")).alias("category_values"),
        )
    )


def category_values(df: DataFrame) -> DataFrame:
    """(column_name, digest, value): every distinct value of every non-numeric column, however many or long.

    Each column also has one row without digest and value, so that a column of missing values is known.
    """
    columns = categorical_columns(df)
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    known = names.select("column_name", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("value"))
    if not columns:
        return known
    entries = [F.struct(F.lit(c).alias("c"), present(df, c).cast("string").alias("v")) for c in columns]
    exploded = df.select(F.explode(F.array(*entries)).alias("e")).where(F.col("e.v").isNotNull())
    rows = exploded.select(F.col("e.c").alias("column_name"), F.sha2("e.v", 256).alias("digest"), F.col("e.v").alias("value"))
    return known.unionByName(rows.groupBy("column_name", "digest").agg(F.first("value").alias("value")))
