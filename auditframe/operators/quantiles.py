"""Exact linear-interpolation percentiles by distributed selection: two scans, no global order.

The first scan sketches every column of every group. Around each wanted percentile the sketch gives a bracket of
values that is sure to hold its order statistics: it reaches further to both sides than the sketch can be wrong. The
second scan counts: values inside a bracket one by one, all others only by the brackets that they lie beyond, so the
shuffle gets a few thousandths of the values and one row per gap and task. The order statistics are then read off the
running counts of what is left; where a group still has more than ``LISTED_VALUES`` of it, splitters narrow the brackets
first, within the counted table. Both scans serve any number of columns, groups and percentiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from auditframe.functions.columns import null_safe_equal, number, ref
from auditframe.session import materialize

#: The rank error of a sketch is at most this part of its rows.
ACCURACY = 10_000
#: Counted values of one group and column that one task puts in order.
LISTED_VALUES = 2_000_000
#: Splitters of a round that narrows larger groups.
SPLITTERS = 512

Wanted = Sequence[tuple[str, str, float]]


def _columns(wanted: Wanted) -> list[str]:
    return list(dict.fromkeys(c for _, c, _ in wanted))


def _percents(wanted: Wanted, column: str) -> list[float]:
    return sorted({p for _, c, p in wanted if c == column})


def _ladder(percents: list[float]) -> list[float]:
    """Shares at doubling distances around the wanted ones, so that a bracket fits small and large groups."""
    steps = [2.0 * 2**j / ACCURACY for j in range(14)]
    return sorted({min(1.0, max(0.0, p / 100 + s)) for p in percents for x in steps for s in (x, -x)} | {0.0, 1.0})


def sketches(df: DataFrame, wanted: Wanted) -> list[Column]:
    """Aggregates of the first scan: count and sketch of each column, for a pass that runs anyway."""
    found = []
    for i, c in enumerate(_columns(wanted)):
        v = number(df, c)
        shares = F.array(*[F.lit(x) for x in _ladder(_percents(wanted, c))])
        found += [F.count(v).alias(f"__n_{i}"), F.percentile_approx(v, shares, F.lit(ACCURACY)).alias(f"__s_{i}")]
    return found


def _brackets(wanted: Wanted) -> list[Column]:
    """``__lo_<column>_<percentile>`` and ``__hi_…`` from the sketches of a group."""
    found = []
    for i, c in enumerate(_columns(wanted)):
        percents = _percents(wanted, c)
        ladder, sketch = _ladder(percents), F.col(f"__s_{i}")
        margin = F.lit(2.0 / ACCURACY) + F.lit(2.0) / F.col(f"__n_{i}")
        for j, p in enumerate(percents):
            below = sum((F.when(F.lit(x) <= F.lit(p / 100) - margin, 1).otherwise(0) for x in ladder), F.lit(0))
            above = sum((F.when(F.lit(x) < F.lit(p / 100) + margin, 1).otherwise(0) for x in ladder), F.lit(0))
            found += [F.get(sketch, F.greatest(below - 1, F.lit(0))).alias(f"__lo_{i}_{j}"), F.get(sketch, F.least(above, F.lit(len(ladder) - 1))).alias(f"__hi_{i}_{j}")]
    return found


def _greatest(values: list[Column]) -> Column:
    return F.greatest(*values) if len(values) > 1 else values[0]


def _entry(i: int, value: Column, percents: int, bound) -> Column:
    """What a value counts under: itself inside a bracket, else the highest bracket end below it (null below all)."""
    inside = F.lit(False)
    for j in range(percents):
        inside = inside | ((bound(f"__lo_{i}_{j}") <= value) & (value <= bound(f"__hi_{i}_{j}")))
    ends = [F.when(bound(f"__hi_{i}_{j}") < value, bound(f"__hi_{i}_{j}")) for j in range(percents)]
    return F.struct(F.lit(i).alias("c"), F.when(inside, value).otherwise(_greatest(ends)).alias("v"), (~inside).alias("gap"), value.isNotNull().alias("filled"))


def grouped_percentiles(
    df: DataFrame, keys: Sequence[str], wanted: Wanted, nearest_rank: Sequence[str] = (), sketched: DataFrame | None = None
) -> DataFrame:
    """One row per group that has a value, with each wanted ``(alias, column, percent)``.

    The aliases in ``nearest_rank`` take the smallest value that covers the percentage instead of
    interpolating. ``sketched``: a written table of the groups that already has ``sketches``, under
    the names ``keys``.
    """
    columns = _columns(wanted)
    names = [f"__k{i}" for i in range(len(keys))]
    if sketched is None:
        sketched = materialize(df.groupBy(*[ref(k) for k in keys]).agg(*sketches(df, wanted)))
    bounds = sketched.select(*[ref(k).alias(f"{n}_b") for k, n in zip(keys, names)], *_brackets(wanted))
    rows = df.select(*[ref(k).alias(n) for k, n in zip(keys, names)], *[number(df, c).alias(f"__v{i}") for i, c in enumerate(columns)])
    if keys:
        rows = rows.join(bounds, null_safe_equal([F.col(n) for n in names], [F.col(f"{n}_b") for n in names]))
        bound = F.col
    else:
        only = bounds.first()

        def bound(name: str) -> Column:
            return F.lit(only[name]).cast("double")

    entries = F.array(*[_entry(i, F.col(f"__v{i}"), len(_percents(wanted, c)), bound) for i, c in enumerate(columns)])
    counted = (
        rows.select(*names, F.explode(entries).alias("e"))
        .where("e.filled")
        .groupBy(*names, F.col("e.c").alias("__c"), F.col("e.v").alias("__v"), F.col("e.gap").alias("__gap"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    counted = _narrowed(materialize(counted), names, wanted, nearest_rank)
    return _read_off(counted, names, wanted, nearest_rank).withColumnsRenamed(dict(zip(names, keys)))


def _ranks(total: Column, percent: float, nearest: bool) -> Column:
    """The 0-based position of a percentile, with a fraction where it is interpolated."""
    share = F.lit(percent / 100.0)
    return F.greatest(F.ceil(total * share) - 1, F.lit(0)).cast("double") if nearest else (total - 1) * share


def _running(counted: DataFrame, names: list[str], order: list[Column]) -> DataFrame:
    by = Window.partitionBy(*names, "__c")
    upto = F.sum("__n").over(by.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("__upto", upto).withColumn("__total", F.sum("__n").over(by))


def _read_off(counted: DataFrame, names: list[str], wanted: Wanted, nearest_rank: Sequence[str]) -> DataFrame:
    columns = _columns(wanted)
    placed = _running(counted, names, [F.col("__v").asc_nulls_first(), F.col("__gap")])
    lost = F.raise_error(F.lit("An order statistic lies outside its bracket: the sketch was less exact than it states."))
    value = F.when(F.col("__gap"), lost.cast("double")).otherwise(F.col("__v"))
    aggregates = []
    for alias, column, percent in wanted:
        at = _ranks(F.col("__total"), percent, alias in nearest_rank)
        own = F.col("__c") == columns.index(column)

        def statistic(rank: Column) -> Column:
            return F.max(F.when(own & (F.col("__upto") - F.col("__n") <= rank) & (rank < F.col("__upto")), value))

        low, high, share = statistic(F.floor(at)), statistic(F.ceil(at)), F.max(F.when(own, at - F.floor(at)))
        aggregates.append((low + (high - low) * share).alias(alias))
    return placed.groupBy(*names).agg(*aggregates)


def _narrowed(counted: DataFrame, names: list[str], wanted: Wanted, nearest_rank: Sequence[str]) -> DataFrame:
    """Fold what no wanted rank can lie in, until every group and column has few values left."""
    columns = _columns(wanted)
    group = [*names, "__c"]
    while True:
        most = counted.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
        if most <= LISTED_VALUES:
            return counted
        shares = F.array(*[F.lit(i / SPLITTERS) for i in range(SPLITTERS + 1)])
        splitters = counted.groupBy(*group).agg(F.percentile_approx("__v", shares, F.lit(ACCURACY)).alias("__s"))
        splitters = splitters.withColumnsRenamed({n: f"{n}_s" for n in group})
        same = null_safe_equal([F.col(n) for n in group], [F.col(f"{n}_s") for n in group])
        cell = F.coalesce(F.size(F.filter("__s", lambda s: s < F.col("__v"))), F.lit(-1))
        celled = counted.join(materialize(splitters), same).drop(*[f"{n}_s" for n in group], "__s").withColumn("__cell", cell)
        celled = materialize(celled)
        cells = celled.groupBy(*group, "__cell").agg(F.sum("__n").alias("__n"))
        placed = _running(cells, names, [F.col("__cell")])
        kept = F.lit(False)
        for alias, column, percent in wanted:
            at = _ranks(F.col("__total"), percent, alias in nearest_rank)
            touched = (F.col("__upto") - F.col("__n") <= F.ceil(at)) & (F.floor(at) < F.col("__upto"))
            kept = kept | ((F.col("__c") == columns.index(column)) & touched)
        marks = materialize(placed.select(*[F.col(n).alias(f"{n}_m") for n in group], F.col("__cell").alias("__cell_m"), kept.alias("__kept")))
        at_cell = null_safe_equal([F.col(n) for n in [*group, "__cell"]], [F.col(f"{n}_m") for n in [*group, "__cell"]])
        joined = celled.join(marks, at_cell)
        whole = joined.where("__kept or __cell = -1").select(*group, "__v", "__gap", "__n")
        # a cell without a wanted rank is one gap that sorts where its values did
        folded = joined.where("not __kept and __cell >= 0").groupBy(*group, "__cell").agg(F.max("__v").alias("__v"), F.lit(True).alias("__gap"), F.sum("__n").alias("__n"))
        counted = materialize(whole.unionByName(folded.drop("__cell")))
        if (counted.groupBy(*group).count().agg(F.max("count")).first()[0] or 0) >= most:
            return counted


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join two tables with one row per key; missing keys match missing keys."""
    if not keys:
        only = right.first()
        return left.withColumns({f.name: F.lit(only[f.name]).cast(f.dataType) for f in right.schema.fields})
    renamed = right.withColumnsRenamed({k: f"__r_{i}" for i, k in enumerate(keys)})
    right_keys = [F.col(f"__r_{i}") for i in range(len(keys))]
    joined = left.join(renamed, null_safe_equal([ref(k) for k in keys], right_keys), how)
    if how == "full_outer":
        for i, k in enumerate(keys):
            joined = joined.withColumn(k, F.coalesce(ref(k), F.col(f"__r_{i}")))
    return joined.drop(*[f"__r_{i}" for i in range(len(keys))])
