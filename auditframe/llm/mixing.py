"""Mixing sources to target weights over a tree of domains, languages and sources.

A token budget flows down the tree: at each node it is shared among the children by weight, no child
gets more than its leaves can give in ``max_epochs`` passes, and what a child cannot take goes to its
siblings by weight. Capacities are summed up the tree first, so a shortage reaches the siblings of an
ancestor only when all siblings below are full. Shares are whole tokens, rounded down.

A leaf then takes whole epochs and a prefix of one more. The order of an epoch is the md5 of seed,
epoch and id, so any machine finds it again. The prefix is found without sorting the leaf: tokens are
summed by the leading hex digits of the md5, which narrows the cut to a bucket of a bucket, and only
that bucket is ordered.

Defined cases: null path values are a path value of their own; texts without tokens take no part;
rows with equal md5 (a repeated id) stand or fall together; an empty table or a budget of zero selects
nothing; unlisted path values weigh 1, and a weight of 0 takes only what no sibling can.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditframe.llm.common import fresh, settle

#: Stands for null in paths.
NONE = "(none)"
#: Hex digits of one narrowing step, and the number of steps before rows are ordered.
DIGITS, STEPS = 2, 2


def word_tokens(text: str = "text") -> Column:
    """Tokens counted as words between blanks."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint"), F.lit(0).cast("bigint"))


def _weight(level: str, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for value, weight in weights.items():
        out = F.when(F.col(level) == value, F.lit(int(weight))).otherwise(out)
    return out


def _whole(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(19,0)")


def share_among_children(children: DataFrame, parent: Sequence[str], level: str) -> DataFrame:
    """Add ``share`` to rows (parent path, level, capacity, weight, budget): the budget filled in by weight.

    Children fill up in the order of capacity per weight; those that the rising level covers are full,
    the others divide the rest by weight. Where only weights of 0 are left, they fill up in name order.
    """
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = siblings.orderBy(F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).asc_nulls_last(), level)
    filled = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = children.withColumn("filled", F.sum("capacity").over(filled)).withColumn("later", F.sum("weight").over(siblings) - F.sum("weight").over(filled))
    full = (F.col("filled") <= F.col("budget")) & ((F.col("weight") == 0) | (_whole("capacity") * _whole("later") <= _whole("weight") * _whole(F.col("budget") - F.col("filled"))))
    rows = rows.withColumn("full", full)
    rows = rows.withColumn("rest", F.col("budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(siblings))
    rows = rows.withColumn("open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(siblings))
    part = F.expr("cast(cast(weight as decimal(19,0)) * cast(rest as decimal(19,0)) div greatest(open, 1) as bigint)")
    left = F.greatest(F.lit(0), F.least(F.col("capacity"), F.col("budget") - (F.col("filled") - F.col("capacity"))))
    share = F.when(F.col("full"), F.col("capacity")).when(F.col("open") > 0, F.least("capacity", part)).otherwise(left)
    return rows.withColumn("share", share.cast("bigint")).drop("filled", "later", "full", "rest", "open")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget: int, max_epochs: int) -> DataFrame:
    """(levels, total, share): the tokens that every leaf (levels, total) has and may take.

    One row per leaf: the table is as long as the list of sources, not as the corpus.
    """
    tree = leaves.withColumn("leaf_capacity", F.col("total") * max_epochs)
    shares = None
    for depth, level in enumerate(levels):
        parent = list(levels[:depth])
        here = tree.groupBy(*parent, level).agg(F.sum("leaf_capacity").alias("capacity"))
        joined = here.withColumn("budget", F.lit(budget).cast("bigint")) if shares is None else here.join(shares.withColumnRenamed("share", "budget"), parent)
        joined = joined.withColumn("weight", _weight(level, weights.get(level, {})))
        shares = settle(share_among_children(joined, parent, level).select(*parent, level, "share"), f"shares-{level}")
    return shares.join(leaves, list(levels)).select(*levels, "total", "share")


def mix(df: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], budget: Callable[[int], int], tokens: Column, max_epochs: int = 2, seed: int = 17, id_column: str = "doc_id") -> DataFrame:
    """(id, levels, n_tokens, md5 keys, copies): every row with at least one copy in the mix.

    ``levels`` names the tree from the root down; ``budget`` makes the token budget of the tokens that
    the corpus has. Rows keep their multiplicity.
    """
    names = list(levels)
    rows = df.select(F.col(id_column).alias("id"), *[F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for n, c in levels.items()], tokens.alias("n_tokens"))
    rows = settle(rows.where("n_tokens > 0"), "mix-rows")
    leaves = settle(rows.groupBy(*names).agg(F.sum("n_tokens").alias("total")), "mix-leaves")
    total = leaves.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]  # one number
    budgets = leaf_budgets(leaves, names, weights, budget(int(total)), max_epochs)
    plan = settle(budgets.select(*names, F.expr("cast(share div total as int)").alias("whole"), F.expr("share % total").alias("rest")), "mix-plan")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("whole") + 1).cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(NONE))).cast("binary"))
    keyed = settle(rows.join(plan, names).withColumn("draw", key), "mix-keyed")
    taken, open_rows = None, keyed
    for step in range(STEPS):
        digit = F.substring("draw", step * DIGITS + 1, DIGITS)
        buckets = open_rows.groupBy(*names, "rest", digit.alias("bucket")).agg(F.sum("n_tokens").alias("tokens"))
        upto = F.sum("tokens").over(Window.partitionBy(*names).orderBy("bucket"))
        cut = buckets.withColumn("upto", upto).where("upto > rest").groupBy(*names).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("before"))).alias("cut"))
        cut = settle(cut.select(*names, F.col("cut.bucket").alias("cut_bucket"), F.col("cut.before").alias("before")), "mix-cut")
        marked = open_rows.join(cut, names, "left")
        inside = F.coalesce(digit < F.col("cut_bucket"), F.lit(True))
        done = marked.where(inside | (digit > F.col("cut_bucket"))).withColumn("extra", inside.cast("int")).drop("cut_bucket", "before")
        taken = done if taken is None else taken.unionByName(done)
        open_rows = settle(marked.where(digit == F.col("cut_bucket")).withColumn("rest", F.col("rest") - F.col("before")).drop("cut_bucket", "before"), "mix-open")
    upto = F.sum("n_tokens").over(Window.partitionBy(*names).orderBy("draw").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    last = open_rows.withColumn("extra", (upto <= F.col("rest")).cast("int"))
    copies = (F.col("whole") + F.col("extra")).alias("copies")
    return taken.unionByName(last).select(F.col("id").alias(id_column), *names, "n_tokens", copies).where("copies > 0")


def repeat_rows(df: DataFrame, mixed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it; rows of one id are taken alike."""
    copies, key = fresh(df, "copies"), fresh(df, "mixed_id")
    counts = mixed.groupBy(F.col(id_column).alias(key)).agg(F.max("copies").alias(copies))
    kept = df.join(counts, df[id_column].eqNullSafe(counts[key]))
    return kept.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*df.columns)
