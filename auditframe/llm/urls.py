"""URL filters: fixed host and path rules, and association rules mined from labelled URLs.

Fixed rules decide first; the longest that fits wins. For the rest FP-growth finds combinations of URL
tokens (host, its last two or three labels, each label, path segments, query keys ...) that are frequent among labelled
URLs. A combination becomes a blocking rule if enough of the labelled URLs that have it are surely blocked;
it is pruned if a part of it blocks as surely. Rules are matched through an inverted index: each rule
is posted under its rarest token, a URL looks up its own tokens and keeps the rules it has whole. URLs
with the same tokens are looked up once.

Defined cases: a null URL, or one without ``://``, has empty host and path and no tokens but its lack of
a host, fits no fixed rule, and is allowed unless mined otherwise; with nothing labelled, or nothing
that blocks, no rule is mined and all else is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.llm.common import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCKED = "=blocked"
#: A rule needs this share of all labelled URLs, and among those it fits this share of blocked at least,
#: by the lower end of the 95 % Wilson interval: a few URLs prove nothing.
LEAST_SUPPORT, LEAST_CONFIDENCE = 0.002, 0.5
WILSON_Z = 1.96


def host_of(url: str) -> Column:
    return F.translate(_part(url, 1), UPPER, LOWER)


def path_of(url: str) -> Column:
    return _part(url, 2)


def _part(url: str, group: int) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", group)


def fixed_rule(host: str, path: str, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null without one; rules are (host and path, verdict)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: len(r[0])):  # the last, longest, wraps the others
        rule_host, slash, rest = text.partition("/")
        fits = ((F.col(host) == rule_host) | F.col(host).endswith("." + rule_host)) & F.col(path).startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: str, host: str, path: str) -> Column:
    """The distinct tokens of a URL in order; numbers in paths are one same token."""
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    shaped = F.transform(segments, lambda s: F.concat(F.lit("path:"), F.regexp_replace(F.lower(s), "[0-9]+", "#")))
    query = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("query:"), F.lower(F.substring_index(s, "=", 1))))
    parts = [
        F.array(F.concat(F.lit("host:"), F.col(host))),
        F.when(F.size(labels) > 1, F.array(F.concat(F.lit("domain:"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")))).otherwise(F.array().cast("array<string>")),
        # The last three labels together where there are more, and every label.
        F.when(F.size(labels) > 3, F.array(F.concat(F.lit("domain:"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")))).otherwise(F.array().cast("array<string>")),
        F.transform(F.filter(labels, lambda s: s != ""), lambda s: F.concat(F.lit("label:"), s)),
        shaped, keys,
    ]
    return F.sort_array(F.array_distinct(F.concat(*parts)))


def with_tokens(df: DataFrame, url: str) -> DataFrame:
    rows = df.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    return rows.withColumn("tokens", url_tokens(url, "host", "path"))


def mine_rules(labelled: DataFrame, least_support: float = LEAST_SUPPORT, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """(rule_id, tokens, confidence, posting) of the pruned blocking rules of rows (tokens, blocked)."""
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "rule_id bigint, tokens array<string>, confidence double, posting string")
    marked = F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(BLOCKED)))).otherwise(F.col("tokens"))
    baskets = settle(labelled.select(marked.alias("items")), "url-baskets")
    if baskets.isEmpty():
        return empty
    sets = FPGrowth(itemsCol="items", minSupport=least_support).fit(baskets).freqItemsets
    sets = settle(sets.select(F.sort_array("items").alias("items"), "freq"), "url-itemsets")
    plain = sets.where(~F.array_contains("items", BLOCKED)).select(F.col("items").alias("tokens"), F.col("freq").alias("fits"))
    blocked = sets.where(F.array_contains("items", BLOCKED) & (F.size("items") > 1)).select(F.array_remove("items", BLOCKED).alias("tokens"), F.col("freq").alias("blocks"))
    share, z2 = F.col("blocks") / F.col("fits"), WILSON_Z**2 / F.col("fits")
    lower = (share + z2 / 2 - F.sqrt(z2 * (share * (1 - share) + z2 / 4))) / (1 + z2)
    sure = blocked.join(plain, "tokens").withColumn("confidence", lower).where(F.col("confidence") >= least_confidence)
    sure = settle(sure.select(F.xxhash64("tokens").alias("rule_id"), "tokens", "confidence"), "url-rules")
    # A rule goes if leaving out one of its tokens gives a rule that is as sure; larger cuts follow step by step.
    shorter = sure.select("rule_id", F.col("confidence").alias("own"), "tokens", F.explode("tokens").alias("token")).select("rule_id", "own", F.array_remove("tokens", F.col("token")).alias("tokens"))
    pruned = shorter.join(sure.select("tokens", "confidence"), "tokens").where("confidence >= own").select("rule_id").distinct()
    kept = sure.join(pruned, "rule_id", "left_anti")
    counts = sets.where(F.size("items") == 1).select(F.get("items", F.lit(0)).alias("posting"), F.col("freq").alias("token_freq"))
    posted = kept.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("posting")).join(counts, "posting")
    rarest = posted.groupBy("rule_id").agg(F.min(F.struct("token_freq", "posting")).alias("rarest"))
    return settle(kept.join(rarest, "rule_id").select("rule_id", "tokens", "confidence", F.col("rarest.posting").alias("posting")), "url-index")


def mined_verdicts(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, mined_rule, mined_confidence): the surest rule each distinct token set has whole, if any."""
    lists = tokens.select("tokens").distinct()
    index = rules.select(F.col("tokens").alias("needed"), "confidence", "posting")
    met = lists.select("tokens", F.explode("tokens").alias("posting")).join(index, "posting")
    met = met.where(F.size(F.array_except("needed", "tokens")) == 0)
    best = met.groupBy("tokens").agg(F.max(F.struct("confidence", F.array_join("needed", " ").alias("rule"))).alias("best"))
    return best.select("tokens", F.col("best.rule").alias("mined_rule"), F.col("best.confidence").alias("mined_confidence"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]], id_column: str = "page_id", url: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, mined_rule) of every page; labels are rows (url, blocked)."""
    learned = mine_rules(with_tokens(labels.select(F.col(url).alias("url"), "blocked"), "url").select("tokens", "blocked"))
    rows = settle(with_tokens(pages.select(F.col(id_column).alias("id"), F.col(url).alias("url")), "url"), "url-rows")
    rule, verdict = fixed_rule("host", "path", rules)
    found = settle(mined_verdicts(rows, learned), "url-verdicts")  # written: one plain side of the join below
    judged = rows.join(found, "tokens", "left").withColumn("rule", rule).withColumn("decided", verdict)
    mined = F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")
    return judged.select(
        F.col("id").alias(id_column), "host", "path", "rule", F.coalesce("decided", mined).alias("verdict"), F.when(F.col("rule").isNull(), F.col("mined_rule")).alias("mined_rule")
    )
