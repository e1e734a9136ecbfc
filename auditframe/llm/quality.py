"""Quality rules per document and a verdict per host, in DataFrame functions only.

Every document is measured inside its own row. A host's failures of the base rules are counted and its
rate is shrunk towards the corpus by a beta prior, whose two parameters come from the hosts themselves
by moments: the more alike the hosts, the stronger the prior. A host whose shrunk rate is above
``MOST_FAILED`` takes all its documents with it.

Defined cases: null texts have no words and fail; documents without a host are judged by the base
rules alone; without hosts, or with hosts no more different than chance, the prior is as strong as
``STRONGEST`` documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.llm.common import BLANKS, settle

SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS, MOST_REPEATED_PERCENT = 10, 20
#: A host fails above this shrunk share of failed documents.
MOST_FAILED = 0.5
#: Weight of the prior in documents where hosts do not differ beyond chance, and its least weight.
STRONGEST, WEAKEST = 1_000_000.0, 1e-3


def _bind(value: Column, body) -> Column:
    """``body`` over a value that is computed once: inside a lambda a bare expression would run per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more in ``windows``, an array by position."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(p):
        def place(x, k):
            same = x["h"].eqNullSafe(F.get(p, k - 1)["h"]) | x["h"].eqNullSafe(F.get(p, k + 1)["h"])
            return F.when(same, x["i"])

        return F.sort_array(F.filter(F.transform(p, place), lambda x: x.isNotNull()))

    start = F.struct(F.lit(0).alias("words"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(_bind(pairs, positions), start, lambda a, i: F.struct((a["words"] + F.least(F.lit(WINDOW), i - a["last"])).alias("words"), i.alias("last")), lambda a: a["words"])
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered).otherwise(0)


def measures(df: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of every row."""
    value = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(id_column).alias("id"), F.col(host).cast("string").alias("host"), value.alias("text"))
    hashes = F.transform(F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    no_words = F.translate(F.col("text"), BLANKS, "")
    rows = rows.select(
        "id", "host", hashes.alias("words"), lines.alias("lines"), F.length(no_words).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate(F.col("text"), SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
    )
    at = F.sequence(F.lit(0), F.size("words") - WINDOW)
    windows = F.when(F.size("words") >= WINDOW, F.transform(at, lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        "id", "host", F.size("words").cast("bigint").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), windows.alias("windows"),
    )
    rows = rows.select("id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated_words(F.col("windows")).cast("bigint").alias("n_repeat_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def host_verdicts(rows: DataFrame) -> DataFrame:
    """(host, n_docs, n_failed, shrunk_rate, host_kept) of every host in rows (host, base_failed)."""
    hosts = rows.where("host is not null").groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("bigint")).alias("n_failed"))
    hosts = settle(hosts, "hosts")
    # Moments: spread of the host rates about the corpus rate, less what chance alone gives. Two rows reach the driver.
    corpus = hosts.agg((F.sum("n_failed") / F.sum("n_docs")).alias("mean")).first()
    mean = F.lit(corpus.mean or 0.0)
    rate = F.col("n_failed") / F.col("n_docs")
    seen = F.sum(F.col("n_docs") * (rate - mean) * (rate - mean)) / F.sum("n_docs")
    between = seen - F.count("*") * mean * (1 - mean) / F.sum("n_docs")
    weight = F.when(between > 0, F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), mean * (1 - mean) / between - 1))).otherwise(STRONGEST)
    prior = F.lit(hosts.agg(weight.alias("weight")).first().weight)
    shrunk = (F.col("n_failed") + prior * mean) / (F.col("n_docs") + prior)
    return hosts.select("host", "n_docs", "n_failed", shrunk.alias("shrunk_rate"), (shrunk <= MOST_FAILED).alias("host_kept"))


def judged(df: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(id, the five measures, base_failed, kept), one row per row of ``df``."""
    rows = settle(measures(df, id_column, text, host), "quality-measures")
    verdicts = host_verdicts(rows).select("host", "host_kept")
    kept = ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))
    return rows.join(verdicts, "host", "left").select(F.col("id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
