"""Toxicity from confirmed examples and unlabelled text: non-negative positive-unlabelled learning.

Only confirmed toxic documents and texts of unknown kind are compared. The risk of the toxic class is
estimated on the confirmed examples, that of the other class on the unlabelled text less the share
that the class prior says is toxic; where that difference turns negative, which a flexible model would
exploit, the step goes the other way. The model is linear over words and the beginnings of words that
separate the two samples significantly.

Fitting uses at most ``POSITIVES`` confirmed and ``UNLABELLED`` other texts, those of smallest id hash;
features are counted in Spark, the numpy fit sees 0/1 rows over at most ``FEATURES`` features. Scoring
covers every text whole.

Defined cases: null and empty texts score as texts without features; documents labelled twice count as
toxic if one label says so; without confirmed examples every score is the class prior's, 0 if unknown.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.llm.common import map_arrow, remainder, settle
from auditframe.session import ship_with_tasks

ship_with_tasks(__name__)

POSITIVES = 4000
UNLABELLED = 8000
FEATURES = 1024
#: A feature must separate the samples by this many standard errors, in this many confirmed texts.
LEAST_Z, LEAST_TEXTS = 4.0, 3
PREFIXES = (4, 5, 6)
STEPS, RATE, DECAY = 400, 0.05, 1e-4
#: Words whose features a task remembers; a full store is emptied, which changes no score.
KEPT_WORDS = 200_000
WORD = r"[^\W\d_]+"


def word_features(word: str) -> list[str]:
    """A word, and its beginnings as ``abcd*``: inflected forms of one stem share them."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def text_features(text: str | None) -> set[str]:
    return {f for word in set(re.findall(WORD, (text or "").lower())) for f in word_features(word)}


def fold(id_column: str = "doc_id") -> Column:
    """The remainder that parts learning (1 to 4) from testing (0); null for a null id."""
    return remainder(id_column, 5)


def _sample(df: DataFrame, size: int, id_column: str) -> DataFrame:
    """The ids of ``size`` rows of smallest id hash."""
    return df.select(id_column).distinct().orderBy(F.xxhash64(id_column), id_column).limit(size)


def fit(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", toxic: str = "toxic") -> tuple[list[str], np.ndarray, float]:
    """(features, weights, bias) learned from documents and labels of the learning folds."""
    documents = documents.where(fold(id_column) != 0).select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    marks = labels.where((fold(id_column) != 0) & F.col(toxic).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.max(F.col(toxic).cast("int")).alias("toxic"))
    marks = settle(marks, "toxicity-marks")
    prior = marks.agg(F.avg("toxic")).first()[0]
    positive = _sample(marks.where("toxic = 1"), POSITIVES, "id").withColumn("kind", F.lit(1))
    unlabelled = _sample(documents, UNLABELLED, "id").withColumn("kind", F.lit(0))
    picked = settle(positive.unionByName(unlabelled), "toxicity-sample")

    def features(batch):
        return {"kind": batch.column(0), "row": batch.column(1), "features": pa.array([sorted(text_features(x)) for x in batch.column(2).to_pylist()], pa.list_(pa.string()))}

    rows = documents.join(picked, "id").select("kind", F.monotonically_increasing_id().alias("row"), "text")
    rows = settle(map_arrow(rows, features, "kind int, row bigint, features array<string>"), "toxicity-features")
    sizes = rows.agg(F.count(F.when(F.col("kind") == 1, 1)).alias("p"), F.count(F.when(F.col("kind") == 0, 1)).alias("u")).first()
    if not sizes.p or not sizes.u or not prior:
        odds = np.clip(prior or 0.0, 1e-6, 0.5 - 1e-6)
        return [], np.zeros(0), float(np.log(odds / (1 - odds)))
    counts = rows.select("kind", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("kind").alias("in_p"), F.sum(1 - F.col("kind")).alias("in_u"))
    rate_p, rate_u = F.col("in_p") / sizes.p, F.col("in_u") / sizes.u
    pooled = (F.col("in_p") + F.col("in_u")) / (sizes.p + sizes.u)
    error = F.sqrt(pooled * (1 - pooled) * (1 / sizes.p + 1 / sizes.u) + 1e-12)
    best = counts.withColumn("z", (rate_p - rate_u) / error).where((F.col("z") >= LEAST_Z) & (F.col("in_p") >= LEAST_TEXTS))
    names = [r.feature for r in best.orderBy(F.desc("z"), "feature").limit(FEATURES).collect()]
    place = {name: i for i, name in enumerate(names)}

    def indices(batch):
        found = [sorted(place[f] for f in row if f in place) for row in batch.column(1).to_pylist()]
        return {"kind": batch.column(0), "at": pa.array(found, pa.list_(pa.int32()))}

    sample = map_arrow(rows.select("kind", "features"), indices, "kind int, at array<int>").collect()
    dense = np.zeros((len(sample), len(names)), dtype=np.float32)
    for i, row in enumerate(sample):
        dense[i, row["at"]] = 1
    kind = np.array([row["kind"] for row in sample])
    weights, bias = learn_nonnegative(dense[kind == 1], dense[kind == 0], float(prior))
    return names, weights, bias


def learn_nonnegative(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative positive-unlabelled logistic risk."""
    prior = min(max(prior, 1e-4), 0.9)
    weights = np.zeros(positive.shape[1] + 1)
    weights[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(weights), np.zeros_like(weights)

    def add_bias(x):
        return np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)

    positive, unlabelled = add_bias(positive), add_bias(unlabelled)
    for step in range(1, STEPS + 1):
        f_p, f_u = positive @ weights, unlabelled @ weights
        as_toxic = 1 / (1 + np.exp(np.clip(f_p, -30, 30)))  # minus the slope of the loss of a toxic label
        as_clean_p = 1 / (1 + np.exp(np.clip(-f_p, -30, 30)))  # the slope of the loss of a clean label
        as_clean_u = 1 / (1 + np.exp(np.clip(-f_u, -30, 30)))
        clean_risk = np.logaddexp(0, f_u).mean() - prior * np.logaddexp(0, f_p).mean()
        clean_slope = unlabelled.T @ as_clean_u / len(unlabelled) - prior * (positive.T @ as_clean_p) / len(positive)
        if clean_risk >= 0:
            slope = clean_slope - prior * (positive.T @ as_toxic) / len(positive)
        else:
            slope = -clean_slope
        slope[:-1] += DECAY * weights[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        weights = weights - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights[:-1], float(weights[-1])


def score(df: DataFrame, model: tuple[list[str], np.ndarray, float], id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score, predicted): the probability that a text is toxic, for every whole text."""
    names, weights, bias = model
    place, weight = {name: i for i, name in enumerate(names)}, weights.tolist()  # at most FEATURES entries

    def step(batch):
        kept: dict[str, tuple[int, ...]] = {}
        scores = []
        for text in batch.column(1).to_pylist():
            found: set[int] = set()
            for word in set(re.findall(WORD, (text or "").lower())):
                at = kept.get(word)
                if at is None:
                    if len(kept) >= KEPT_WORDS:
                        kept.clear()
                    at = kept[word] = tuple(place[f] for f in word_features(word) if f in place)
                if at:
                    found.update(at)
            scores.append(bias + sum(weight[i] for i in sorted(found)))
        chance = 1 / (1 + np.exp(-np.clip(np.array(scores), -30, 30)))
        return {id_column: batch.column(0), "score": pa.array(chance), "predicted": pa.array((chance >= 0.5).astype(np.int32))}

    return map_arrow(df.select(id_column, text), step, f"`{id_column}` {dict(df.dtypes)[id_column]}, score double, predicted int")
