"""Languages of a document as a mixture, estimated by expectation-maximisation.

Learned are the frequencies of hashed letter trigrams in each language, counted over all labelled
texts. A document is taken as a mixture: its trigrams come from unknown proportions of the languages,
and EM finds the proportions of highest likelihood. Languages enter by falling proportion while the
likelihood they add exceeds a penalty that grows with the logarithm of the trigrams; the proportions
left at the end decide.

Defined cases: a null text or one without letters is ``und`` with score 0, as is every text when
nothing was labelled; a single learned language is given to any text with letters; equal proportions
go to the language first in name order. Labelled rows with null id, text or language teach nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.llm.codepoints import LETTER, code_points, general_classes
from auditframe.llm.common import map_arrow, remainder, rows_in_passes
from auditframe.session import ship_with_tasks

ship_with_tasks(__name__)

UNDETERMINED = "und"
#: Trigrams are hashed to this many cells; a model has as many numbers per language.
CELLS = 1 << 14
#: Added to every count of a cell.
SMOOTHING = 0.5
ROUNDS = 10
#: Cost of one more language, in halves of the logarithm of the number of trigrams.
PENALTY = 4.0
#: Languages of a smaller proportion do not enter.
LEAST_SHARE = 0.02


def trigrams(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the trigrams around every letter of the texts, and where each text's cells end.

    Letter case is ignored and everything that is no letter is one same blank, also beyond the ends.
    """
    parts = [code_points(x.lower() + " ") for x in texts]
    points = np.concatenate([*parts, np.zeros(1, np.uint32)])
    is_letter = letters[points]
    points = np.where(is_letter, points, 0).astype(np.uint32)
    middle = np.flatnonzero(is_letter)
    with np.errstate(over="ignore"):
        before = np.where(middle > 0, points[middle - 1], 0).astype(np.uint32)
        mixed = before * np.uint32(0x9E3779B1) ^ points[middle] * np.uint32(0x85EBCA77) ^ points[middle + 1] * np.uint32(0xC2B2AE3D)
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    cells = ((mixed ^ (mixed >> np.uint32(13))) & np.uint32(CELLS - 1)).astype(np.int32)
    ends = np.searchsorted(middle, np.cumsum([len(x) for x in parts]))
    return cells, ends


def text_cells(values: list[str | None], letters: np.ndarray):
    """The trigram cells of every text, in passes of bounded size."""
    texts = [x or "" for x in values]
    for start, stop in rows_in_passes(np.array([len(x) for x in texts], dtype=np.int64)):
        cells, ends = trigrams(texts[start:stop], letters)
        begin = 0
        for row, end in zip(range(start, stop), ends.tolist()):
            yield row, cells[begin:end]
            begin = end


def learn(df: DataFrame, text: str = "text", language: str = "lang") -> tuple[list[str], np.ndarray]:
    """Language names and their trigram probabilities, from every row with a language.

    Each task sums its texts first; what reaches the driver is one number per language and cell.
    """
    letters = df.sparkSession.sparkContext.broadcast(general_classes() == LETTER)

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            for row, cells in text_cells(batch.column(1).to_pylist(), letters.value):
                if names[row] not in totals:
                    totals[names[row]] = np.zeros(CELLS, dtype=np.int64)
                totals[names[row]] += np.bincount(cells, minlength=CELLS)
        for name, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(total[used])], ["language", "cell", "n"])

    rows = df.where(F.col(text).isNotNull() & F.col(language).isNotNull()).select(F.col(language).cast("string").alias("language"), F.col(text).alias("text"))
    sums = rows.mapInArrow(count, "language string, cell int, n bigint").groupBy("language", "cell").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(sums["language"].unique())
    counts = np.full((len(names), CELLS), SMOOTHING)
    place = {name: i for i, name in enumerate(names)}
    counts[sums["language"].map(place).to_numpy(dtype=np.int64), sums["cell"].to_numpy()] += sums["n"].to_numpy()
    return names, counts / counts.sum(axis=1, keepdims=True)


def _maximise(share: np.ndarray, likely: np.ndarray, counts: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    total = counts.sum()
    for _ in range(rounds):
        mixture = share @ likely
        share = share * (likely @ (counts / mixture)) / total
    return share, float(counts @ np.log(share @ likely))


def proportions(cells: np.ndarray, model: np.ndarray) -> np.ndarray:
    """The proportion of every language in one text of at least one letter, zero for those not selected."""
    counts = np.bincount(cells, minlength=CELLS)
    used = np.flatnonzero(counts)
    counts, likely = counts[used].astype(np.float64), model[:, used]
    names = len(model)
    share, _ = _maximise(np.full(names, 1 / names), likely, counts, ROUNDS)
    order = np.argsort(-share, kind="stable")
    alone = np.log(likely) @ counts
    best = int(order[0])
    if alone.max() > alone[best]:
        best = int(alone.argmax())  # the likeliest single language leads
        order = np.concatenate([[best], order[order != best]])
    chosen, weight, reached = order[:1], np.ones(1), float(alone[best])
    cost = 0.5 * PENALTY * math.log(counts.sum() + 1)
    for size in range(2, names + 1):
        if share[order[size - 1]] < LEAST_SHARE:
            break
        here = order[:size]
        start = np.maximum(share[here], 1e-3)
        found, likelihood = _maximise(start / start.sum(), likely[here], counts, ROUNDS)
        if likelihood - reached <= cost:
            break
        chosen, weight, reached = here, found, likelihood
    out = np.zeros(names)
    out[chosen] = weight
    return out


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score, languages): the leading language, its proportion, and all selected with theirs."""
    names, likely = model
    # One row of 16,384 numbers per learned language: bounded by the languages, not by the corpus.
    shared = df.sparkSession.sparkContext.broadcast((general_classes() == LETTER, names, likely))

    def step(batch):
        letters, names, likely = shared.value
        size = batch.num_rows
        lead, score, every = [UNDETERMINED] * size, [0.0] * size, [[] for _ in range(size)]
        for row, cells in text_cells(batch.column(1).to_pylist(), letters):
            if len(cells) and names:
                share = proportions(cells, likely)
                lead[row], score[row] = names[int(share.argmax())], min(1.0, float(share.max()))
                every[row] = [(names[i], float(share[i])) for i in np.flatnonzero(share).tolist()]
        pairs = pa.array(every, pa.list_(pa.struct([("language", pa.string()), ("share", pa.float64())])))
        return {id_column: batch.column(0), "lang_pred": pa.array(lead, pa.string()), "score": pa.array(score, pa.float64()), "languages": pairs}

    kind = dict(df.dtypes)[id_column]
    return map_arrow(df.select(id_column, text), step, f"`{id_column}` {kind}, lang_pred string, score double, languages array<struct<language: string, share: double>>")


def held_out(id_column: str = "doc_id") -> Column:
    """Whether a document is kept from learning; a null id is not held out, and not learned from either."""
    return F.coalesce(remainder(id_column, 4) == 2, F.lit(False))


def learn_from(df: DataFrame, id_column: str = "doc_id", text: str = "text", language: str = "lang") -> tuple[list[str], np.ndarray]:
    return learn(df.where(remainder(id_column, 4) != 2), text, language)


def keep_determined(df: DataFrame, model: tuple[list[str], np.ndarray], least_share: float, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose leading language has a proportion of at least ``least_share``; all columns are kept.

    When nothing was labelled no language is known, and rows with letters stay.
    """
    names, likely = model
    shared = df.sparkSession.sparkContext.broadcast((general_classes() == LETTER, likely))
    at = df.columns.index(text)

    def keep(batches):
        letters, likely = shared.value
        for batch in batches:
            kept = np.zeros(batch.num_rows, dtype=bool)
            for row, cells in text_cells(batch.column(at).to_pylist(), letters):
                kept[row] = len(cells) > 0 and (not len(likely) or proportions(cells, likely).max() >= least_share)
            yield batch.filter(pa.array(kept))

    return df.mapInArrow(keep, df.schema)
