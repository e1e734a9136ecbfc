"""Spelling variants: words within one edit of each other, by a variable-length gram index.

Grams. A gram starts at every place of a word (which gets an end mark) and is ``SHORTEST`` code points long; while it
is frequent it takes one more, up to ``LONGEST``. The dictionary of frequent grams is counted over all words and pruned
by share, so it holds at most ``1 / SHARE`` grams of a length. A gram depends on its own code points only: an edit
affects the grams that lie over it and no others.

Lists. A gram left of the edit keeps its distance from the word's start and everything before it; a gram right of it
keeps its distance from the end and everything behind it. So an inverted list is kept per gram and text before it, and
per gram and text behind it. Of the grams of a word two are probed: one in its middle, and the one that starts where
that has ended. No edit affects both (their affected-gram bound is 1), so one of the two lists holds every near word.
A word is listed only where a near word can ask.

Merging. A list of more than ``LONG_LIST`` words is not scanned. Its words are looked up by both sides at once: for
every place of the edit the text left of it and the text right of it. That is the intersection of the last unaffected
list on the left with the first on the right, and holds near words only. Candidates are verified by edit distance.

Null texts have no words. A null id is written as empty. Repeated rows count again. An empty table gives no row. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.llm.common import map_arrow, settle
from auditframe.session import ship_with_tasks

ship_with_tasks(__name__)

RUN = "[A-Za-z\\u00C0-\\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points of a gram.
SHORTEST, LONGEST = 3, 5
#: A gram is frequent if it makes up this share of all grams of its length.
SHARE = 1 / 4096
#: Lists of more words than this are merged instead of scanned.
LONG_LIST = 32
END = "$"
#: Words of this many code points or more always have a gram in the middle with a gram behind it.
WHOLE = 2 * LONGEST - SHORTEST
START_SIDE, END_SIDE = 0, 1


def damaged_words(docs: DataFrame, least_length: int, every: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(word) per run of letters: A-Z lower-cased, and every ``every``-th run by checksum without one code point."""
    runs = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"({RUN}{{{least_length},}})"), 1)).alias("run"))
    word = F.translate("run", UPPER, LOWER)
    runs = runs.select("id", word.alias("word")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")))
    at = (F.col("h") % F.length("word")).cast("int")
    cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return runs.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least_length)


def frequent_grams(words: DataFrame, share: float = SHARE) -> frozenset[str]:
    """Grams of ``SHORTEST`` to ``LONGEST`` - 1 code points with at least ``share`` of the grams of their length: at most 1 / share a length."""
    found: set[str] = set()
    for length in range(SHORTEST, LONGEST):
        long_enough = words.where(F.length("word") >= length)
        grams = long_enough.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - length + 1), lambda i: F.substring("word", i, F.lit(length)))).alias("gram"))
        counts = grams.groupBy("gram").count()
        total = long_enough.agg(F.sum(F.length("word") - length + 1)).first()[0] or 0
        found.update(row["gram"] for row in counts.where(F.col("count") >= max(1, total * share)).select("gram").toLocalIterator())
    return frozenset(found)


def grams(word: str, frequent: frozenset[str]) -> list[tuple[int, int]]:
    """Start and end of the gram at every place of ``word`` plus its end mark."""
    text, found = word + END, []
    for start in range(len(text) - SHORTEST + 1):
        end = start + SHORTEST
        while end < len(text) and end - start < LONGEST and text[start:end] in frequent:
            end += 1
        found.append((start, end))
    return found


def affected_bound(spans: list[tuple[int, int]]) -> int:
    """The most grams that one edit can affect: the most that lie over one code point."""
    return max((sum(a <= at < b for a, b in spans) for at in range(max((b for _, b in spans), default=0))), default=0)


def probes(word: str, frequent: frozenset[str]) -> tuple[str, str]:
    """What stands before the end of one gram in the middle, and behind it; no edit affects both lists' grams.

    Words of less than ``WHOLE`` code points may have no two such grams; nothing is asked of them on the left.
    """
    text, spans = word + END, grams(word, frequent)
    cut = spans[_middle_start(len(word))][1] if spans else len(text)
    return (text[:cut], text[cut:]) if cut + SHORTEST <= len(text) else ("", text)


def _middle_start(length: int) -> int:
    """Where the gram starts behind whose end a word is cut; the end is at most one place from the middle."""
    return max(0, (length + 1) // 2 - LONGEST + 1)


def indexed(word: str, frequent: frozenset[str], short_words: bool = False) -> tuple[set[str], set[str]]:
    """The texts before ends and behind starts of the word's grams, as far as a near word can ask for them.

    A near word is at most one longer or shorter, and is cut at most one place from its middle.
    """
    text, length = word + END, len(word)
    middles = [((length + more + 1) // 2, more) for more in (-1, 0, 1)]
    ends = {m + d for m, _ in middles for d in (-1, 0, 1)}
    starts = {m + d - more for m, more in middles for d in (-1, 0, 1)}
    before = {text[:b] for _, b in grams(word, frequent) if b in ends}
    if short_words:
        before.add("")
    return before, {text[a:] for a in starts if 0 <= a <= len(text) - SHORTEST}


def _hash(texts: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(x) for x in texts], dtype=np.uint64).view(np.int64)


def _postings(frequent: frozenset[str], asked: bool, short_words: bool):
    def over(batch: pa.RecordBatch) -> dict:
        keys, words = [], []
        for word in batch.column(0).to_pylist():
            if asked:
                before, behind = ([x] for x in probes(word, frequent))
            else:
                before, behind = indexed(word, frequent, short_words)
            own = [f"{START_SIDE}{x}" for x in before] + [f"{END_SIDE}{x}" for x in behind]
            keys += own
            words += [word] * len(own)
        return {"key": pa.array(_hash(keys)), "word": pa.array(words, pa.string())}

    return over


def _around_edits(words: DataFrame, name: str) -> DataFrame:
    """For every place of an edit the text left of it and right of it; the word itself, for words one longer."""
    places = F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda i: F.concat(F.substring("word", F.lit(1), i), F.substring("word", i + 2, F.length("word"))))
    return words.select(F.explode(F.array_distinct(F.concat(F.array("word"), places))).alias("around"), F.col("word").alias(name)).withColumn("around", F.xxhash64("around"))


def near_words(words: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """(word, near) for all ordered pairs of distinct words of ``words`` that differ by one edit."""
    words = words.select("word")
    frequent = frequent_grams(words)
    short_words = (words.agg(F.min(F.length("word"))).first()[0] or WHOLE) < WHOLE
    lists = settle(map_arrow(words, _postings(frequent, False, short_words), "key long, word string"), "gram-lists")
    asked = settle(map_arrow(words, _postings(frequent, True, short_words), "key long, word string"), "gram-probes")
    long = settle(lists.groupBy("key").count().where(F.col("count") > long_list).select("key"), "long-lists")
    scanned = asked.join(long, "key", "left_anti").join(lists.select("key", F.col("word").alias("near")), "key").select("word", "near")
    askers = asked.join(long, "key", "left_semi").select("word").distinct()
    listed = lists.join(long, "key", "left_semi").select("word").distinct()
    merged = _around_edits(askers, "word").join(_around_edits(listed, "near"), "around").select("word", "near")
    one_edit = (F.col("word") != F.col("near")) & (F.abs(F.length("word") - F.length("near")) <= 1) & (F.levenshtein("word", "near") == 1)
    return scanned.where(one_edit).unionByName(merged.where(one_edit)).distinct()


def variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, every: int = 31, factor: int = 10, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per word its count, near words, the form it is probably a variant of and the root of its forms.

    ``factor`` must be above 1, so that forms lead to ever more frequent words and end.
    """
    if factor <= 1:
        raise ValueError("A form must be more frequent than its variant.")
    counted = damaged_words(docs, least_length, every, id_column, text).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
    counted = settle(counted, "words")
    pairs = near_words(counted).join(counted.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = counted.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    stands = F.col("form_n") >= factor * F.col("n")
    formed = settle(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(stands, F.col("best.near")).alias("form"), F.when(stands, F.col("form_n")).alias("form_n")), "forms"
    )
    return formed.join(_roots(formed.where("form is not null").select("word", "form")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(steps: DataFrame) -> DataFrame:
    """(word, root): every step doubles its reach until none moves; a form is ``factor`` times as frequent, so few rounds do."""
    found = settle(steps.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = settle(found.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        found = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return found
