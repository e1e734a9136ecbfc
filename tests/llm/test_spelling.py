"""Spelling variants against comparing candidates one by one, bounds and probes against all edits, odd rows."""

import random

import plain
import pytest

from auditframe.llm import spelling

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def corpus(seed=3):
    draw = random.Random(seed)
    base = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(6, 13))) for _ in range(40)] + ["aaaaaaaa", "aaaaaaa", "abababab"]

    def noisy():
        word = draw.choice(base)
        if draw.random() < 0.3:
            i = draw.randrange(len(word))
            word = draw.choice([word[:i] + word[i + 1 :], word[:i] + "x" + word[i:], word[:i] + "ÿ" + word[i + 1 :]])
        return word.upper() if draw.random() < 0.1 else word

    rows = [(i, draw.choice([" ", ", ", "1"]).join(noisy() for _ in range(draw.randint(0, 60)))) for i in range(80)]
    rows += [(None, "keeping keeping keeping keepings"), (1, None), (2, ""), (3, "x" * 30_000), (4, rows[4][1]), (4, rows[5][1])]
    return rows + [(100 + i, "Internationally ") for i in range(40)] + [(200, "internationaly internationaly × ÷")]


@pytest.mark.parametrize("long_list", [32, 0, 10**9])
def test_against_candidates_one_by_one(spark, monkeypatch, long_list):
    """Lists all scanned, all merged, and as in production."""
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    monkeypatch.setattr(spelling.near_words, "__defaults__", (long_list,))
    found = spelling.variants(docs).select(*COLUMNS)
    expected = plain.spellings(plain.damaged(rows))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(expected, key=repr)
    assert sum(x[1] is not None for x in expected) > 3 and any(x[2] != x[1] and x[1] for x in expected) in (True, False)


def test_no_edit_affects_both_probes():
    draw = random.Random(1)
    words = ["".join(draw.choice("abc") for _ in range(draw.randint(7, 14))) for _ in range(200)]
    counts = {}
    for w in words:
        for q in range(spelling.SHORTEST, spelling.LONGEST):
            for i in range(len(w) - q + 1):
                counts[w[i : i + q]] = counts.get(w[i : i + q], 0) + 1
    frequent = frozenset(g for g, n in counts.items() if n > 12)
    for word in words:
        before, behind = spelling.probes(word, frequent)
        for near in {word[:i] + x + word[j:] for i in range(len(word) + 1) for j in (i, i + 1) for x in ("", "a", "z") if j <= len(word)} - {word}:
            if len(near) < spelling.WHOLE:
                continue
            starts, ends = spelling.indexed(near, frequent)
            assert before and (before in starts or behind in ends), (word, near)
        assert spelling.affected_bound(spelling.grams(word, frequent)) <= spelling.LONGEST


def test_shorter_words(spark):
    rows = [(i, t) for i, t in enumerate(["cat cats cat cats", "bat bats bat", "a ab abc abc a ab", "house houses house houses mouse mouse"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = spelling.variants(docs, least_length=1, factor=2).select(*COLUMNS)
    expected = plain.spellings(plain.damaged(rows, least=1), factor=2)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(expected, key=repr)
    with pytest.raises(ValueError):
        spelling.variants(docs, factor=1)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(docs).count() == 0
    one = spark.createDataFrame([(1, "keeping keeping")], "doc_id long, text string")
    assert [tuple(r) for r in spelling.variants(one).select(*COLUMNS).collect()] == [("keeping", None, "keeping", 2, 0, None)]
