"""Ranked search against scoring every pair, bounds against scores, odd rows."""

import random
import tracemalloc

import numpy as np
import plain

from auditframe.llm import lexical


def corpus(seed=1, n=400):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Über", "ÜBER", "straße", "x1", "THE", "the"]
    weight = [1 / (i + 1) for i in range(len(words))]

    def text(size):
        return draw.choice([" ", ", ", "-"]).join(draw.choices(words, weight, k=size))

    docs = [(i, text(draw.choice([1, 5, 30, 200]))) for i in range(n)]
    docs += [(None, text(30)), (5, text(10)), (5, docs[5][1]), (500, None), (501, "  .,! "), (502, ""), (503, text(20_000)), (7, docs[7][1])]
    items = [(i, text(draw.choice([1, 3, 12]))) for i in range(12)] + [(3, "w1 w2"), (None, "w3"), (90, None), (91, "unknownterm"), (92, ""), (93, "THE the The")]
    return docs, items


def test_every_pair(spark, monkeypatch):
    docs, items = corpus()
    table = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, docs int, slices string").repartition(5)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")
    expected = sorted(plain.ranked(docs, items, 10), key=repr)
    assert sorted((tuple(r) for r in lexical.search(table, asked, 10).collect()), key=repr) == expected
    monkeypatch.setattr(lexical, "ITEM_TERMS", 5)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 16)
    assert sorted((tuple(r) for r in lexical.search(table, asked, 10).collect()), key=repr) == expected


def test_bounds_are_never_below_scores_and_exclude_some(spark):
    docs, items = corpus(2)
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    blocks = [r.asDict() for r in index.collect()]
    block = next(lexical.item_blocks(spark.createDataFrame(items, "item_id long, text string")))
    n_docs, n_terms = sum(len(b["docs"]) for b in blocks), sum(sum(b["lengths"]) for b in blocks)
    frequency = lexical.document_frequencies(index, block.terms)
    weights = np.array([int(1000 * np.log((2 * n_docs + 2) / (2 * x + 1))) if x else 0 for x in frequency])
    searcher, excluded, pairs = lexical.Searcher(block, weights, n_docs, n_terms), 0, 0
    for b in blocks:
        bounds = searcher.bounds(b)
        exact = np.zeros_like(bounds)
        for item, doc, score in searcher.exact(b, np.ones(bounds.shape, bool)):
            exact[item, doc] = score
        assert (bounds >= exact).all()
        floor = np.sort(exact, axis=1)[:, -10:-9] if exact.shape[1] >= 10 else exact.max(axis=1, keepdims=True)
        excluded, pairs = excluded + int((bounds < floor).sum()), pairs + bounds.size
    assert excluded > pairs // 3


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id int, text string")
    found = lexical.search(none, items)
    assert found.count() == 0 and found.dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert lexical.search(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items.limit(0)).count() == 0


def test_bounds_hold_scores_of_one_item_at_a_time():
    """The scores of all terms of a block of items at once took 24 bytes a term and document."""
    terms = [f"t{i}".encode() for i in range(lexical.ITEM_TERMS)]
    items = lexical.Items(tuple(range(200)), tuple(terms), tuple(np.arange(i, len(terms), 200) for i in range(200)))
    searcher = lexical.Searcher(items, np.arange(1, len(terms) + 1), 256, 256 * 300)
    held = [lexical._held(doc, lexical.Counter({x: 1 + (doc + n) % 40 for n, x in enumerate(terms[doc::37])})) for doc in range(256)]
    row = lexical._block(held)
    tracemalloc.start()
    bounds = searcher.bounds(row)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(terms) * 256
    for doc in (0, 100, 255):
        own = dict(zip(held[doc][1].split(b" "), held[doc][2].tolist()))
        m = int(searcher.lengths(row)[doc])
        exact = [sum(int(searcher.weights[t]) * lexical.term_score(1, own[terms[t]], m) for t in x if terms[t] in own) for x in items.places]
        assert (bounds[:, doc] >= exact).all()
