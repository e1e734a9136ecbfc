"""Chunking, identities, vectors and retrieval against plain Python."""

import math
import random
import uuid
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import re
from pyspark.sql import functions as F

from auditframe.errors import RefusedError
from auditframe.functions import retrieval, text as texts_module
from auditframe.functions.retrieval import dense_top_k, hit_metrics, require_space, sparse_top_k, top_k, validate_vectors
from auditframe.functions.scalars import SPACE_CHARACTERS, collapse_spaces, strip
from auditframe.functions.text import DOCUMENT_NAMESPACE, STOP_WORDS, chunk_pages, pages_from_text, replace_documents, token_vectors


def check_chunks(text, pieces, size, overlap):
    """Properties of the chunks of one page: size, order, cuts at late blanks, shared characters, nothing lost."""
    at, shared = [], 0
    for piece in pieces:
        assert 0 < len(piece) <= size and piece == piece.strip()
        low = at[-1][0] + 1 if at else 0
        high = at[-1][1] if at else 0
        # The page may hold the piece several times; it lies where the one before it allows.
        places = [m.start() for m in re.finditer(f"(?={re.escape(piece)})", text) if m.start() >= low]
        begin = next(p for p in places if p >= max(low, high - overlap))
        assert text[high:begin].strip() == ""  # nothing is skipped
        at.append((begin, begin + len(piece)))
        shared = max(shared, high - begin)
    assert shared <= overlap and (not pieces) == (not text.strip())
    if pieces:
        assert text[at[-1][1]:].strip() == ""


def test_white_space_matches_python(spark):
    assert set(SPACE_CHARACTERS) == {c for c in map(chr, range(0x11000)) if c.isspace()}
    texts = [f"{c}a{c}{c}b {c}" for c in SPACE_CHARACTERS] + ["", "  ", "x​y", "﻿z "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(collapse_spaces(F.col("t")), strip(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(" ".join(t.split()), t.strip()) for t in texts]


@pytest.mark.parametrize("size, overlap", [(24, 8), (10, 9), (1, 0), (7, 3), (1200, 200)])
def test_chunks_and_ids(spark, size, overlap):
    rng = random.Random(size)
    texts = ["".join(rng.choice("ab  é😀") for _ in range(rng.randint(0, 400))) for _ in range(20)] + ["x" * 300, " ", "one"]
    pages = pages_from_text(spark.createDataFrame([(t,) for t in set(texts)], "text string"))
    got = {}
    for r in chunk_pages(pages, size, overlap).collect():
        got.setdefault(r["document_id"], {})[r["chunk_index"]] = (r["chunk_id"], r["text"])
    for t in set(texts):
        clean = " ".join(t.split())
        document = uuid.uuid5(uuid.UUID(DOCUMENT_NAMESPACE), sha256(t.encode()).hexdigest())
        chunks = got.pop(str(document), {})
        check_chunks(clean, [chunks[i][1] for i in range(len(chunks))], size, overlap)
        for i, (name, piece) in chunks.items():
            assert name == str(uuid.uuid5(document, f"page:1:chunk:{i}:{piece}"))
    assert not got


def test_raw_pages_with_long_blank_runs(spark):
    text = "ab" + " " * 50 + "cd  ef" + "\n" * 30 + "gh"
    pages = spark.createDataFrame([("d", 1, text), ("d", 2, "zz")], "document_id string, page_number int, text string")
    pages = pages.withColumn("document_id", F.lit(DOCUMENT_NAMESPACE))
    got = chunk_pages(pages, 8, 3).orderBy("page_number", "chunk_index").collect()
    assert [r["text"] for r in got] == ["ab", "cd  ef", "f", "gh", "zz"]


def test_chunk_refusals(spark):
    pages = spark.createDataFrame([("d", 1, "x")], "document_id string, page_number int, text string")
    for size, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(RefusedError):
            chunk_pages(pages, size, overlap)
    bad = pages_from_text(spark.createDataFrame([("a\0b",)], "text string"))
    for action in (lambda: bad.count(), lambda: bad.select("page_number").collect(), lambda: chunk_pages(bad).collect()):
        with pytest.raises(Exception, match="null bytes"):
            action()


def python_vector(text):
    counts = Counter()
    for word in re.findall("[a-z0-9]+", text.lower()):
        if word not in STOP_WORDS:
            counts[int.from_bytes(sha256(word.encode()).digest()[:4], "big") % 2048] += 1
    norm = math.sqrt(sum(n * n for n in counts.values()))
    return {b: n / norm for b, n in counts.items()}


CHUNKS = [
    ("c1", "The lighthouse keeper paints the gallery rail white every April, before the ferries return."),
    ("c2", "Sourdough rises slowly in a cold kitchen; fold it twice and let it rest overnight."),
    ("c3", "Granite weathers into clay, while limestone dissolves and leaves caves behind."),
    ("c4", "Swifts sleep on the wing and land only at their nests under old roofs."),
    ("c5", "A tram driver rings twice at the market crossing and once at the bridge."),
    ("c6", "the a an"),
]
QUESTIONS = [
    (1, "Which rail does the lighthouse keeper paint white?", "c1"),
    (2, "How often is sourdough folded before resting overnight?", "c2"),
    (3, "What leaves caves behind, granite or limestone?", "c3"),
    (4, "Where do swifts sleep and land?", "c4"),
    (5, "When should a tram driver ring at the market crossing?", "c5"),
]


@pytest.fixture()
def corpus(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id string, text string")


def test_token_vectors(corpus):
    got = {r["chunk_id"]: dict(zip(r["buckets"], r["weights"])) for r in token_vectors(corpus, "chunk_id").collect()}
    for key, text in CHUNKS:
        assert got[key] == pytest.approx(python_vector(text))


def test_retrieval_evaluation(spark, corpus):
    asked = spark.createDataFrame(QUESTIONS, "q long, text string, chunk_id string")
    found = sparse_top_k(token_vectors(corpus, "chunk_id"), token_vectors(asked, "q"), "chunk_id", "q", 2)
    row = hit_metrics(found, asked.select("q", "chunk_id"), "q", "chunk_id").first()
    assert tuple(row) == (5, 1.0, 1.0)


def test_missed_and_second_places(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1)], "q long, i string, rank int")
    expected = spark.createDataFrame([(1, "b"), (2, "z"), (3, "a")], "q long, i string")
    row = hit_metrics(ranked, expected, "q", "i").first()
    assert tuple(row) == pytest.approx((3, 1 / 3, 1 / 6))


def test_zero_scores_fill_up_by_id(spark, corpus):
    asked = spark.createDataFrame([(1, "tram"), (2, "!!")], "q long, text string")
    found = sparse_top_k(token_vectors(corpus, "chunk_id"), token_vectors(asked, "q"), "chunk_id", "q", 3)
    got = {(r["q"], r["rank"]): r["chunk_id"] for r in found.collect()}
    assert [got[1, i] for i in (1, 2, 3)] == ["c5", "c1", "c2"] and [got[2, i] for i in (1, 2, 3)] == ["c1", "c2", "c3"]


@pytest.mark.parametrize("blocks", [(4096, 1024), (16, 2)])
def test_dense_search_against_python(spark, blocks):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 8)).round(1)
    vectors[100:180] = vectors[0]  # copies tie, the id decides
    vectors[200] = 0
    probes = np.vstack([vectors[0], rng.normal(size=(4, 8))])
    items = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(vectors)], "id long, v array<double>").repartition(7)
    asked = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(probes)], "q long, v array<double>")
    found = dense_top_k(items, asked, "id", "q", "v", 100, *blocks)
    got = {}
    for r in found.collect():
        got.setdefault(r["q"], {})[r["rank"]] = r["id"]
    for q, probe in enumerate(probes):
        norms = np.linalg.norm(vectors, axis=1) * np.linalg.norm(probe)
        scores = np.round(np.divide(vectors @ probe, norms, out=np.zeros(300), where=norms > 0), 9)
        expected = sorted(range(300), key=lambda i: (-scores[i], i))[:100]
        assert [got[q][i + 1] for i in range(100)] == expected


@pytest.mark.parametrize("rows", [1, 4096])
def test_search_without_items_and_with_repeated_queries(spark, corpus, rows):
    asked = token_vectors(spark.createDataFrame([("a", "tram"), ("b", "granite")], "q string, text string"), "q")
    vectors = token_vectors(corpus, "chunk_id")
    assert sparse_top_k(vectors.limit(0), asked, "chunk_id", "q", 2, block_items=rows, block_queries=rows).count() == 0
    found = sparse_top_k(vectors, asked.unionByName(asked), "chunk_id", "q", 2, block_items=rows, block_queries=rows).collect()
    assert sorted((r["q"], r["rank"], r["chunk_id"]) for r in found) == [("a", 1, "c5"), ("a", 2, "c5"), ("b", 1, "c3"), ("b", 2, "c3")]


def test_vector_guards(spark):
    good = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>")
    validate_vectors(good, "v", 2)
    for bad in ([1.0], [1.0, float("nan")], [1.0, float("inf")], [1.0, None]):
        with pytest.raises(RefusedError):
            validate_vectors(spark.createDataFrame([(1, bad)], "id long, v array<double>"), "v", 2)
    with pytest.raises(RefusedError):
        dense_top_k(good, good.limit(0), "id", "id", "v", 1)
    for bad in ([1.0], [1.0, float("nan")]):
        with pytest.raises(Exception, match="dimensions do not match|non-finite"):
            dense_top_k(spark.createDataFrame([(1, bad)], "id long, v array<double>"), good.withColumnRenamed("id", "q"), "id", "q", "v", 1).collect()
    spaces = spark.createDataFrame([(1, "p", "m", 2), (2, "p", "n", 2)], "id long, embedding_provider string, embedding_model string, embedding_dimensions int")
    assert [r["id"] for r in require_space(spaces, "p", "m", 2).collect()] == [1]


def test_top_k_ties(spark):
    scores = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (1, "c", 0.9)], "q long, i string, score double")
    assert [r["i"] for r in top_k(scores, "q", "i", 2).orderBy("rank").collect()] == ["c", "a"]


def test_reingest(spark, as_rows):
    old = spark.createDataFrame([("d1", "x"), ("d1", "y"), ("d2", "z")], "document_id string, text string")
    new = spark.createDataFrame([("d1", "n")], "document_id string, text string")
    assert as_rows(replace_documents(old, new)) == [("d1", "n"), ("d2", "z")]


def test_blocks_are_bounded_by_their_numbers(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_ENTRIES", 10)
    rows = [(i, [1.0] * size) for i, size in enumerate([4, 4, 4, 25, 1, 0, 9, 2])]
    blocks = retrieval._pack(spark.createDataFrame(rows, "id long, v array<double>").coalesce(1), "id", ["v"], 3).collect()
    assert [b["ids"] for b in blocks] == [[0, 1], [2], [3], [4, 5, 6], [7]]
    assert [b["sizes"] for b in blocks] == [[4, 4], [4], [25], [1, 0, 9], [2]] and sum(len(b["second"]) for b in blocks) == 49


def test_vectors_come_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(texts_module, "STEP_TEXTS", 3)
    rows = [(i, "alpha beta " * i + f"word{i}") for i in range(10)] + [(10, None), (11, "")]
    got = {r["id"]: dict(zip(r["buckets"], r["weights"])) for r in token_vectors(spark.createDataFrame(rows, "id long, text string").coalesce(1), "id").collect()}
    assert len(got) == 12 and not got[10] and not got[11] and all(abs(sum(w * w for w in got[i].values()) - 1) < 1e-9 for i in range(10))
