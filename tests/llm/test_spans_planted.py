"""Passages of over 50 words, planted mid-sentence at different offsets, against brute force over word windows."""

import random

from auditframe.llm import spans

DOCS = "doc_id long, text string"
EDGE = 2 * spans.CUT_WINDOW - 1


def corpus(stops):
    """Texts of own words around shared passages; ``stops`` is the share of words that end a sentence."""
    draw, number = random.Random(11), iter(range(10**6))

    def own(count):
        return [f"Own{next(number)}" + ("." if draw.random() < stops else "") for _ in range(count)]

    texts = []
    for length in (51, 52, 60, 75, 120, 400):
        for _ in range(8):
            passage = [f"w{draw.randint(0, 400)}" + (draw.choice([".", "!"]) if draw.random() < stops else "") for _ in range(length)]
            for _ in range(3):
                texts.append(own(draw.randint(0, 60)) + passage + own(draw.randint(0, 60)))
    return texts


def repeated_words(texts, size=51):
    """Of every text the places of words inside windows of ``size`` words that an earlier place has."""
    seen, gone = {}, []
    for number, words in enumerate(texts):
        here = set()
        for i in range(len(words) - size + 1):
            if seen.setdefault(tuple(words[i:i + size]), (number, i)) != (number, i):
                here |= set(range(i, i + size))
        gone.append(here)
    return gone


def check(spark, stops):
    texts = corpus(stops)
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], DOCS)
    found = {r.doc_id: r.text.split() for r in spans.without_repeats(frame).collect()}
    for i, (words, gone) in enumerate(zip(texts, repeated_words(texts))):
        left = found[i]
        assert [w for w in left if w.startswith("Own")] == [w for w in words if w.startswith("Own")]
        kept = [w for w in left if not w.startswith("Own")]
        if not gone:
            assert left == words
        else:  # what stays of a passage is fewer words than an edge at either end
            shared = [w for k, w in enumerate(words) if k in gone]
            head = next((k for k, (a, b) in enumerate(zip(kept, shared)) if a != b), len(kept))
            tail = len(kept) - head
            assert head <= EDGE and kept[head:] == shared[len(shared) - tail:] and len(kept) <= 2 * EDGE, (i, len(shared), len(kept))


def test_passages_inside_texts_without_sentence_ends(spark):
    check(spark, 0.0)


def test_passages_that_begin_and_end_mid_sentence(spark):
    check(spark, 0.03)
    check(spark, 0.08)


def test_cuts_agree_inside_a_shared_passage():
    draw = random.Random(2)
    for _ in range(300):
        passage = " ".join(f"w{draw.randint(0, 50)}" for _ in range(51))
        places = []
        for _ in range(2):
            before = " ".join(f"v{draw.randint(0, 50)}" for _ in range(draw.randint(1, 40))) + " "
            edges = [e - len(before) for e in spans.sentence_edges(before + passage + " tail of words")]
            places.append({len(passage[:e].split()) for e in edges if 0 < e < len(passage)})
        inner = [{p for p in found if spans.CUT_WINDOW - 1 <= p <= 51 - spans.CUT_WINDOW} for found in places]
        assert inner[0] == inner[1] and max(inner[0]) - min(inner[0]) >= spans.LONG_SENTENCE


def test_single_sentences_of_middle_length_stay(spark):
    """Two sentences or 25 words make a run; a repeated sentence of 20 to 24 words does not."""
    line = " ".join(f"w{i}" for i in range(24)) + "."
    frame = spark.createDataFrame([(i, f"Own {i} words here. {line} Then others {i} follow.") for i in range(3)], DOCS)
    assert spans.without_repeats(frame).where("n_removed > 0").count() == 0


def test_texts_of_a_pass_are_cut_as_each_alone():
    draw = random.Random(3)
    marks = ["a", "b", "Σ", "İ", ".", "!", '"', "')", " ", "  ", "\n", "\t", "　", "word", "The", "of"]
    texts = ["", None, " ", "\n", " \n a", "a\n ", ". ", '." a', "ends.", " begins"]
    texts += ["".join(draw.choices(marks, k=draw.randint(0, 40))) for _ in range(500)]
    texts += [" ".join(draw.choices(["x", "y", "z.", 'v!"'], k=draw.randint(20, 200))) for _ in range(100)]
    draw.shuffle(texts)
    passes = list(spans.in_passes(texts))
    assert len(passes) < 10
    edges, found = [], []
    for start, cut in passes:
        edges += [[0, *cut.ends[a:b].tolist()] for a, b in zip(cut.first, cut.first[1:])]
        found += [(start + int(x[0]), *map(int, x[1:])) for x in zip(*spans.runs(cut))]
    assert edges == [spans.sentence_edges(x or "") for x in texts]
    assert "".join(x or "" for x in texts) == "".join((x or "")[a:b] for x, own in zip(texts, edges) for a, b in zip(own, own[1:]))
    assert sorted(found) == sorted((i, *map(int, x[1:])) for i, text in enumerate(texts) for x in zip(*spans.runs(spans.pieces([text or ""]))))
