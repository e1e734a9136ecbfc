"""Suffix order against sorting, removal of repeated bytes against counting all windows, with odd rows and hot anchors."""

import random

import numpy as np
import plain
import pytest

from auditframe.llm import induced, suffixes

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def common_prefix(a, b, depth):
    n = 0
    while n < min(len(a), len(b), depth) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("ranges, held, generations", [(1 << 15, 1 << 21, 6), (4, 7, 6), (8, 3, 0)])
def test_suffix_order(tmp_path, monkeypatch, ranges, held, generations):
    """Also with queues that go to disk after a few tuples and ranges of a few suffixes."""
    monkeypatch.setattr(induced, "RANGE_SUFFIXES", ranges)
    monkeypatch.setattr(induced, "HELD_TUPLES", held)
    monkeypatch.setattr(induced, "GENERATIONS", generations)
    monkeypatch.setattr(induced, "HELD_BYTES", 64 if held < 100 else 1 << 20)
    draw = random.Random(ranges)
    for number in range(150):
        body = [draw.randint(1, draw.choice([1, 2, 5, 26])) for _ in range(draw.randint(0, 50))]
        if draw.random() < 0.4 and body:
            body = (body[: draw.randint(1, len(body))] * 8)[:90]
        text, depth = [*body, 0], draw.choice([3, 10, 1000])
        folder = tmp_path / str(number)
        folder.mkdir()
        places, common = (np.concatenate(x).tolist() for x in zip(*induced.suffix_order(np.array(text, np.int32), induced.Shelf(str(folder)), depth)))
        order = sorted(range(len(text)), key=lambda i: text[i:])
        assert places == order
        assert common == [0, *(common_prefix(text[a:], text[b:], depth) for a, b in zip(order, order[1:]))]


def corpus(seed):
    draw = random.Random(seed)

    def words(n):
        return " ".join("".join(draw.choice("abcdeé") for _ in range(draw.randint(2, 7))) for _ in range(n))

    shared, long_one = words(60), words(900)
    rows = [(1, None), (2, ""), (3, "short"), (4, "a" * 900), (5, "ab" * 700), (6, long_one), (7, long_one), (8, long_one[:400] + "!" + long_one[401:]), (8, "another text of the same id " + shared)]
    rows += [(10 + i, words(draw.randint(0, 60)) + shared + words(draw.randint(0, 60))) for i in range(30)]
    rows += [(None, words(20) + shared[:150] + words(20)), (50, words(30)), (50, words(30))]
    return rows + [rows[5], (60, rows[12][1])]


@pytest.mark.parametrize("width, split", [(100, 2_000), (150, 3)])
def test_repeated_bytes(spark, monkeypatch, width, split):
    """``split``: an anchor with more segments is dealt to several shards."""
    monkeypatch.setattr(suffixes, "ANCHOR_BYTES", 30)
    monkeypatch.setattr(suffixes, "SHARD_SEGMENTS", split)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 20_000)
    rows = corpus(split)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, marks string")
    found = suffixes.without_repeated_bytes(docs.repartition(3), width)
    assert sorted((tuple(r) for r in found.select(*COLUMNS).collect()), key=repr) == sorted(plain.without_repeats(rows, width), key=repr)


def test_equal_windows_have_equal_anchors():
    draw = random.Random(4)
    texts = [bytes(draw.choice(b"abc") for _ in range(700)) for _ in range(6)]
    texts += [texts[0][50:500], b"x" * 30 + texts[1][100:650]]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(x) for x in texts])
    place, count, anchor = suffixes.segments(data, np.append(0, ends[:-1]), ends, 400)
    of = {}
    for a, n, h in zip(place.tolist(), count.tolist(), anchor.tolist()):
        for p in range(a, a + n):
            of.setdefault(data[p : p + 400].tobytes(), set()).add(h)
    assert sum(count) == sum(max(0, len(x) - 399) for x in texts) and all(len(x) == 1 for x in of.values())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.without_repeated_bytes(docs).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r)[:4] for r in suffixes.without_repeated_bytes(nothing).select(*COLUMNS).collect()) == [(1, 0, 0, 0), (2, 0, 0, 0)]
