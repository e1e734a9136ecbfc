"""Near copies of the pipeline against brute force over all pairs, and the measured recall of the bands."""

import os
import random

import numpy as np
import pytest

import corpus_pipeline
from auditframe.llm import copies

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset([tuple(words)] if 0 < len(words) < 5 else zip(*(words[i:] for i in range(5))))


def plain_survivors(rows):
    """Smallest ids of the groups of (id, text) linked by similarity 0.8, comparing every pair that shares a shingle."""
    sets, places = [plain_set(t) for _, t in rows], {}
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, own in enumerate(sets):
        shared = {}
        for shingle in own or [None]:
            for j in places.get(shingle, ()):
                shared[j] = shared.get(j, 0) + 1
            places.setdefault(shingle, []).append(i)
        for j, both in shared.items():
            if not own or both / (len(own) + len(sets[j]) - both) >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for i, (key, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), key), key)
    return sorted(low.values())


def planted():
    """Texts of 5 to 400 words, with copies changed in ever more words, chains of copies, short and empty texts."""
    draw, rows = random.Random(4), []
    for _ in range(60):
        words = [f"w{draw.randint(0, 5000)}" for _ in range(draw.choice([5, 8, 30, 120, 400]))]
        rows.append(" ".join(words))
        for _ in range(4):  # each changes the one before it, so the ends of a chain may be far apart
            words = list(words)
            for _ in range(draw.randint(0, max(1, len(words) // 40))):
                words[draw.randrange(len(words))] = f"x{draw.randint(0, 5000)}"
            rows.append(draw.choice([" ", "  ", "\n"]).join(words).upper())
    rows += ["", None, " \n", "one two", "ONE  two", "one two three", "alpha beta gamma delta", "alpha beta gamma delta epsilon"]
    draw.shuffle(rows)
    return list(enumerate(rows))


def survivors(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], SCHEMA)
    return sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").select("doc_id").collect())


def test_planted_copies_as_brute_force(spark):
    rows = planted()
    expected = plain_survivors(rows)
    assert 60 < len(expected) < 200
    assert survivors(spark, rows) == expected


def test_pairs_that_miss_the_smallest_of_their_bucket_are_compared(spark, monkeypatch):
    """With bands of one row that nearly everything shares, a bucket holds several groups."""
    monkeypatch.setattr(copies, "sketches", one_bucket(copies.sketches))
    rows = planted()[:120]
    assert survivors(spark, rows) == plain_survivors(rows)


def one_bucket(sketches):
    from pyspark.sql import functions as F

    return lambda *args: sketches(*args).withColumn("bands", F.array(F.lit(7).cast("long")))


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not available")
def test_whole_table_as_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = survivors(spark, rows)
    assert found == plain_survivors(rows)
    assert not {2, 56} <= set(found)  # similarity 0.967, five bits apart


def test_recall_of_the_bands_at_the_bound():
    draw, met = np.random.default_rng(6), 0
    for _ in range(4000):  # 80 shared, 10 and 10 own: similarity 0.8
        values = draw.integers(0, 1 << 64, 100, dtype=np.uint64)
        a, b = np.sort(values[:90]), np.sort(np.concatenate([values[:80], values[90:]]))
        assert copies.similarity(a, b) == 0.8
        met += bool(np.any(copies.bands(a) == copies.bands(b)))
    assert met >= 3996  # 0.99995 expected


def test_simhash_finds_copies_that_share_no_band(spark, monkeypatch):
    """With a band of its own for every text, only the fingerprints are left to find near copies."""
    from pyspark.sql import functions as F

    plain = copies.sketches
    monkeypatch.setattr(copies, "sketches", lambda *args: plain(*args).withColumn("bands", F.array("node")))
    draw, rows = random.Random(8), []
    for i in range(20):
        words = [f"w{draw.randint(0, 5000)}" for _ in range(600)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words, f"end{i}"]))]
    found = [copies.majority(copies.shingle_set(t.encode())) for _, t in rows]
    near = [i for i in range(20) if (found[2 * i] ^ found[2 * i + 1]).bit_count() <= copies.DISTANCE]
    assert len(near) > 15
    kept = survivors(spark, rows)
    assert not {2 * i + 1 for i in near} & set(kept) and {2 * i for i in range(20)} <= set(kept)


def crowd(size, own):
    """Texts that share a passage of 80 words and have ``own`` words of their own in front."""
    passage = " ".join(f"p{i}" for i in range(80))
    return [(i, " ".join(f"o{i}x{j}" for j in range(own)) + " " + passage) for i in range(size)]


def test_texts_with_a_common_passage_make_no_pairs(spark):
    rows = crowd(200, 30)  # 76 of 136 shingles shared: far from similar
    rows += [(1000 + i, f"{t} {'a' if i % 2 else 'b'}") for i, t in rows[:40]]  # near copies of some, of other roots here
    texts = spark.createDataFrame([(i, t) for i, t in rows], "node long, text string")
    pairs = copies.crossing_pairs(texts.select("node", texts["node"].alias("root")), texts, 0.8, 5)
    assert {(r.a, r.b) for r in pairs.collect()} == {(i, 1000 + i) for i in range(40)}


def test_crossing_pairs_hold_every_similar_pair(spark):
    rows = [(i, t) for i, t in planted() + [(900 + i, t) for i, t in crowd(30, 6)] if t]
    sets = {i: copies.shingle_set(t.encode()) for i, t in rows}
    ids = {sets[i].tobytes(): i for i in sorted(sets, reverse=True)}  # one row per set
    rows = [(i, t) for i, t in rows if ids[sets[i].tobytes()] == i and len(sets[i])]
    wanted = {(a, b) for a, _ in rows for b, _ in rows if a < b and copies.similarity(sets[a], sets[b]) >= 0.8}
    texts = spark.createDataFrame(rows, "node long, text string")
    found = {(r.a, r.b) for r in copies.crossing_pairs(texts.select("node", texts["node"].alias("root")), texts, 0.8, 5).collect()}
    assert len(wanted) > 100 and wanted <= found and len(found) < 2 * len(wanted)


def changed_copies(count):
    """A text of 146 shingles and copies of it, each with 1 to 7 changed words: many are similar to it and few to each other."""
    draw = random.Random(9)
    words = [f"w{draw.randint(0, 5000)}" for _ in range(150)]
    rows = [" ".join(words)]
    for _ in range(count):
        own = list(words)
        for place in draw.sample(range(150), draw.randint(1, 7)):
            own[place] = f"x{draw.randint(0, 500)}"
        rows.append(" ".join(own))
    return list(enumerate(rows))


def test_pairs_of_a_large_group_grow_no_faster_than_it(spark, monkeypatch):
    """Copies changed each in its own way meet the text they share, not one another."""
    made, plain = {}, copies.settle
    for count in (150, 600):
        rows = changed_copies(count)
        monkeypatch.setattr(copies, "settle", lambda df, label: made.setdefault(f"{label} {count}", plain(df, label)))
        assert survivors(spark, rows) == plain_survivors(rows)
        assert made[f"other-pairs {count}"].count() <= 2 * count
