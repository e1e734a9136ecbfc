"""The training-data operators against brute force, exact round trips and held-out accuracy, with odd rows."""

import hashlib
import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from auditframe.llm import bpe, html, language, mixing, quality, simhash, spans, toxicity, urls, vectors
from auditframe.llm.queries import MIX_WEIGHTS, URL_RULES, mixed_documents

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_key string, spans string"
LONG = "Some words, it's 12 o'clock. " * 4000


def documents(spark, rows):
    """Rows (doc_id, text, lang, source), with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None, "k", "s") for i, t, lang, s in rows], DOCS)


def odd_documents(spark):
    return documents(spark, [(1, None, None, None), (2, "", "en", "a"), (3, "   \n\t ", "en", "a"), (4, "Hello, world's end!  <|endoftext|>", "en", "a"), (4, "Hello, world's end!  <|endoftext|>", "en", "a"), (None, "no id here é 中文 😀", "fr", "b"), (5, LONG, "en", "a"), (5, "other text of the same id", "en", None)])


# ---- byte-level BPE

def test_pretokens_and_ids_are_those_of_the_library():
    codec = bpe.Codec(RANKS, bpe.class_table())
    draw = random.Random(3)
    alphabet = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", " ", "\n", "\t", "a", "Z", "é", "1", "٣", "!", "-", "　", "\xa0", "\x85", "\x1c", "😀", "ſ", "中"]
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 30))) for _ in range(3000)]
    texts += ["a" * 3000, " " * 999 + "x", "'" * 70 + "s", "".join(draw.choice("abcdeth") for _ in range(2000))]
    for text, ids in zip(texts, bpe._joined(codec, [t.encode() for t in texts])):
        assert ids.tolist() == ENCODING.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()


def test_classes_follow_the_pattern():
    table = bpe.class_table()
    letters = (bpe.C_LETTER, bpe.C_SHORT, bpe.C_R, bpe.C_V, bpe.C_L, bpe.C_E)
    for point in range(0x20000):
        kind = unicodedata.category(chr(point))
        if kind not in ("Cn", "Cs"):  # assigned later, or no character
            assert (kind[0] == "L") == (table[point] in letters) and (kind[0] == "N") == (table[point] == bpe.C_NUMBER)


def test_long_texts_are_cut_without_a_trace():
    codec = bpe.Codec(RANKS, bpe.class_table())
    parts = bpe.segments(LONG.encode(), 5000)
    assert b"".join(parts) == LONG.encode() and len(parts) > 5
    assert [i for p in parts for i in codec.pass_ids([p])[0].tolist()] == ENCODING.encode_ordinary(LONG)


def test_round_trip_of_odd_rows(spark):
    found = bpe.round_trip(odd_documents(spark), RANKS).collect()
    expected = sorted((str(i), len(x := ENCODING.encode_ordinary(t or "")), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ((r.doc_id, r.text) for r in odd_documents(spark).collect()))
    assert sorted((str(r[0]), *r[1:]) for r in found) == expected
    coded = bpe.encode(odd_documents(spark), RANKS)
    decoded = {bytes(r.decoded).decode() for r in bpe.decode(coded, RANKS).collect()}
    assert decoded == {r.text or "" for r in odd_documents(spark).collect()}
    row = coded.where("doc_id = 4").first()
    assert row.token_offsets[0] == 0 and len(row.token_offsets) == len(row.token_ids)


def test_empty_tables(spark):
    none = odd_documents(spark).where("doc_id = 99")
    assert bpe.round_trip(none, RANKS).count() == 0
    assert simhash.near_groups(none).count() == 0
    assert simhash.keep_one_per_group(none).count() == 0
    assert spans.without_repeats(none).count() == 0
    assert mixed_documents(none).count() == 0
    assert quality.judged(none).count() == 0
    assert language.predict(none, language.learn_from(none)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0


# ---- SimHash

def plain_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_groups(pairs, distance):
    """Smallest id of each component of (id, fingerprint), by repeated sweeps."""
    low = {p: p[0] for p in pairs}
    moved = True
    while moved:
        moved = False
        for p in pairs:
            for q in pairs:
                if (p[1] ^ q[1]).bit_count() <= distance and low[q] < low[p]:
                    low[p], moved = low[q], True
    return low


def test_fingerprints_and_groups(spark):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(draw.choices(words, k=draw.choice([0, 1, 2, 3, 8, 40, 600]))) for _ in range(50)]
    base = " ".join(draw.choices(words, k=300))
    texts += [base + f" {i}" for i in range(25)] + [base] * 5 + ["A b C", "a B c", ""]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    found = {r.doc_id: r for r in simhash.near_groups(documents(spark, rows)).collect()}
    prints = [(i, plain_fingerprint(t)) for i, t in enumerate(texts)]
    assert {i: found[i].fp % (1 << 64) for i, _ in prints} == dict(prints)
    low = plain_groups(prints, 2)
    assert {i: found[i].component_id for i, _ in prints} == {p[0]: low[p] for p in prints}


def test_links_span_dense_nodes_at_every_level(spark):
    draw = np.random.default_rng(2)
    dense = (np.uint64(1) << np.uint64(50)) | draw.integers(0, 1 << 9, 400).astype(np.uint64)
    loose = draw.integers(0, 2**63, 100, dtype=np.uint64)
    values = np.unique(np.concatenate([dense, loose, loose ^ np.uint64(5)]))
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    links = simhash.fingerprint_links(frame, 2, node_size=20).collect()
    parent = {int(v): int(v) for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert ((a ^ b) % (1 << 64)).bit_count() <= 2 or root(a) == root(a)
        parent[root(a)] = root(b)
    for v in values:
        for w in values[np.bitwise_count(values ^ v) <= 2]:
            assert root(int(v)) == root(int(w))
    low = plain_groups([(int(v), int(v)) for v in values], 2)
    assert len(set(low.values())) == len({root(int(v)) for v in values})


def test_one_of_each_group_stays(spark):
    kept = simhash.keep_one_per_group(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "5", "None"]  # 2 and 3 have no words, as 1


# ---- repeated spans

def test_repeated_passages_go_but_for_the_first(spark):
    passage = "The river runs along the old mill road today. It turns north near the stone bridge there. Nobody has crossed it since the flood of spring. Only cats do."
    rows = [(1, "Alpha one. " + passage + " Beta is here now.", "en", "a"), (2, "Gamma two!\n" + passage.upper() + "\nDelta ends it.", "en", "a"), (3, "Only cats do. Short things repeat. Only cats do.", "en", "a"), (4, passage + " " + passage, "en", "a"), (5, None, "en", "a"), (6, "", "en", "a"), (7, "x " * 5000, "en", "a")]
    found = {r.doc_id: r for r in spans.without_repeats(documents(spark, rows)).collect()}
    assert found[1].text == rows[0][1] and found[3].text == rows[2][1] and found[5].text is None and found[6].text == ""
    assert found[2].text == "Gamma two!\nDelta ends it." and found[2].n_removed == 4
    assert found[4].text == "" and found[4].text_key == "k" and found[4].spans == "s"
    assert len(found[7].text) < len(rows[6][1])


def test_spans_as_by_hand(spark):
    draw = random.Random(8)
    sentences = [" ".join(draw.choices("abcdefghij", k=draw.randint(1, 14))) + draw.choice([". ", "! ", "\n"]) for _ in range(40)]
    texts = ["".join(draw.choices(sentences, k=draw.randint(1, 12))) for _ in range(60)]
    firsts, expected = {}, {}
    for i, text in enumerate(texts):
        edges = spans.sentence_edges(text)
        assert "".join(text[a:b] for a, b in zip(edges, edges[1:])) == text
        words = [tuple(text[a:b].lower().split()) for a, b in zip(edges, edges[1:])]
        gone, counts = set(), [len(w) for w in words]
        windows = set()
        for a in range(len(words)):
            b = next((b for b in range(a + 2, len(words) + 1) if sum(counts[a:b]) >= spans.RUN_WORDS), None)
            windows |= {(a, b)} if b else set()
            c = next((c for c in range(a - 1, -1, -1) if sum(counts[c:a + 1]) >= spans.RUN_WORDS), None)
            windows |= {(c, a + 1)} if c is not None else set()
        for a, b in sorted(windows):
            if firsts.setdefault(tuple(words[a:b]), (i, a)) != (i, a):
                gone |= set(range(a, b))
        expected[i] = len(gone)
    found = spans.without_repeats(documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()
    assert {r.doc_id: r.n_removed for r in found} == expected


# ---- mixing

def test_shortages_reach_siblings_first(spark):
    rows = [(i, "w " * 10, "en", f"s{i % 2}") for i in range(40)] + [(100 + i, "w " * 10, "de", "s2") for i in range(4)] + [(200, None, "de", "s2"), (201, "", None, None)]
    from pyspark.sql import functions as F

    docs = documents(spark, rows)
    found = mixing.mix(docs, {"lang": F.col("lang"), "source": F.col("source")}, {"lang": {"en": 1, "de": 1}, "source": {"s0": 9, "s1": 1}}, lambda t: t, mixing.word_tokens("text"), max_epochs=1).collect()
    taken = {}
    for r in found:
        taken[r.source] = taken.get(r.source, 0) + r.n_tokens * r.copies
    # de has 40 tokens only; en takes the other 400, of which s0 can give 200 and s1 the rest.
    assert taken == {"s2": 40, "s0": 200, "s1": 200}
    twice = mixing.mix(docs, {"lang": F.col("lang")}, {"lang": {"en": 1, "de": 1}}, lambda t: t // 2, mixing.word_tokens("text"), max_epochs=2)
    assert {r.copies for r in twice.where("lang = 'de'").collect()} == {2}
    repeated = mixing.repeat_rows(docs, twice)
    assert repeated.columns == docs.columns and repeated.where("lang = 'de' and n_chars = 20").count() == 8
    assert MIX_WEIGHTS["lang"]["en"] == 4


# ---- language and toxicity

def test_mixture_finds_the_languages_of_a_text():
    draw = np.random.default_rng(0)
    model = draw.dirichlet(np.full(language.CELLS, 0.05), 3)
    one = draw.choice(language.CELLS, 400, p=model[1])
    both = np.concatenate([one, draw.choice(language.CELLS, 200, p=model[2])])
    assert language.proportions(one, model).tolist() == [0, 1, 0]
    share = language.proportions(both, model)
    assert share[0] == 0 and abs(share[1] - 2 / 3) < 0.05


def test_language_of_held_out_documents(spark):
    words = {"en": "the thing was on her way and that".split(), "de": "der und nicht schön groß über eine".split()}
    draw = random.Random(1)
    rows = [(i, " ".join(draw.choices(words[lang], k=12)), lang, "s") for i in range(120) for lang in [draw.choice(["en", "de"])]]
    docs = documents(spark, rows).unionByName(documents(spark, [(900, None, "en", "s"), (901, "12 !? 34", "en", "s"), (None, "the thing", None, None)]))
    found = language.predict(docs, language.learn_from(docs)).collect()
    guess = {r.doc_id: r for r in found}
    assert all(guess[i].lang_pred == lang and 0 < guess[i].score <= 1 for i, _, lang, _ in rows)
    assert guess[900].lang_pred == guess[901].lang_pred == "und" and guess[900].score == 0 and guess[None].lang_pred == "en"
    kept = language.keep_determined(docs, language.learn_from(docs), 0.5)
    assert kept.count() == 121 and kept.columns == docs.columns


def test_toxicity_of_held_out_documents(spark):
    draw = random.Random(4)
    common = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    rows, marks = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = draw.choices(common, k=30)
        if toxic:
            words[draw.randrange(30)] = draw.choice(["grumbleduck", "grumbleduckery", "fizzwort"])
        rows.append((i, " ".join(words), "en", "s"))
        if i % 2:
            marks.append((i, int(toxic)))
    docs = documents(spark, [*rows, (1000, None, None, None), (1001, "", "en", "s")])
    model = toxicity.fit(docs, spark.createDataFrame([*marks, (None, 1), (5, None), (7, 0), (7, 0)], "doc_id long, toxic int"))
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert sum(found[i].predicted != (i % 5 == 0) for i in range(600)) <= 6
    assert found[1000].predicted == 0 and found[1001].score == found[1000].score


# ---- URLs, pages, quality

def test_fixed_and_mined_rules(spark):
    urls_ = [(1, "HTTP://Blog.Example.NET/en/5?x=1"), (2, "https://a.net"), (3, "https://a.net/"), (4, "http://example.com/de/1.html"), (5, "http://x.org/fr/#a/b"), (6, None), (7, "no scheme"), (8, "http://evil.test/buy/1?ref=z"), (8, "http://evil.test/buy/1?ref=z"), (9, "http://notnet/fr/")]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in urls_], "page_id long, url string, host string, tokens string")
    labels = spark.createDataFrame([(f"http://evil.test/buy/{i}", True) for i in range(20)] + [(f"http://good.test/read/{i}", False) for i in range(50)] + [(None, False)], "url string, blocked boolean")
    found = {r.page_id: r for r in urls.judge(pages, labels, URL_RULES).collect()}
    assert {i: (r.rule, r.verdict) for i, r in found.items()} == {1: ("example.net/en/", "allow"), 2: (None, "allow"), 3: ("net/", "block"), 4: ("example.com/de/", "block"), 5: ("org/fr/", "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "block"), 9: (None, "allow")}
    assert (found[1].host, found[1].path, found[6].host, found[7].path) == ("blog.example.net", "/en/5", "", "")
    nothing = urls.judge(pages, labels.where("url = ''"), URL_RULES)
    assert nothing.count() == 10 and nothing.where("page_id = 8 and verdict = 'allow'").count() == 2


def test_main_text(spark):
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href="/">Home</a></nav><div class="sidebar"><p>bar words</p></div><form>Name</form>
    <article><h1>Head &amp; line</h1><p>One <b>bo</b>ld&nbsp;text<br>two<p>a <a href="#">link</a> 1 &lt; 2 <script>var t="</p>";</script>ok</p><div class="ad">buy</div><section class="comments"><p>reader</p></section></article>
    <div id="cookie-notice">We use</div><footer>f</footer>"""
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>   </p><!-- x"), (5, "u", "<article>" + "<p>word &eacute;</p>" * 5000 + "</article>")]
    found = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[1].text == "Head & line One bold text two a link 1 < 2 ok" and found[1].n_chars == len(found[1].text)
    assert found[2].text == found[3].text == found[4].text == "" and found[5].text == " ".join(["word é"] * 5000)


def test_hosts_are_judged_and_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    rows = [(i, good if i % 20 else bad, "en", f"h{i % 4}") for i in range(200)] + [(300 + i, bad if i < 45 else good, "en", "spam") for i in range(50)] + [(400, good, "en", None), (401, None, "en", "h1"), (402, "a b c d e f a b c d e x y z\nq\nq\n \n \n#*", "en", "h2")]
    found = {r.doc_id: r for r in quality.judged(documents(spark, rows)).collect()}
    assert found[1].kept and not found[0].kept and found[400].kept
    assert not found[349].base_failed and not found[349].kept  # a good document of a host that fails
    odd = found[402]
    assert (odd.n_words, odd.n_repeat_words, odd.n_dup_lines, odd.n_symbols) == (17, 10, 1, 2) and odd.word_chars == 18
    assert found[401].n_words == 0 and found[401].base_failed


# ---- vectors

def test_vectors_against_all_pairs(spark):
    draw = np.random.default_rng(6)
    centres = draw.standard_normal((30, 16))
    rows = [(i, [float(x) for x in centres[i % 30] + draw.standard_normal(16) * 0.18], int(i % 30 % 3)) for i in range(300)]
    rows += [(500 + i, rows[0][1], 0) for i in range(6)] + [(600, None, 0), (601, [0.0] * 16, 0), (602, [float("nan")] * 16, 0), (603, rows[0][1], None), (604, rows[0][1][:8], 0), (605, [], 0), (500, rows[0][1], 0), (606, [x * 1e-30 for x in rows[0][1]], 0), (607, [None, *rows[0][1][1:]], 0)]
    frame = spark.createDataFrame([(i, v, k, "x") for i, v, k in rows], "vec_id long, embedding array<double>, label int, node string")
    units = {j: np.array(v) / np.linalg.norm(v) for j, (i, v, k) in enumerate(rows) if v and k is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {j: [m for m in units if m != j and rows[m][2] == rows[j][2] and len(units[m]) == len(units[j]) and units[m] @ units[j] >= 0.93] if j in units else [] for j in range(len(rows))}
    low = {j: rows[j][0] for j in links}
    for _ in range(len(rows)):
        new = {j: min([low[j], *(low[m] for m in links[j])]) for j in links}
        if new == low:
            break
        low = new
    expected = sorted((rows[j][0], len(links[j]), low[j], rows[j][0] == low[j]) for j in links)
    assert sum(len(x) for x in links.values()) > 300
    assert sorted(tuple(r) for r in vectors.near_vectors(frame).collect()) == expected
    small = vectors.CELL_ROWS
    vectors.CELL_ROWS = 16
    try:
        assert sorted(tuple(r) for r in vectors.near_vectors(frame).collect()) == expected
    finally:
        vectors.CELL_ROWS = small


@pytest.mark.parametrize("frame", ["vec_id long, embedding array<float>, label int"])
def test_no_vectors(spark, frame):
    assert vectors.near_vectors(spark.createDataFrame([], frame)).count() == 0
