"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.llm import bpe, html, language, lexical, mixing, quality, simhash, spans, spelling, suffixes, toxicity, urls, vectors
from auditframe.llm.registry import QUERIES, SQL, query  # noqa: F401  (read by the entry points)
from auditframe.workload.registry import table

BPE_RANKS = "byte_bpe_50k.tiktoken"


@query()
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(BPE_RANKS))
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks)


@query()
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"), distance=2, words_per_shingle=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query(sql="""
    WITH RECURSIVE usable AS (
        SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
        WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0
    ), pairs AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
        ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93
    ), reach AS (
        SELECT a AS vec_id, b AS other FROM pairs
        UNION
        SELECT r.vec_id, p.b FROM reach r JOIN pairs p ON r.other = p.a
    ), low AS (SELECT vec_id, min(other) AS other FROM reach GROUP BY vec_id)
    SELECT e.vec_id, (SELECT count(*) FROM pairs p WHERE p.a = e.vec_id) AS n_links,
        least(e.vec_id, coalesce(low.other, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(low.other, e.vec_id)) AS kept
    FROM embeddings e LEFT JOIN low ON low.vec_id = e.vec_id
""")
def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


# The tables name no domain: sources are dealt to three by the first digit of their md5.
DOMAIN = "CASE WHEN substr(md5(coalesce(source, '(none)')), 1, 1) < '6' THEN 'a' WHEN substr(md5(coalesce(source, '(none)')), 1, 1) < 'b' THEN 'b' ELSE 'c' END"
MIX_WEIGHTS = {"domain": {"a": 3, "b": 2, "c": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}


def mixed_documents(docs: DataFrame) -> DataFrame:
    levels = {"domain": F.expr(DOMAIN), "lang": F.col("lang"), "source": F.col("source")}
    return mixing.mix(docs, levels, MIX_WEIGHTS, budget=lambda tokens: tokens * 6 // 10, tokens=mixing.word_tokens("text"), max_epochs=2, seed=17)


def _share_sql(name: str, parent: str, level: str, weight: str) -> str:
    """One level of the tree in SQL: fill the children of every parent up by weight."""
    by = f"PARTITION BY {parent}" if parent else ""
    join = f"JOIN {name}_above USING ({parent})" if parent else "CROSS JOIN total_budget"
    head = f"{parent}, {level}" if parent else level
    return f"""
    {name}_0 AS (SELECT {head}, sum(total * 2)::HUGEINT AS capacity, {weight} AS weight FROM leaves GROUP BY {head}),
    {name}_1 AS (SELECT *, sum(capacity) OVER (w ROWS UNBOUNDED PRECEDING) AS filled, sum(weight) OVER ({by}) - sum(weight) OVER (w ROWS UNBOUNDED PRECEDING) AS later
        FROM {name}_0 {join} WINDOW w AS ({by} ORDER BY capacity / weight::DOUBLE, {level})),
    {name}_2 AS (SELECT *, filled <= budget AND capacity * later <= weight * (budget - filled) AS is_full FROM {name}_1),
    {name}_3 AS (SELECT *, budget - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({by}) AS rest, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({by}) AS still FROM {name}_2),
    {name} AS (SELECT {head}, (CASE WHEN is_full THEN capacity ELSE least(capacity, weight * rest // greatest(still, 1)) END)::HUGEINT AS share FROM {name}_3)"""


MIX_SQL = f"""
    WITH RECURSIVE rows_ AS (
        SELECT doc_id, {DOMAIN} AS domain, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
            len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents
    ), full_rows AS (SELECT * FROM rows_ WHERE n_tokens > 0),
    leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS total FROM full_rows GROUP BY ALL),
    total_budget AS (SELECT sum(total)::HUGEINT * 6 // 10 AS budget FROM leaves),
    {_share_sql("s1", "", "domain", "CASE domain WHEN 'a' THEN 3 WHEN 'b' THEN 2 ELSE 1 END")},
    s2_above AS (SELECT domain, share AS budget FROM s1),
    {_share_sql("s2", "domain", "lang", "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END")},
    s3_above AS (SELECT domain, lang, share AS budget FROM s2),
    {_share_sql("s3", "domain, lang", "source", "1")},
    plan AS (SELECT domain, lang, source, share // total AS whole, share % total AS rest FROM s3 JOIN leaves USING (domain, lang, source)),
    drawn AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17:' || (whole + 1) || ':' || coalesce(doc_id::VARCHAR, '(none)')) RANGE UNBOUNDED PRECEDING) AS upto
        FROM full_rows JOIN plan USING (domain, lang, source))
    SELECT doc_id, domain, lang, source, n_tokens, (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::INTEGER AS copies FROM drawn
    WHERE whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0
"""


@query(sql=MIX_SQL)
def op2_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_documents(table(spark, sf_dir, "documents"))


@query()
def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spans.without_repeats(docs).select("doc_id", "text", "n_sentences", "n_removed")


@query()
def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.learn_from(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "languages")


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(toxicity.fold() == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


@query()
def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page counts as blocked in the labels if the label of its number calls it poor or toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    blocked = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").where("quality is not null or toxic is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(blocked).alias("blocked"))
    return urls.judge(pages, pages.join(labels, "page_id").select("url", "blocked"), URL_RULES)


@query()
def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query(sql="""
    WITH docs AS (SELECT row_number() OVER () AS n, doc_id, source, coalesce(text, '') AS text FROM documents),
    words AS (SELECT n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT n, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs)),
    windows AS (SELECT n, i, concat_ws(' ', word, lead(word) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS win, count(*) OVER (PARTITION BY n) - i AS later
        FROM words WINDOW o AS (PARTITION BY n ORDER BY i)),
    twice AS (SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY n, win) AS times FROM windows WHERE later >= 4) WHERE times > 1),
    repeated AS (SELECT n, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(5) AS r(k) GROUP BY n),
    lines AS (SELECT n, unnest(string_split(text, chr(10))) AS line FROM docs),
    dups AS (SELECT n, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY n),
    measured AS (
        SELECT d.doc_id, d.source, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_words,
            length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
            coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
        FROM docs d LEFT JOIN dups USING (n) LEFT JOIN repeated USING (n)
    ), based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured),
    hosts AS (SELECT source, count(*) AS docs, sum(base_failed::INT) AS failed FROM based WHERE source IS NOT NULL GROUP BY source),
    corpus AS (SELECT sum(failed) / sum(docs) AS mean FROM hosts),
    spread AS (SELECT mean, sum(docs * (failed / docs - mean) ** 2) / sum(docs) - count(*) * mean * (1 - mean) / sum(docs) AS between_hosts FROM hosts, corpus GROUP BY mean),
    prior AS (SELECT mean, CASE WHEN between_hosts > 0 THEN least(1e6, greatest(1e-3, mean * (1 - mean) / between_hosts - 1)) ELSE 1e6 END AS weight FROM spread),
    verdicts AS (SELECT source, (failed + weight * mean) / (docs + weight) <= 0.5 AS host_kept FROM hosts, prior)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(host_kept, true) AS kept FROM based LEFT JOIN verdicts USING (source)
""")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


@query(sql="""
    WITH docs AS (SELECT row_number() OVER () AS n, doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
    blocks AS (SELECT n, base, substr(hx, 2 * base + 1, 2798) AS piece FROM (SELECT n, hx, unnest(range(0, length(hx) // 2 - 399, 1000)) AS base FROM docs WHERE length(hx) >= 800)),
    windows AS (SELECT n, base + j AS i, md5_number(substr(piece, 2 * j + 1, 800)) AS h FROM (SELECT *, unnest(range(length(piece) // 2 - 399)) AS j FROM blocks)),
    again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
    starts AS (SELECT n, i, i > coalesce(lag(i) OVER (PARTITION BY n ORDER BY i), -1000) + 400 AS opens FROM windows SEMI JOIN again USING (h)),
    numbered AS (SELECT n, i, sum(opens::INT) OVER (PARTITION BY n ORDER BY i) AS span FROM starts),
    spans AS (SELECT n, span, min(i) AS a, max(i) + 400 AS b FROM numbered GROUP BY n, span),
    pieces AS (SELECT n, coalesce(lag(b) OVER (PARTITION BY n ORDER BY a), 0) AS a, a AS b FROM spans UNION ALL SELECT n, max(b), 1000000000 FROM spans GROUP BY n),
    kept AS (SELECT n, string_agg(substr(hx, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS hx FROM pieces JOIN docs USING (n) GROUP BY n),
    cut AS (SELECT n, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed FROM spans GROUP BY n)
    SELECT doc_id, length(d.hx) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.hx, d.hx))) AS kept_sha256
    FROM docs d LEFT JOIN kept k ON k.n = d.n LEFT JOIN cut c ON c.n = d.n
""")
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeated_bytes(table(spark, sf_dir, "documents"), width=400).drop("kept")


TERMS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


@query(sql=f"""
    WITH docs AS (SELECT row_number() OVER () AS d, doc_id, {TERMS_SQL} AS terms FROM documents),
    held AS (SELECT d, doc_id, terms, len(terms)::BIGINT AS n_terms FROM docs WHERE len(terms) > 0),
    corpus AS (SELECT count(*)::BIGINT AS n, sum(n_terms)::BIGINT AS l FROM held),
    sized AS (SELECT d, doc_id, 50 + (50 * n_terms * n) // l AS m FROM held, corpus),
    counts AS (SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(terms) AS term FROM held) GROUP BY d, term),
    weights AS (SELECT term, floor(1000 * ln((2 * n + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), corpus),
    asked AS (SELECT DISTINCT r, item_id, term FROM (SELECT row_number() OVER () AS r, item_id, unnest({TERMS_SQL}) AS term FROM benchmark)),
    scores AS (SELECT r, item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
        FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN sized USING (d) GROUP BY r, item_id, d, doc_id),
    places AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scores WHERE score > 0)
    SELECT item_id, place::INTEGER AS rank, doc_id, score FROM places WHERE place <= 50
""")
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


@query(sql="""
    WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) AS r(i)),
    runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
    long_runs AS (SELECT run, list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END) AS chars FROM runs WHERE length(run) >= 7),
    summed AS (SELECT run, xor(list_reduce(list_prepend(4294967295, flatten(chars)::BIGINT[]), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM long_runs, crc),
    damaged AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM summed),
    words AS (SELECT word, count(*) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
    less AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
    near AS (
        SELECT a.word, b.word AS other FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT a.word, b.word FROM words a JOIN less b ON a.word = b.rest
        UNION SELECT b.word, a.word FROM words a JOIN less b ON a.word = b.rest
    ), best AS (SELECT near.word, other, n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY n DESC, other) AS place FROM near JOIN words ON words.word = other),
    forms AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word AND place = 1),
    steps AS (SELECT word, form AS root FROM forms WHERE form IS NOT NULL UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL),
    roots AS (SELECT s.word, s.root FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NULL)
    SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN roots USING (word)
""")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))
