"""Documents: normalisation, chunking, token vectors, retrieval and rates, over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditframe.functions.retrieval import dense_top_k, hit_metrics, sparse_top_k
from auditframe.functions.scalars import percent_rates
from auditframe.functions.text import STOP_WORDS, chunk_pages, document_ids, pages_from_text, replace_documents, token_vectors
from auditframe.workload.registry import query, table

# White space as in functions.scalars.SPACE, spelled out for an engine without Unicode classes.
_SPACE = "[\\t\\n\\x0b\\f\\r \\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
_CLEAN = f"trim(regexp_replace(text, '{_SPACE}', ' ', 'g'))"
_NAMESPACE = "ba42ea1e9c5d4fde90b3809bb0119685"


def _uuid5_sql(digest):
    return (
        f"substr({digest}, 1, 8) || '-' || substr({digest}, 9, 4) || '-5' || substr({digest}, 14, 3) || '-' || "
        f"substr('89ab', (('0x' || substr({digest}, 17, 1))::INTEGER % 4) + 1, 1) || substr({digest}, 18, 3) || '-' || substr({digest}, 21, 12)"
    )


_IDS = f"""
    SELECT doc_id, text, {_uuid5_sql('d')} AS document_id
    FROM (SELECT *, sha1(unhex('{_NAMESPACE}') || encode(sha256(text))) AS d FROM documents)
"""


@query(f"SELECT doc_id, document_id FROM ({_IDS})")
def document_identities(spark, sf):
    return document_ids(table(spark, sf, "documents")).select("doc_id", "document_id")


@query(f"SELECT doc_id, {_CLEAN} AS text FROM documents WHERE length({_CLEAN}) > 0")
def normalized_pages(spark, sf):
    return pages_from_text(table(spark, sf, "documents")).select("doc_id", "text")


# The last blank of [start + 600, stop) is found from the reversed window.
_CHUNKS = f"""
    WITH RECURSIVE pages AS (SELECT DISTINCT document_id, {_CLEAN} AS text FROM ({_IDS}) WHERE length({_CLEAN}) > 0),
    step(document_id, start, stop) AS (
        SELECT document_id, 0::BIGINT, CASE WHEN length(text) <= 1200 THEN length(text)
            WHEN strpos(reverse(substr(text, 601, 600)), ' ') > 0 THEN 1200 - strpos(reverse(substr(text, 601, 600)), ' ') ELSE 1200 END
        FROM pages
        UNION ALL
        SELECT document_id, s, CASE WHEN length(text) <= s + 1200 THEN length(text)
            WHEN strpos(reverse(substr(text, s + 601, 600)), ' ') > 0
            THEN s + 1200 - strpos(reverse(substr(text, s + 601, 600)), ' ') ELSE s + 1200 END
        FROM (SELECT document_id, text, CASE WHEN substr(text, n + 1, 1) = ' ' THEN n + 1 ELSE n END AS s
              FROM (SELECT step.document_id, text, greatest(start + 1, stop - 200) AS n
                    FROM step JOIN pages ON step.document_id = pages.document_id WHERE stop < length(text)))
        WHERE s < length(text)),
    chunks AS (
        SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY start) - 1)::INTEGER AS chunk_index, piece AS text
        FROM (SELECT step.document_id, start, trim(substr(text, start + 1, stop - start)) AS piece
              FROM step JOIN pages ON step.document_id = pages.document_id) WHERE length(piece) > 0),
    named AS (
        SELECT *, sha1(unhex(replace(document_id, '-', '')) || encode('page:1:chunk:' || chunk_index || ':' || text)) AS d FROM chunks)
    SELECT document_id, 1::INTEGER AS page_number, chunk_index, text, {_uuid5_sql('d')} AS chunk_id FROM named
"""


@query(_CHUNKS)
def chunk_documents(spark, sf):
    """Equal texts have one document id, so a text is chunked once however often it occurs."""
    pages = pages_from_text(table(spark, sf, "documents")).dropDuplicates(["document_id"])
    return chunk_pages(pages)


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _vector_sql(source, key):
    return f"""
    SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS weight FROM (
        SELECT {key}, (('0x' || substr(sha256(w), 1, 8))::BIGINT % 2048)::INTEGER AS bucket, count(*) AS n
        FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM {source})
        WHERE w NOT IN ({_STOP}) GROUP BY ALL)
    """


@query(f"SELECT doc_id, bucket, round(weight, 9) AS weight FROM ({_vector_sql('documents', 'doc_id')})")
def token_vectors_documents(spark, sf):
    vectors = token_vectors(table(spark, sf, "documents"), "doc_id")
    entries = vectors.select("doc_id", F.explode(F.arrays_zip("buckets", "weights")).alias("e"))
    return entries.select("doc_id", F.col("e.buckets").alias("bucket"), F.round("e.weights", 9).alias("weight"))


_SPARSE = f"""
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
    FROM (SELECT item_id, doc_id, round(sum(d.weight * q.weight), 9) AS score
          FROM ({_vector_sql('documents', 'doc_id')}) d JOIN ({_vector_sql('benchmark', 'item_id')}) q ON d.bucket = q.bucket
          GROUP BY item_id, doc_id)
"""


@query(f"SELECT item_id, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM ({_SPARSE}) WHERE rank <= 5")
def cosine_topk_sparse(spark, sf):
    """The five documents most like every benchmark passage."""
    documents, passages = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    found = sparse_top_k(token_vectors(documents, "doc_id"), token_vectors(passages, "item_id"), "doc_id", "item_id", 5)
    return found.withColumn("score", F.round("score", 6)).select("item_id", "doc_id", "score", "rank")


@query(
    f"""
    SELECT item_id, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (
        SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
        FROM ({_SPARSE}) JOIN documents USING (doc_id) WHERE lang = 'en') WHERE rank <= 3
    """
)
def cosine_topk_selected_documents(spark, sf):
    """The same search bound to a selection of documents."""
    documents, passages = table(spark, sf, "documents").filter("lang = 'en'"), table(spark, sf, "benchmark")
    found = sparse_top_k(token_vectors(documents, "doc_id"), token_vectors(passages, "item_id"), "doc_id", "item_id", 3)
    return found.withColumn("score", F.round("score", 6)).select("item_id", "doc_id", "score", "rank")


@query(
    f"""
    SELECT doc_id, item_id, score, rank::INTEGER AS rank FROM (
        SELECT doc_id, item_id, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS rank
        FROM (SELECT d.doc_id, b.item_id, coalesce(s.score, 0.0) AS score
              FROM (SELECT DISTINCT doc_id FROM documents) d CROSS JOIN (SELECT DISTINCT item_id FROM benchmark) b
              LEFT JOIN ({_SPARSE}) s ON s.doc_id = d.doc_id AND s.item_id = b.item_id))
    WHERE rank <= 3
    """
)
def cosine_topk_every_document(spark, sf):
    """The three passages most like every document: a query set that grows with the table."""
    documents, passages = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    found = sparse_top_k(token_vectors(passages, "item_id"), token_vectors(documents, "doc_id"), "item_id", "doc_id", 3)
    return found.select("doc_id", "item_id", "score", "rank")


_CENTROIDS = """
    SELECT label AS query_id, list(v ORDER BY i) AS embedding
    FROM (SELECT label, i, avg(x::DOUBLE) AS v
          FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i)
    GROUP BY label
"""


@query(
    f"""
    SELECT query_id, vec_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (
        SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
        FROM (SELECT query_id, vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], c.embedding), 9) AS score
              FROM embeddings e, ({_CENTROIDS}) c)) WHERE rank <= 10
    """
)
def cosine_topk_dense(spark, sf):
    """The ten vectors closest to every label's mean vector."""
    vectors = table(spark, sf, "embeddings")
    means = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("v"))
    # One entry per dimension, so the list is bounded by the vector width.
    centroids = means.groupBy(F.col("label").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("e"))
    centroids = centroids.select("query_id", F.transform("e", lambda p: p["v"]).alias("embedding"))
    items = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    found = dense_top_k(items, centroids, "vec_id", "query_id", "embedding", 10)
    return found.withColumn("score", F.round("score", 6)).select("query_id", "vec_id", "score", "rank")


_HITS_SOURCE = "(SELECT 'doc:' || doc_id AS id, text FROM documents UNION ALL SELECT 'passage:' || item_id, text FROM benchmark)"


@query(
    f"""
    WITH ranked AS (
        SELECT item_id, id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank
        FROM (SELECT item_id, id, round(sum(d.weight * q.weight), 9) AS score
              FROM ({_vector_sql(_HITS_SOURCE, 'id')}) d JOIN ({_vector_sql('benchmark', 'item_id')}) q ON d.bucket = q.bucket
              GROUP BY item_id, id)),
    placed AS (SELECT b.item_id, min(rank) AS rank FROM benchmark b LEFT JOIN ranked r
               ON b.item_id = r.item_id AND r.id = 'passage:' || b.item_id AND rank <= 2 GROUP BY b.item_id)
    SELECT count(*) AS query_count, avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END) AS hit_at_k,
           avg(coalesce(1.0 / rank, 0.0)) AS mean_reciprocal_rank FROM placed
    """
)
def retrieval_hit_and_mrr(spark, sf):
    """Retrieving every benchmark passage from among all documents and passages."""
    passages = table(spark, sf, "benchmark")
    corpus = table(spark, sf, "documents").select(F.concat(F.lit("doc:"), "doc_id").alias("id"), "text").unionByName(
        passages.select(F.concat(F.lit("passage:"), "item_id").alias("id"), "text")
    )
    ranked = sparse_top_k(token_vectors(corpus, "id"), token_vectors(passages, "item_id"), "id", "item_id", 2)
    expected = passages.select("item_id", F.concat(F.lit("passage:"), "item_id").alias("id"))
    return hit_metrics(ranked, expected, "item_id", "id")


@query(
    """
    SELECT doc_id, len(r)::INTEGER AS rates, round(list_max(r), 6) AS highest
    FROM (SELECT doc_id, [x::DOUBLE / 100 FOR x IN regexp_extract_all(text, '(?:^|[^\\d.])(\\d+(?:\\.\\d+)?)\\s*%', 1)] AS r FROM documents)
    WHERE len(r) > 0
    """
)
def percentage_rates(spark, sf):
    rates = table(spark, sf, "documents").select("doc_id", percent_rates(F.col("text")).alias("r"))
    return rates.filter(F.size("r") > 0).select("doc_id", F.size("r").alias("rates"), F.round(F.array_max("r"), 6).alias("highest"))


@query(
    """
    SELECT lang, count(*) AS texts FROM (
        SELECT lang, text FROM documents WHERE lang NOT IN (SELECT DISTINCT lang FROM documents WHERE source = 'src1')
        UNION ALL SELECT lang, text FROM documents WHERE source = 'src1') GROUP BY lang
    """
)
def reingest_replaces_group(spark, sf):
    """Re-ingestion: languages that arrive again from one source replace what was stored."""
    documents = table(spark, sf, "documents").select("lang", "source", "text")
    renewed = replace_documents(documents.select("lang", "text"), documents.filter("source = 'src1'").select("lang", "text"), "lang")
    return renewed.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"))
