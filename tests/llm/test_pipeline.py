"""The pipeline's stages one after the other, and the registered queries with their SQL."""

import os

import pytest
from oracle import compare, connect

import corpus_pipeline
from auditframe.llm import spans
from auditframe.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not available")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(SF), name, QUERIES[name], SQL[name], SF) is None


def test_stages_take_effect(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(90001, None, "en", "src0", None), (90002, "12 34 !!", "en", "src0", 8), (90003, "The same text once more.", "en", None, 24), (90004, "the  same text ONCE more.", "en", None, 25)], source.schema)
    docs = source.unionByName(odd)
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if number < 4:
            assert out.columns == source.columns, name
        out.write.parquet(f"{tmp_path}/{number}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{number}")
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if number == 0:
            assert not ids & {90001, 90002} and {90003, 90004} <= ids
        if number == 1:
            assert 90003 in ids and 90004 not in ids and len(ids) == docs.count()
        if number == 2:
            assert spans.without_repeats(docs).where("n_removed > 0").count() < spans.without_repeats(before).where("n_removed > 0").count()
            assert docs.where("n_chars <> length(text)").count() == before.where("n_chars <> length(text)").count()
        if number == 4:
            assert docs.where("size(token_ids) = 0").count() == 0 and docs.count() == before.count()
    assert corpus_pipeline.run(spark, SF).count() > 0
