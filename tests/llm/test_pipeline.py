"""The pipeline's stages, one by one and together."""

import pytest

import corpus_pipeline
from strandframe.llm.queries import QUERIES


def test_stages(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, before = docs.columns, docs.count()
    names = [k for k, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash", "mixing", "sentencepiece"]
    sizes = []
    for k, stage in corpus_pipeline.STAGES:
        stage(spark, docs, d).write.parquet(str(tmp_path / k))
        docs = spark.read.parquet(str(tmp_path / k))
        sizes.append(docs.count())
        assert k == "sentencepiece" or docs.columns == columns
    assert before >= sizes[0] == sizes[1] >= sizes[2] and sizes[3] == sizes[4] > 0
    assert docs.filter("not lossless").count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_give_a_row_each(spark, sf, name):
    table = "embeddings" if name.startswith("op8") else "documents"
    assert QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{table}.parquet").count()
