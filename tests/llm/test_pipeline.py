import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenframe.llm import bpe, nbsvm
from lumenframe.llm.queries import LLM_QUERIES


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in LLM_QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "repeated strings", "mixture", "token ids"]


@pytest.fixture()
def folder_of(spark, tmp_path_factory, awkward):
    root = str(tmp_path_factory.mktemp("corpus"))
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 72, 3)] + [(30, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_pipeline_keeps_clean_text(spark, folder_of):
    """Copies, near copies and shared passages go; what is left decodes to what the stages kept."""
    docs = spark.read.parquet(f"{folder_of}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, folder_of)
        assert docs.columns == before.columns, name
        docs = spark.createDataFrame(docs.collect(), before.schema)
        if name == "near-duplicates":
            ids = {r.doc_id for r in docs.collect()}
            assert {33, 42} <= ids and not {36, 39} & ids
        if name == "repeated strings":
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in docs.collect())
    ranks = corpus_pipeline.public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = {r.doc_id: bytes(r.decoded) for r in bpe.decode(corpus_pipeline.token_ids(spark, docs, folder_of), ranks).collect()}
    assert out == {r.doc_id: (r.text or "").encode() for r in docs.collect()}


def test_held_out_rows():
    import zlib

    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = spark.range(50).select("id", nbsvm.is_held_out(F.col("id")).alias("h")).collect()
    assert [r.h for r in rows] == [zlib.crc32(str(r.id).encode()) % 4 == 2 for r in rows] and np.mean([r.h for r in rows]) > 0
