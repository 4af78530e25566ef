import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
import oracle
from corpus_fixtures import documents, empty, rows
from tidemark.llm import byte_bpe, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", [n for n in queries.REGISTRY])
def test_query(spark, con, name):
    result = oracle.compare(spark, con, name, queries.REGISTRY[name], queries.ORACLES.get(name), SF)
    assert not result.startswith("FAIL"), result


def test_all_are_registered():
    assert {int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op")} == set(range(1, 11)) and "pipeline" in entry.queries()


def test_stages_one_by_one(spark):
    """Each stage keeps the columns and only drops rows; the last one encodes what is left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        assert kept.exceptAll(docs).count() == 0 and kept.count() <= docs.count(), name
        docs = spark.createDataFrame(kept.collect(), docs.schema)
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    back = {i: t for t, i in ranks.items()}
    done = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in done} == set(texts) and all(r.round_trip for r in done)
    assert all(b"".join(back[i] for i in r.ids).decode() == texts[r.doc_id] for r in done)
    assert corpus_pipeline.run(spark, SF).count() == len(done)


def test_stages_on_odd_documents(spark):
    odd = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() <= odd.count(), name
        assert stage(spark, empty(spark), SF).count() == 0, name


def test_copies_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    once = dict(corpus_pipeline.STAGES)["exact dedup"](spark, docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10**6)), "")
    assert once.where("doc_id >= 1000000").count() == 0 and once.count() == docs.select("text").distinct().count()
    assert rows(once.select("doc_id")) == rows(docs.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id"))
