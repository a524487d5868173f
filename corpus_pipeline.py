"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet in the shared folder and read again as the next stage's docs.  All
but the last return the columns of ``documents``:

quality   documents that the classifier scores below its threshold go
near      one document stays of each group of near copies (five-word shingles, similarity 0.8)
leaks     documents that contain a benchmark item go
mix       sources are repeated or thinned to their target weights
shards    each row gets the shard that its text falls in
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from argentic.llm import decontamination, mixing, quality_classifier, sharding, simhash
from argentic.llm._common import Scratch, load


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier predicts to be good; it is learned from the labels beside ``docs``.

    Null and empty texts are scored like any other, repeated rows alike.
    """
    scored = quality_classifier.classify(docs, load(spark, sf_dir, "labels"))
    return scored.filter("predicted = 1").select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, that of the least doc_id; null and blank texts are one group, and a null doc_id stays only in a group without others."""
    return simhash.keep_one(docs).select(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text contains no benchmark item; null and empty texts contain none, and rows of one id are told apart by text."""
    return decontamination.clean_documents(docs, load(spark, sf_dir, "benchmark")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's rate asks for; a null source is a source, texts without words weigh nothing."""
    return mixing.mix_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with the shard of their text; repeated rows share it, and null texts are one group."""
    return sharding.shard_rows(docs)


STAGES = [("quality", quality), ("near", near), ("leaks", leaks), ("mix", mix), ("shards", shards)]

#: The classifier is learned and near copies are chained, which SQL can't express; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
