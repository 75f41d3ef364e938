"""A corpus pipeline of five stages over ``documents``; each is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontamination, mixing, sharding, simhash, toxicity
from quern.llm.common import new_path, read


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose probability of any severity is at least 0.4."""
    return toxicity.reject_toxic(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group at similarity 0.8 of five-word shingles."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of any benchmark item."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents, repeated as the targets ask, in training order."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A uniform shuffle into 16 shards: the documents with shard and slot."""
    return sharding.shard_rows(docs, 16)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

ORACLE_SQL = None  # the classifier and the shuffle can't be put in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        schema, path = out.schema, new_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(schema).parquet(path)
    return docs
