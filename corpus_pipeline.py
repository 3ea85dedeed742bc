"""A corpus pipeline over ``documents``: toxic texts go, one document of each group of copies stays, sources are mixed to their targets, and the mix is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the
rows are written as Parquet in the shared folder and read again. Stages read
their input by column name; rows with nulls, repeated rows and empty tables have
the results that the operators' modules define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skilltide.llm import minhash, mixing, packing, toxicity
from skilltide.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below a half."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group."""
    return minhash.without_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket and batch of every document of the mix."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]

#: Character models, decision lists and seeded hashes have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
