"""A corpus pipeline over ``documents``: rate, deduplicate, decontaminate, mix, shard.

Each stage takes what its predecessor kept, written as Parquet and read again, and calls one operator of
``tidemark.llm``. All but the last return the columns of ``documents``.

Null texts are empty, null sources and languages are values of their own, a null id is an id like others.
Rows repeated in all columns are documents of their own until near-duplicates go: a group keeps one row, of
its smallest id. An empty table passes every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, mixing, quality, shards, simhash
from tidemark.llm.common import blank_words, new_folder, table
from tidemark.llm.queries import SHARDS, rated

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the highest grade is at least one half."""
    return quality.select_documents(docs, quality.train(docs, rated(spark, sf_dir)))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, those of one output shard together in random order."""
    return mixing.shuffled(mixing.mix(docs, F.size(blank_words(F.col("text")))))


def assign(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its place there."""
    assigned = shards.assign_shards(docs, "doc_id", SHARDS)
    return shards.number_in_shard(assigned, "shard", ["doc_id", "n_chars"])


STAGES = [
    ("quality classifier", keep_good),
    ("simhash near-dedup", keep_one_of_each),
    ("benchmark decontamination", keep_clean),
    ("mixing sources to target weights", mix_sources),
    ("sharding", assign),
]

#: The classifier, the hash draws and the connected components are not SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
