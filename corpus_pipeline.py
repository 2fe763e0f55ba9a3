"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing, sharding.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns what it keeps, with the columns of documents (the last: with the shard
of each row). A driver that runs them writes each result as Parquet and reads
it again as the next one's docs; run() does so in the session's shared
checkpoint folder and removes each result when the one after it is written.

Defined results: columns beyond those of documents are kept by all stages but
the last; null and empty texts are clean, near duplicates of each other (one
stays) and taken 0 times by the mix; rows without an id are kept or dropped by
their text; an empty table gives an empty result.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.files import Files
from ledgerfold.llm import decontaminate, mixing, sharding, simhash, toxicity
from ledgerfold.llm.common import table


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts toxic go."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("predicted") == 0).select(*docs.columns)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest id."""
    return simhash.keep_one(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a whole benchmark window go, however long they are, and those of which a twentieth of the words or more are benchmark words."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    return mixing.take(docs)


def _sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of each row, within the byte limit."""
    return sharding.shard(docs).select("doc_id", "source", "n_bytes", "shard", "depth", "shard_bytes")


STAGES = [
    ("toxicity", _toxicity),
    ("simhash_near_dedup", _near_duplicates),
    ("benchmark_decontamination", _decontamination),
    ("mixing", _mixing),
    ("sharding", _sharding),
]

#: A trained classifier, SimHash and Newton steps have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='ledgerfold-pipeline-')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}_{name}")
            docs = spark.read.parquet(f"{folder}/{k}_{name}")
            if k:
                Files(spark).remove(f"{folder}/{k - 1}_{STAGES[k - 1][0]}")
    return docs
