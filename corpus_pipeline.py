"""A training corpus in five stages, each an operator of labelwright.llm applied to all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet in the shared
folder and reads them as the next one's docs. All but the last return the columns of documents, whatever these are called:
columns of other names go along.

In every stage an empty table gives an empty table; a text of any length is handled whole, as its operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.llm import decontam, lsh_forest, mixing, pu_quality, sharding
from labelwright.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier takes for good: those scored 0.5 or more, ties included.

    A null or empty text is scored like any other. Repeated rows stay or go together; a null doc_id is scored, never learnt from.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return pu_quality.keep_good(docs, pu_quality.train(docs, labels, pu_quality.held_out_third()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the least doc_id, a tie going to the least hash of the text.

    Texts without a word (null, empty, white space) all stay. Of repeated rows one stays. A null doc_id is later than any other.
    """
    return lsh_forest.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items. A null or empty text holds none and stays; repeated rows stay or go together."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each copy, a cut copy where at least half is taken.

    Texts without a word have size 0 and are never taken. A null source is a source. Repeated rows share one decision.
    """
    return mixing.take_copies(docs, mixing.curriculum)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot, and the size and checksum of its text (a null text: 8 bytes, null).

    Repeated rows get slots of their own; equal texts share a shard unless they outgrow it.
    """
    return sharding.place(docs, 24)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: SQL expresses neither the classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
