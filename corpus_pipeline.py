"""Corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage is written as Parquet to the shared folder and read again as the next
one's input. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexus.llm import classifier, decontaminate, jaccard, packing, suffixdedup
from plexus.llm.common import keyed, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if the classifier is this sure that it is of low quality.
REJECT_BELOW = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (op 6) doesn't reject.

    Rows are judged one by one, whatever their ids; null and empty texts have the
    score of the bias alone.
    """
    weights = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classifier.score(docs.select(*COLUMNS), weights).where(F.col("score") >= REJECT_BELOW).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each component of near copies.

    Near copies have a Jaccard similarity of 0.8 or more over their five-word
    shingles: SimHash links (op 1) verified on the whole sets, and the links that
    fingerprints don't show. Rows whose doc_ids are null or repeated are told apart
    by a key of their own, nulls first; null and empty texts are copies of each
    other; an empty table stays empty.
    """
    docs = keyed(docs.select(*COLUMNS), "__key")
    gone = jaccard.later_copies(docs.select(F.col("__key").alias("key"), "text")).withColumnRenamed("key", "__key")
    return docs.join(gone, "__key", "left_anti").select(*COLUMNS)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages (op 7); one that is all repeats goes.

    Null and empty texts hold no passage and stay, as the empty text; rows with
    null or repeated ids are documents of their own, in the order op 7 states.
    """
    cut = suffixdedup.remove_repeats(docs, carry=("lang", "source"))
    left = cut.where("n_removed = 0 or trim(kept) <> ''").withColumnRenamed("kept", "text")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (op 3), each row judged by its own text."""
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids (op 9); every row is packed, whatever its id."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("suffix-array dedup", repeats_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL can't express the trained classifier, the tokenizer or the alignment; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
