"""A corpus pipeline: documents in, packed training windows out.

STAGES are applied in order, each to what the one before has kept. Every stage but the last returns the columns of
``documents``; ``n_chars`` follows a text that a stage has changed. The SQL side can't express the classifier and the
tokenizer, so there is none; the tests hold every stage against plain Python on planted texts (the classifier's training
and scores against plain loops).

Defined cases: a null or empty text has no words and goes with the quality rules; nulls in other columns stay as they are;
rows that repeat id and text stay once after the near-copy stage, rows of one id with different texts are documents of their own
(ordered by a hash of the text); ties go to the smaller id; an empty table gives no rows; further columns, whatever their names,
stay up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketwise.llm.graph import saved
from bucketwise.llm.minhash import without_near_copies
from bucketwise.llm.pack import pack_documents
from bucketwise.llm.passages import without_repeats
from bucketwise.llm.quality import with_rules_applied
from bucketwise.llm.toxicity import PASS_SCORE, with_scores

PASSAGE_WORDS = 50


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without lines that are too frequent in their source."""
    return _counted(with_rules_applied(docs))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below the limit; labels teach the model only for ids that are still there."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    column = "toxicity_" + "_".join(docs.columns)  # clashes with no column
    return with_scores(docs, labels, column).where(F.col(column) < PASS_SCORE).drop(column)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near copies (five words, similarity of 0.8)."""
    return without_near_copies(docs, width=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words or more that stand earlier already."""
    return _counted(without_repeats(docs, window=PASSAGE_WORDS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 tokens."""
    return pack_documents(docs)


STAGES = [("quality_rules", quality), ("toxicity", toxicity), ("minhash_near_dedup", near_copies),
          ("substring_dedup", passages), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
