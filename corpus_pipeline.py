"""The corpus pipeline: five stages over ``documents``, each written and read again.

Every stage works on all that the one before it kept. All but the last return the columns of
``documents``; the last returns each document's token counts and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillwise.llm import bpe, decontamination, quality, repeats, setjoin
from tillwise.llm.frames import table
from tillwise.llm.queries import tokenizer_path
from tillwise.staging import Stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    return setjoin.keep_one_of_each(docs)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that occur more than once are cut out of the texts."""
    return repeats.without_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids and the text decoded from them, as digests."""
    return bpe.add_token_digests(docs, tokenizer_path(), keep=["doc_id"]).select("doc_id", "tokens.*")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeated_passage_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: SQL cannot express the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and read by the next."""
    stage = Stage(spark)
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage.write(function(spark, docs, sf_dir), name)
    return stage.write(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
