"""A corpus pipeline: five stages over ``documents``, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.llm.bpe import bpe
from pairloom.llm.decontam import contamination
from pairloom.llm.minhash import near_duplicates
from pairloom.llm.pii import redacted
from pairloom.llm.queries import tokenizer_path
from pairloom.llm.toxicity import score, train
from pairloom.storage import materialise, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go. The model is fitted on the labelled documents that the stage is given."""
    found = score(docs, train(docs, table(spark, sf_dir, "labels"))).where("toxic").select("doc_id").distinct()
    return docs.join(materialise(found, "toxic"), "doc_id", "left_anti").select(docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the document with the smallest id stays."""
    gone = near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    found = contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(materialise(found, "contaminated"), "doc_id", "left_anti").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kinds; ``n_chars`` follows the text. Null texts stay null."""
    done = redacted(docs)
    return done.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the hashes of ids and decoded text."""
    return bpe(docs, tokenizer_path(), with_ids=True)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicate), ("decontamination", decontamination), ("pii", personal_data), ("bpe", encoding)]

#: No SQL can express the fitted stages; the pipeline is tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
