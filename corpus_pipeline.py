"""From documents to packed training sequences: toxicity, line dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the columns of documents (the
last one: a row per packed token sequence). STAGES are written as Parquet and read again one by one; run() does so in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch
from gridloom.llm.decontamination import decontaminate
from gridloom.llm.line_dedup import dedup_lines
from gridloom.llm.ngram_join import ngram_dedup
from gridloom.llm.packing import pack_documents
from gridloom.llm.toxicity import drop_toxic, train

#: The vocabulary of the sequences.
TOKENIZER = "word_bpe_49k.json"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return drop_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of near-equal lines stays; documents without any line left go; n_chars follows the text."""
    out = dedup_lines(docs, fold=True)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near duplicates stays."""
    return ngram_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per bin of pieces of documents."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("decontamination", decontamination), ("packing", packing)]

#: SQL can't express the first stage's training nor packing: tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        scratch.drop(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
