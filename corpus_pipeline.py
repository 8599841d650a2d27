"""The corpus pipeline: quality rules, line dedup, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the result of each is written
as Parquet and read again as the next one's documents. All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.llm import decontam, linededup, neardup, quality, spm
from strandspark.llm.common import cut, shared_dir, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; n_chars follows, and a document that loses all its lines goes."""
    return linededup.dedup_lines(docs, length="n_chars", drop_emptied=True)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates: five words, similarity 0.8."""
    return neardup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with its token ids, their number, and whether decoding gives the text back."""
    return spm.encode_documents(docs, spm.model_of(spark))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", neardup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("sentencepiece encoding", token_stage),
]

#: SQL expresses neither the near-duplicate components nor the tokens; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), folder, f"stage-{k}")
    return docs
