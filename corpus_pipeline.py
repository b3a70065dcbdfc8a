"""The corpus pipeline: stages that each take the documents that their predecessor kept.

A stage takes (spark, docs, sf_dir); all but the last return the columns of documents. Every stage works on whole texts and
all rows; what it does with null and empty texts is the operator's own defined result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, line_dedup, near_dedup, toxicity
from quarry.llm.common import fresh, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose toxicity score is 0.5 or more. The model learns from these documents' labels, held-out rows aside."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), held_out=toxicity.held_out)
    name = fresh(docs, "score")
    return toxicity.score(docs, model).where(F.col(name) < 0.5).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later copies of repeated line runs. A document of which nothing is left was a copy line by line and goes."""
    gone, whole = fresh(docs, "n_deleted"), fresh(docs, "whole_copy")
    out = line_dedup.dedup(docs).where(~F.coalesce(whole, F.lit(False)))
    kind = dict(docs.dtypes).get("n_chars")
    n_chars = {"n_chars": F.when(F.col(gone) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))} if kind else {}
    return out.withColumns(n_chars).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first, of each class of near duplicates."""
    return near_dedup.dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a window of a benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, with digests of the ids and of what they decode to."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digests(docs, ranks, public_tokenizers.PATTERN, ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", bpe_stage),
]

#: SQL cannot express the stages: tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
