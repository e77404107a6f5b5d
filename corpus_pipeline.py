"""The corpus pipeline: language, quality, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is
written as Parquet in the shared folder and read again as the next stage's
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from churnlens.llm.common import stage, table
from churnlens.llm.langid import language_stage
from churnlens.llm.packing import packing_stage
from churnlens.llm.quality import quality_stage
from churnlens.llm.simhash import simhash_stage

STAGES = [
    ("language_id", language_stage),
    ("quality", quality_stage),
    ("near_dedup", simhash_stage),
    ("packing", packing_stage),
]

#: Trained models and tokenizers cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
