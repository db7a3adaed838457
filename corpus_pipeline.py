"""Corpus pipeline: documents -> clean, deduplicated, redacted, mixed and packed sequences.

Every stage takes the documents its predecessor kept and reads them back from Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelcast.llm import stages
from panelcast.llm.common import fresh_folder

STAGES = [
    ("toxicity", stages.toxicity),
    ("simhash_near_dedup", stages.simhash),
    ("secret_scan", stages.secrets),
    ("source_mixing", stages.mixing),
    ("best_fit_packing", stages.packing),
]

ORACLE_SQL = None  # a trained score, 64-bit fingerprints and random rounding have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents; each result is written and read back before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_folder(spark, "pipeline")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
