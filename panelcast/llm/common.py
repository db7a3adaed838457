"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.session import cut_lineage, ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def held_out(doc_id: Column) -> Column:
    """True for the rows whose labels no model may learn from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def numbered(df: DataFrame, key: str | list[str], name: str, *order: Column) -> DataFrame:
    """Adds ``name``: 1, 2, … among rows of equal ``key``, so that repeated rows have names of their own."""
    from pyspark.sql import Window

    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))


__all__ = ["WORD", "cut_lineage", "ensure_checkpoint_dir", "fresh_folder", "held_out", "numbered", "table"]
