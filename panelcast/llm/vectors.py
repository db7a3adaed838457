"""Vector columns as numpy matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import cut_lineage


def usable(vec: Column) -> Column:
    """True for vectors that are not null or empty and hold finite components only."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, finite), F.lit(False))


def keyed(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(node, id, vec): ``node`` numbers the rows, repeated ones too; checkpointed, so it stays as it is.
    Vectors that are not usable become null. Single-precision vectors travel as they are; whoever computes
    with them widens them first."""
    vec = F.col(vec_col)
    if dict(rows.dtypes)[vec_col] != "array<float>":
        vec = vec.cast("array<double>")
    rows = rows.select(F.monotonically_increasing_id().alias("node"), F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    return cut_lineage(rows.withColumn("vec", F.when(usable(F.col("vec")), F.col("vec"))))


def stacked(vectors) -> np.ndarray:
    """A matrix of vectors of one length."""
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)
