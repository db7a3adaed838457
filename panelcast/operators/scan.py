"""Blocked scans along a series: running sums and nearest non-null neighbours.

Positions are cut into blocks of ``block`` rows. Inside a block an ordinary window does the
work; what crosses block borders (the running total, the last / next non-null value) comes
from a per-block summary table (one row per block) scanned with a window over blocks. No task
holds more than one block of a series, however long the series is. Series are told apart by one
text key that is never NULL, so rows of a NULL key stay and all steps share one partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.scalar import joined_key

__all__ = ["SCAN_BLOCK", "prefix_sum", "neighbours"]

SCAN_BLOCK = 65536


def _blocked(df: DataFrame, keys: list[str], pos: str, block: int) -> DataFrame:
    """Adds the series' key and the block of each row; rows without a position are a block of their own."""
    return df.withColumn("_sk", joined_key(keys)).withColumn("_sb", F.coalesce(F.floor(F.col(pos) / block), F.lit(-1)))


def prefix_sum(df: DataFrame, keys: Sequence[str], pos: str, col: str, out: str, block: int = SCAN_BLOCK) -> DataFrame:
    """out = sum of ``col`` over rows with position <= pos (NULLs count as 0)."""
    keys = list(keys)
    d = _blocked(df, keys, pos, block)
    local = F.sum(F.coalesce(F.col(col), F.lit(0.0))).over(
        Window.partitionBy("_sk", "_sb").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    totals = d.groupBy("_sk", "_sb").agg(F.sum(F.coalesce(F.col(col), F.lit(0.0))).alias("_bt"))
    carry = totals.select("_sk", "_sb", F.coalesce(F.sum("_bt").over(
        Window.partitionBy("_sk").orderBy("_sb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_carry"))
    return (d.withColumn("_loc", local).join(carry, ["_sk", "_sb"])
            .withColumn(out, F.col("_carry") + F.col("_loc")).drop("_sk", "_sb", "_loc", "_carry"))


def neighbours(df: DataFrame, keys: Sequence[str], pos: str, cols: Sequence[str] | str,
               block: int = SCAN_BLOCK) -> DataFrame:
    """For every column c adds c__pv/c__pi (last non-null value and its position at or before
    the row) and c__nv/c__ni (first non-null value and position at or after the row), all
    columns in one pass: one blocked window, one per-block summary, one join."""
    keys = list(keys)
    cols = [cols] if isinstance(cols, str) else list(cols)
    d = _blocked(df, keys, pos, block)
    wb = Window.partitionBy("_sk", "_sb").orderBy(pos)
    prev_w = wb.rowsBetween(Window.unboundedPreceding, 0)
    next_w = wb.rowsBetween(0, Window.unboundedFollowing)
    local, summary, carry, final = [], [], [], []
    wo = Window.partitionBy("_sk").orderBy("_sb")
    before = wo.rowsBetween(Window.unboundedPreceding, -1)
    after = wo.rowsBetween(1, Window.unboundedFollowing)
    for c in cols:
        v = F.col(c)
        vpos = F.when(v.isNotNull(), F.col(pos))
        local += [F.last(v, True).over(prev_w).alias(f"{c}__lpv"), F.last(vpos, True).over(prev_w).alias(f"{c}__lpi"),
                  F.first(v, True).over(next_w).alias(f"{c}__lnv"), F.first(vpos, True).over(next_w).alias(f"{c}__lni")]
        summary += [F.max_by(v, vpos).alias(f"{c}__blv"), F.max(vpos).alias(f"{c}__bli"),
                    F.min_by(v, vpos).alias(f"{c}__bfv"), F.min(vpos).alias(f"{c}__bfi")]
        carry += [F.last(f"{c}__blv", True).over(before).alias(f"{c}__cpv"),
                  F.last(f"{c}__bli", True).over(before).alias(f"{c}__cpi"),
                  F.first(f"{c}__bfv", True).over(after).alias(f"{c}__cnv"),
                  F.first(f"{c}__bfi", True).over(after).alias(f"{c}__cni")]
        final += [F.when(F.col(f"{c}__lpi").isNotNull(), F.col(f"{c}__lpv")).otherwise(F.col(f"{c}__cpv")).alias(f"{c}__pv"),
                  F.coalesce(f"{c}__lpi", f"{c}__cpi").alias(f"{c}__pi"),
                  F.when(F.col(f"{c}__lni").isNotNull(), F.col(f"{c}__lnv")).otherwise(F.col(f"{c}__cnv")).alias(f"{c}__nv"),
                  F.coalesce(f"{c}__lni", f"{c}__cni").alias(f"{c}__ni")]
    d = d.select("*", *local)
    summ = d.groupBy("_sk", "_sb").agg(*summary)
    carried = summ.select("_sk", "_sb", *carry)
    j = d.join(carried, ["_sk", "_sb"])
    return j.select(*df.columns, *final)
