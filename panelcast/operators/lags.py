"""Lag embedding, deterministic terms and positions within a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.scalar import joined_key
from panelcast.spec import VarSpec

__all__ = ["lag_name", "lag_embed", "positional_index", "design_columns"]

LAG_BLOCK = 8192


def lag_name(var: str, j: int) -> str:
    return f"{var}__lag{j}"


def positional_index(df: DataFrame, series_col: str, order_cols: Sequence[str], time_col: str = "t",
                     bucket: int | None = None, buckets: int | None = None) -> DataFrame:
    """0..T-1 per series in ``order_cols`` order (must be unique within a series; NULL comes first).

    Distributed like zipWithIndex but deterministic in the data: counting selection cuts each series into ordered
    ranges of at most ``bucket`` rows (``buckets``: about so many ranges in all), ties by the next order column, text by
    prefixes; rows are numbered inside their range and each range is offset by the rows of the ranges before it. The ranges
    are checkpointed: a lost executor recomputes the same ones.
    """
    from panelcast.operators.selection import ordered_ranges, with_offsets
    order_cols = list(order_cols)
    columns = df.columns
    if buckets:
        bucket = max(1, -(-df.count() // buckets))
    rows, ranges = ordered_ranges(df.withColumn("_sk", joined_key([series_col])), "_sk", order_cols, bucket)
    own = ["_sk", "_path"]
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*own).orderBy(*order_cols)) - 1)
    if ranges is not None:
        rows = rows.join(with_offsets(ranges, "_sk").drop("_n"), own).withColumn("_place", F.col("_place") + F.col("_off"))
    place = F.col("_place").cast("bigint").alias(time_col)
    return rows.select(*[F.col(f"`{c}`") for c in columns if c != time_col], place)


def lag_embed(panel: DataFrame, variables: Sequence[str], lags: int, series_col: str = "series_id",
              time_col: str = "t", block: int = LAG_BLOCK, keep_presample: bool = False) -> DataFrame:
    """Add ``<var>__lag<j>`` = y_{t-j} for j = 1..lags.

    The window partition is (series, t // block) rather than the whole series: the last
    ``lags`` rows of each block are duplicated into the next block as a halo, so one very
    long series spreads over many tasks at a cost of lags/block extra rows. Rows t < lags
    have no full lag vector; they are dropped unless ``keep_presample``.
    """
    block = max(block, lags + 1)
    t = F.col(time_col)
    cols = [series_col, time_col, *variables]
    blk = F.floor(t / block)
    # one scan: rows in the last ``lags`` positions of a block are emitted twice (own block + halo)
    blocks = F.when(F.pmod(t, F.lit(block)) >= block - lags, F.array(blk, blk + 1)).otherwise(F.array(blk))
    u = panel.select(*cols, F.explode(blocks).alias("_blk")).withColumn("_halo", F.col("_blk") != blk)
    w = Window.partitionBy(series_col, "_blk").orderBy(time_col)
    lagged = u.select(
        *cols, "_halo",
        *[F.lag(v, j).over(w).alias(lag_name(v, j)) for j in range(1, lags + 1) for v in variables])
    keep = ~F.col("_halo")
    if not keep_presample:
        keep = keep & (t >= lags)
    return lagged.filter(keep).drop("_halo")


def design_columns(spec: VarSpec, variables: Sequence[str], time_col: str = "t") -> list:
    """Regressor expressions in coefficient order: const, trend (t+1, 1-based), lag blocks."""
    out = []
    if spec.has_const:
        out.append(F.lit(1.0))
    if spec.has_trend:
        out.append((F.col(time_col) + 1).cast("double"))
    for j in range(1, spec.lags + 1):
        out.extend(F.col(lag_name(v, j)) for v in variables)
    return out
