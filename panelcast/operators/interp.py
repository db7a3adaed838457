"""Gap filling along each series: linear by position, forward/backward fill, zero fill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.scalar import joined_key
from panelcast.operators.lags import positional_index
from panelcast.operators.scan import SCAN_BLOCK, neighbours
from panelcast.session import cut_lineage

__all__ = ["interpolate_linear", "ffill_bfill", "zero_fill", "fill_gaps"]


def _with_position(df: DataFrame, keys: list[str], order: list[str], position: str | None) -> tuple[DataFrame, str]:
    if position is not None:
        return df, position
    tagged = df.withColumn("_skey", joined_key(keys))
    return positional_index(tagged, "_skey", order, "_pos").drop("_skey"), "_pos"


def interpolate_linear(df: DataFrame, keys: Sequence[str], order: Sequence[str], value_cols: Sequence[str],
                       round_digits: int | None = None, position: str | None = None,
                       block: int = SCAN_BLOCK) -> DataFrame:
    """Linear interpolation by row position (values treated as equally spaced), both ends filled
    with the nearest value. ``round_digits`` rounds half-to-even afterwards.

    ``position``: an existing 0..n-1 position column (a complete grid's ``t``); otherwise it is
    derived with the distributed positional index. The nearest non-null neighbours come from a
    blocked scan, so a long series is spread over many tasks.
    """
    keys, order = list(keys), list(order)
    out, pos = _with_position(df, keys, order, position)
    scan_keys = keys or ["_whole"]
    src = out if keys else out.withColumn("_whole", F.lit(0))
    nb = neighbours(src, scan_keys, pos, list(value_cols), block)
    p = F.col(pos)
    filled_cols = {}
    for c in value_cols:
        pv, pi, nv, ni = (F.col(f"{c}__{x}") for x in ("pv", "pi", "nv", "ni"))
        filled = F.coalesce(F.col(c), pv + (nv - pv) * (p - pi) / (ni - pi), pv, nv)
        if round_digits is not None:
            filled = F.bround(filled, round_digits)
        filled_cols[c] = filled.cast("double")
    cols = [filled_cols[c].alias(c) if c in filled_cols else F.col(c) for c in out.columns]
    res = nb.select(*cols)
    return res.drop("_pos") if position is None else res


def ffill_bfill(df: DataFrame, keys: Sequence[str], order: Sequence[str], value_cols: Sequence[str],
                position: str | None = None, block: int = SCAN_BLOCK) -> DataFrame:
    """Forward fill, then backward fill for the leading gap (blocked scan, as above)."""
    keys, order = list(keys), list(order)
    out, pos = _with_position(df, keys, order, position)
    scan_keys = keys or ["_whole"]
    src = out if keys else out.withColumn("_whole", F.lit(0))
    nb = neighbours(src, scan_keys, pos, list(value_cols), block)
    cols = [F.coalesce(F.col(f"{c}__pv"), F.col(f"{c}__nv")).alias(c) if c in value_cols else F.col(c)
            for c in out.columns]
    res = nb.select(*cols)
    return res.drop("_pos") if position is None else res


def fill_gaps(df: DataFrame, keys: Sequence[str], order: Sequence[str], value_cols: Sequence[str],
              round_digits: int | None = None, position: str | None = None, zero: bool = True,
              block: int = SCAN_BLOCK) -> DataFrame:
    """Linear interpolation, forward fill, backward fill and, with ``zero``, 0 where a series has no value at all.

    Interpolation between the neighbours and the nearest value at both ends read one and the same state, so all fills
    are one blocked scan over an input that is materialised once; forward and backward filling after interpolation
    could not change a value.
    """
    out, pos = _with_position(df, list(keys), list(order), position)
    filled = interpolate_linear(cut_lineage(out), keys, order, value_cols, round_digits, pos, block)
    if zero:
        filled = zero_fill(filled, value_cols)
    return filled.drop("_pos") if position is None else filled


def zero_fill(df: DataFrame, value_cols: Sequence[str]) -> DataFrame:
    return df.fillna(0.0, subset=list(value_cols))
