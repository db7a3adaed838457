"""Reshapes: wide <-> long, per-strain split into series, history + forecast overlay, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.scalar import joined_key
from panelcast.operators.lags import positional_index

__all__ = ["to_long", "split_series", "history_forecast_overlay", "granger_labels", "relative_week",
           "last_n", "to_panel"]


def to_long(df: DataFrame, ids: Sequence[str], value_cols: Sequence[str], var_name: str = "variable",
            value_name: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(value_cols), var_name, value_name)


def split_series(df: DataFrame, key_cols: Sequence[str], strain_cols: Sequence[str], shared_cols: Sequence[str],
                 target_name: str = "target", sep: str = "|") -> DataFrame:
    """One training table per strain -> one long panel: series_id = keys|strain, target = that strain's
    value, the shared columns repeated."""
    stacked = df.unpivot([*key_cols, *shared_cols], list(strain_cols), "strain", target_name)
    sid = joined_key([*key_cols, "strain"], sep)
    return stacked.select(sid.alias("series_id"), *key_cols, "strain", *shared_cols, target_name)


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, str]:
    return df.withColumn("_rk", joined_key(keys)), "_rk"


def relative_week(df: DataFrame, keys: Sequence[str], order: str, name: str = "week_no") -> DataFrame:
    """1..n per key in ``order`` (distributed positional index, no series-wide window)."""
    keyed, rk = _keyed(df, keys)
    return (positional_index(keyed, rk, [order], "_p").withColumn(name, (F.col("_p") + 1).cast("bigint"))
            .drop("_p", rk))


def last_n(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """Last n rows per key: position >= count - n (per-key top-k, not a global cap)."""
    keyed, rk = _keyed(df, keys)
    pos = positional_index(keyed, rk, [order], "_p")
    counts = keyed.groupBy(rk).agg(F.count(F.lit(1)).alias("_cnt"))
    return pos.join(counts, rk).filter(F.col("_p") >= F.col("_cnt") - n).drop("_p", "_cnt", rk)


def history_forecast_overlay(history_long: DataFrame, forecast_long: DataFrame, n_hist: int = 30,
                             series_col: str = "series_id") -> DataFrame:
    """Last ``n_hist`` observations numbered 1..n plus forecasts at x = n + step, tagged by kind.

    history_long: (series_id, t, variable, value); forecast_long: (series_id, step, variable, value).
    """
    keyed, rk = _keyed(history_long, [series_col, "variable"])
    pos = positional_index(keyed, rk, ["t"], "_p")
    counts = keyed.groupBy(rk).agg(F.count(F.lit(1)).alias("_cnt"))
    tail = pos.join(counts, rk).filter(F.col("_p") >= F.col("_cnt") - n_hist)
    x = F.col("_p") - F.greatest(F.col("_cnt") - n_hist, F.lit(0)) + 1
    hist = tail.select(series_col, "variable", x.cast("bigint").alias("x"), "value", F.lit("history").alias("kind"))
    n_per = hist.groupBy(series_col, "variable").agg(F.max("x").alias("_n"))
    fc = (forecast_long.join(n_per, [series_col, "variable"])
          .select(series_col, "variable", (F.col("_n") + F.col("step")).cast("bigint").alias("x"), "value",
                  F.lit("forecast").alias("kind")))
    return hist.unionByName(fc)


def granger_labels(granger_df: DataFrame) -> DataFrame:
    """Heat-map rows: 'GC' where the test is significant."""
    return granger_df.withColumn("label", F.when(F.col("significant"), F.lit("GC")).otherwise(F.lit("")))


def to_panel(df: DataFrame, key_cols: Sequence[str], time_col: str, variables: Sequence[str],
             renames: dict[str, str] | None = None, sep: str = "|") -> DataFrame:
    """(series_id = keys joined, t, variables as double)."""
    renames = renames or {}
    sid = joined_key(key_cols, sep)
    return df.select(sid.alias("series_id"), F.col(time_col).cast("bigint").alias("t"),
                     *[F.col(v).cast("double").alias(renames.get(v, v)) for v in variables])
