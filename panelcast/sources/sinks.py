"""Sinks: long result tables, wide pivots and file writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["write_table", "forecast_wide", "irf_wide", "round_doubles", "granger_output", "bootstrap_irf_output",
           "bootstrap_granger_output"]

# Fixed output headers of the published result files.
GRANGER_HEADER = ["CauseVar", "EffectVar", "FStatistic", "PValue", "Lags", "Significant"]
BOOT_IRF_HEADER = ["ShockVar", "ResponseVar", "Horizon", "Point", "Lower", "Upper"]
BOOT_GRANGER_HEADER = ["CauseVar", "EffectVar", "FStatistic", "AsymptoticP", "BootPValue", "Lags",
                       "Significant_Asymptotic", "Significant_Bootstrap"]


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Text-style rounding of every double column (sink formatting only)."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() == "double"
                       else F.col(f.name) for f in df.schema.fields])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "overwrite", digits: int | None = None, replace_partitions: bool = False) -> None:
    """Write a table, with ``partition_by`` one folder per value of these columns.

    Rows are rebalanced by the partition columns first, so a small partition is one file and a large one is
    split by size, not by the number of tasks. ``replace_partitions``: only the partitions that ``df`` has rows
    for are replaced, those of other values stay.
    """
    if digits is not None:
        df = round_doubles(df, digits)
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic" if replace_partitions else "static")
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)


def forecast_wide(forecast_long: DataFrame, variables: Sequence[str], series_col: str = "series_id",
                  names: Sequence[str] | None = None) -> DataFrame:
    """(series, step, variable, value) -> one column per variable, fixed column list (no discovery pass).

    ``names`` relabels the columns; when their count differs from the variables, Var1..VarK is used.
    """
    variables = list(variables)
    wide = (forecast_long.groupBy(series_col, "step").pivot("variable", variables)
            .agg(F.first("value")).orderBy(series_col, "step"))
    if names is not None:
        labels = list(names) if len(names) == len(variables) else [f"Var{i + 1}" for i in range(len(variables))]
        wide = wide.select(series_col, "step", *[F.col(v).alias(n) for v, n in zip(variables, labels)])
    return wide


def irf_wide(irf_long: DataFrame, variables: Sequence[str], response: str, series_col: str = "series_id") -> DataFrame:
    """Response of one variable to every shock: Horizon, Shock_<var>... with a fixed, ordered column list."""
    sel = irf_long.filter(F.col("response") == response)
    wide = sel.groupBy(series_col, "horizon").pivot("shock", list(variables)).agg(F.first("value"))
    return wide.select(series_col, "horizon", *[F.col(v).alias(f"Shock_{v}") for v in variables])


def granger_output(granger_df: DataFrame, series_col: str = "series_id") -> DataFrame:
    """Long Granger table in the published layout (diagonal never present)."""
    return granger_df.select(series_col, *[F.col(a).alias(b) for a, b in zip(
        ["cause", "effect", "f_stat", "p_value", "lags", "significant"], GRANGER_HEADER)])


def bootstrap_irf_output(boot_irf: DataFrame, series_col: str = "series_id") -> DataFrame:
    return boot_irf.select(series_col, *[F.col(a).alias(b) for a, b in zip(
        ["shock", "response", "horizon", "point", "lower", "upper"], BOOT_IRF_HEADER)])


def bootstrap_granger_output(boot_granger: DataFrame, series_col: str = "series_id") -> DataFrame:
    return boot_granger.select(series_col, *[F.col(a).alias(b) for a, b in zip(
        ["cause", "effect", "f_stat", "asymptotic_p", "boot_p", "lags", "significant_asymptotic",
         "significant_bootstrap"], BOOT_GRANGER_HEADER)])
