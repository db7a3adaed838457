"""Completeness and data-quality aggregates: null counts, rankings, summaries, buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.lags import positional_index
from panelcast.operators.selection import at_ranks
from panelcast.session import cut_lineage

__all__ = ["null_count_ranking", "nan_summary", "completeness", "quality_buckets", "null_totals",
           "global_stats", "top_k", "bottom_k", "keep_keys", "column_minimums", "quantiles"]


def null_count_ranking(df: DataFrame, keys: Sequence[str], value_cols: Sequence[str]) -> DataFrame:
    """Per group: rows, NULLs per value column, total, NaN_Percentage = round(total/(rows*n)*100, 2),
    Data_Quality_Score = round(100 - pct, 2) (half-even), Rank 1..n by total NULLs (ties by keys).

    One aggregation (null-key groups dropped first); the rank comes from the distributed index, so
    many groups do not meet in one task.
    """
    keys = list(keys)
    n = len(value_cols)
    src = df.dropna(subset=keys)
    counts = [F.count_if(F.col(c).isNull()).cast("bigint").alias(f"{c}_NaN_Count") for c in value_cols]
    g = src.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("Total_Records"), *counts)
    total = sum((F.col(f"{c}_NaN_Count") for c in value_cols[1:]), F.col(f"{value_cols[0]}_NaN_Count"))
    g = g.withColumn("Total_NaN_Count", total.cast("bigint"))
    g = g.withColumn("NaN_Percentage", F.bround(F.col("Total_NaN_Count") / (F.col("Total_Records") * n) * 100, 2))
    g = g.withColumn("Data_Quality_Score", F.bround(100 - F.col("NaN_Percentage"), 2))
    g = cut_lineage(g.withColumn("_all", F.lit("")))  # one row per group; the index reads it several times
    ranked = positional_index(g, "_all", ["Total_NaN_Count", *keys], "_place")
    return ranked.select((F.col("_place") + 1).cast("bigint").alias("Rank"), *keys, "Total_Records",
                    *[f"{c}_NaN_Count" for c in value_cols], "Total_NaN_Count", "NaN_Percentage",
                    "Data_Quality_Score")


def nan_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, NaN_count, NaN_fraction) for every column in one pass, sorted by fraction desc."""
    cols = list(cols or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_c{i}") for i, c in enumerate(cols)])
    stacked = one.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_c{i}").alias("cnt"))
                                                  for i, c in enumerate(cols)])).alias("s"))
    return (stacked.select(F.col("s.column").alias("column"), F.col("s.cnt").cast("bigint").alias("NaN_count"),
                           (F.col("s.cnt") / F.col("_n")).alias("NaN_fraction"))
            .orderBy(F.desc("NaN_fraction"), "column"))


def completeness(df: DataFrame, keys: Sequence[str], value_cols: Sequence[str], digits: int = 1) -> DataFrame:
    """Per group: record count and percent of non-NULL values per column."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("bigint").alias("Records"),
        *[F.round(F.count(c) / F.count(F.lit(1)) * 100, digits).alias(f"{c}_complete_pct") for c in value_cols])


def quality_buckets(ranking: DataFrame, score_col: str = "Data_Quality_Score") -> DataFrame:
    s = F.col(score_col)
    counted = ranking.agg(
        F.count_if(s > 90).cast("bigint").alias("excellent"),
        F.count_if((s > 75) & (s <= 90)).cast("bigint").alias("good"),
        F.count_if((s > 50) & (s <= 75)).cast("bigint").alias("fair"),
        F.count_if(s <= 50).cast("bigint").alias("poor"),
        F.avg(s).alias("mean_score"))
    return _beside(counted, quantiles(ranking, [], score_col, {"median_score": 0.5}))


def null_totals(df: DataFrame, value_cols: Sequence[str], label: str | None = None) -> DataFrame:
    out = df.agg(*[F.count_if(F.col(c).isNull()).cast("bigint").alias(f"{c}_nulls") for c in value_cols])
    out = out.withColumn("total_nulls", sum((F.col(f"{c}_nulls") for c in value_cols[1:]), F.col(f"{value_cols[0]}_nulls")))
    return out.withColumn("stage", F.lit(label)) if label else out


def global_stats(df: DataFrame, value_col: str, distinct_col: str | None = None) -> DataFrame:
    aggs = [F.min(value_col).alias("min"), F.max(value_col).alias("max"), F.avg(value_col).alias("mean")]
    if distinct_col:
        aggs.append(F.count_distinct(distinct_col).cast("bigint").alias("n_distinct"))
    return _beside(df.agg(*aggs), quantiles(df, [], value_col, {"median": 0.5}))


def _beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """The columns of two one-row tables."""
    one = F.lit(1).alias("_one")
    return a.select("*", one).join(b.select("*", one), "_one").drop("_one")


def top_k(df: DataFrame, k: int, order: Sequence) -> DataFrame:
    """Top-k by a global order (TakeOrderedAndProject: per-partition top-k, then merge)."""
    return df.orderBy(*order).limit(k)


def bottom_k(df: DataFrame, k: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(k)


def keep_keys(df: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Membership filter (left-semi). The planner broadcasts a key list that it has measured to be small."""
    return df.join(keys_df.select(*keys), list(keys), "left_semi")


def column_minimums(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[F.min(c).alias(c) for c in cols])


def quantiles(df: DataFrame, keys: Sequence[str], value_col: str, wanted: dict[str, float]) -> DataFrame:
    """One column per wanted quantile (linear between order statistics, q clamped to [0, 1]) and key.

    Exact without sorting and without a buffer per key: counting selection finds the order statistics, one scan a round.
    NULL values are left out; a key without values has no row.
    """
    keys = list(keys)
    known = df.where(F.col(value_col).isNotNull())
    known = known.select((F.struct(*keys) if keys else F.lit("")).alias("_k"), F.col(value_col).alias("_given"))
    shares = [min(max(float(q), 0.0), 1.0) for q in wanted.values()]
    place = lambda n, q: (n - 1) * F.lit(q)
    found = at_ranks(known, "_k", "_given", lambda n: [f(place(n, q)) for q in shares for f in (F.floor, F.ceil)])
    out = []
    for i, (name, q) in enumerate(zip(wanted, shares)):
        part = place(F.col("_n"), q) - F.floor(place(F.col("_n"), q))
        out.append((F.get("_values", F.lit(2 * i)) * (1 - part) + F.get("_values", F.lit(2 * i + 1)) * part).alias(name))
    return found.select(*[F.col(f"_k.`{c}`") for c in keys], *out)
