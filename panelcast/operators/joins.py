"""Joins used by the pipelines: many-to-one equi-join with a uniqueness check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["join_many_to_one", "assert_unique"]


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise if any key combination repeats (one aggregation + an emptiness probe)."""
    dup = df.groupBy(*keys).count().filter(F.col("count") > 1)
    if not dup.isEmpty():
        raise ValueError(f"right side keys {list(keys)} are not unique")


def join_many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], validate: bool | str = True) -> DataFrame:
    """Inner equi-join where each left row matches at most one right row; a repeated right key raises.

    The right side here is a weekly aggregate (one row per key by construction), so its size is
    bounded by the calendar; the planner is free to broadcast it when AQE measures it small.
    ``validate``: True looks for repeated keys at once, by a scan of its own; "plan" counts them in the join's own
    plan, on the shuffle that the join needs anyway, and raises when the result is computed; False trusts the caller.
    """
    keys = list(keys)
    if validate == "plan":
        rest = [c for c in right.columns if c not in keys]
        one = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(F.lit(0).alias("_"), *rest)).alias("_row"))
        unique = F.assert_true(F.col("_n") == 1, f"right side keys {keys} are not unique")
        right = one.where(unique.isNull()).select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])
    elif validate:
        assert_unique(right, keys)
    return left.join(right, keys, "inner")
