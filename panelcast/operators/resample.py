"""Calendar regularisation: weekly roll-up (W-MON bins) and the complete hourly grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.scalar import iso_week, iso_year, week_end_monday, week_start_monday

__all__ = ["weekly_rollup", "hourly_grid", "week_label"]


def week_label(ts_col: str, label: str = "end"):
    """'end': Tuesday..Monday bin labelled by its closing Monday; 'start': ISO week's opening Monday."""
    if label == "end":
        return week_end_monday(ts_col)
    if label == "start":
        return week_start_monday(ts_col)
    raise ValueError("label must be 'end' or 'start'")


def _steps_between(lo, hi, unit: str, ntz: bool):
    """Whole steps from lo to hi: calendar arithmetic for dates / zone-less stamps, physical
    microseconds for zoned stamps (never the session time zone)."""
    if unit == "WEEK":
        return F.floor(F.datediff(hi, lo) / 7)
    if ntz:
        return F.timestamp_diff("HOUR", lo, hi)
    return F.floor((F.unix_micros(hi) - F.unix_micros(lo)) / 3_600_000_000)


def _add_steps(lo, k, unit: str, ntz: bool):
    if unit == "WEEK":
        return F.date_add(lo, (k * 7).cast("int"))
    if ntz:
        return F.timestamp_add("HOUR", k, lo)
    return F.timestamp_micros(F.unix_micros(lo) + k * 3_600_000_000)


def _fill_gaps(agg: DataFrame, keys: list[str], stamp: str, unit: str, ntz: bool, value_cols: list[str]) -> DataFrame:
    """Insert the missing grid points between consecutive aggregated rows of each key.

    Runs on the aggregated rows only (bounded by the calendar): each row emits itself and the
    empty steps up to the next row (``lead``); ``t`` counts steps from the key's first row.
    """
    w = Window.partitionBy(*keys).orderBy(stamp)
    nxt = F.lead(stamp).over(w)
    lo = F.min(stamp).over(Window.partitionBy(*keys))
    marked = agg.select("*", nxt.alias("_next"), lo.alias("_lo"))
    gap = F.coalesce(_steps_between(F.col(stamp), F.col("_next"), unit, ntz) - 1, F.lit(0))
    gen = marked.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), gap.cast("bigint"))).alias("_k"))
    own = F.col("_k") == 0
    t = (_steps_between(F.col("_lo"), F.col(stamp), unit, ntz) + F.col("_k")).cast("bigint")
    return gen.select(*keys, _add_steps(F.col(stamp), F.col("_k"), unit, ntz).alias(stamp), t.alias("t"),
                      *[F.when(own, F.col(c)).alias(c) for c in value_cols])


def weekly_rollup(df: DataFrame, keys: Sequence[str], ts_col: str, mean_cols: Sequence[str] = (),
                  sum_cols: Sequence[str] = (), first_cols: Sequence[str] = (), label: str = "end",
                  complete: bool = True, week_col: str = "week") -> DataFrame:
    """Weekly roll-up per key: mean / sum / first-non-null (earliest stamp, ties by value) per column.

    One partial+final aggregation keyed by (keys, week): a hot key only costs one partial row
    per (partition, week). Mean/sum-only roll-ups stay on hash aggregation; a ``first`` column
    carries a (stamp, value) ordering and is aggregated by sort. With ``complete`` every week
    between a key's first and last week is present (empty weeks: mean NULL, sum 0, first NULL),
    filled in after the aggregation, and ``t`` is the week's position 0..n-1.
    """
    keys = list(keys)
    wk = week_label(ts_col, label).alias(week_col)
    aggs = ([F.avg(c).alias(c) for c in mean_cols] + [F.sum(c).alias(c) for c in sum_cols]
            + [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(F.col(ts_col), F.col(c)))).alias(c)
               for c in first_cols])
    agg = df.groupBy(*keys, wk).agg(*aggs)
    values = [*mean_cols, *sum_cols, *first_cols]
    if complete:
        agg = _fill_gaps(agg, keys, week_col, "WEEK", False, values)
    else:
        agg = agg.withColumn("t", F.lit(None).cast("bigint"))
    return agg.select(
        *keys, F.col(week_col), F.col("t"),
        iso_year(week_col).alias("iso_year"), iso_week(week_col).alias("iso_week"),
        (iso_year(week_col) * 100 + iso_week(week_col)).alias("isoyw"),
        *[F.col(c) for c in mean_cols],
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in sum_cols],
        *[F.col(c) for c in first_cols],
    )


def hourly_grid(df: DataFrame, keys: Sequence[str], ts_col: str, value_cols: Sequence[str],
                mode: str = "truncate", check_unique: bool = True, first_cols: Sequence[str] = ()) -> DataFrame:
    """Complete hourly grid per key from the first to the last stamp, observations left-joined.

    mode='truncate' (default): stamps are truncated to the hour and duplicates averaged (``first_cols``:
    first non-null by stamp); the missing hours are generated after that aggregation (no second
    scan, no join).
    mode='exact': grid starts at the exact first stamp; readings off the grid are dropped and,
    unless ``check_unique`` is off, duplicate stamps raise (grid = bounds aggregate + left join).
    """
    keys = list(keys)
    value_cols, first_cols = list(value_cols), list(first_cols)
    ntz = dict(df.dtypes)[ts_col] == "timestamp_ntz"
    if mode == "truncate":
        c = F.col(ts_col)
        hour = (F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.lit(0), F.lit(0)) if ntz
                else F.date_trunc("hour", c))
        obs = df.groupBy(*keys, hour.alias(ts_col)).agg(
            *[F.avg(v).alias(v) for v in value_cols],
            *[F.min_by(F.col(v), F.when(F.col(v).isNotNull(), F.struct(c, F.col(v)))).alias(v) for v in first_cols])
        filled = _fill_gaps(obs, keys, ts_col, "HOUR", ntz, value_cols + first_cols)
        return filled.select(*keys, "t", ts_col, *value_cols, *first_cols)
    if mode != "exact":
        raise ValueError("mode must be 'truncate' or 'exact'")
    value_cols = value_cols + first_cols
    obs = df.select(*keys, ts_col, *value_cols)
    if check_unique and not obs.groupBy(*keys, ts_col).count().filter("count > 1").isEmpty():
        raise ValueError("cannot reindex on an axis with duplicate timestamps")
    bounds = obs.groupBy(*keys).agg(F.min(ts_col).alias("_lo"), F.max(ts_col).alias("_hi"))
    n = _steps_between(F.col("_lo"), F.col("_hi"), "HOUR", ntz).cast("bigint")
    steps = bounds.select(*keys, "_lo", F.explode(F.sequence(F.lit(0).cast("bigint"), n)).alias("t"))
    grid = steps.select(*keys, F.col("t"), _add_steps(F.col("_lo"), F.col("t"), "HOUR", ntz).alias(ts_col))
    return grid.join(obs, keys + [ts_col], "left").select(*keys, "t", ts_col, *value_cols)
