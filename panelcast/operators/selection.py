"""Counting selection: the rows of every key cut into ordered ranges of bounded size, without sorting them.

A round cuts each range that is still too large into as many bins as its row count asks for and counts them; the
next round goes on with the bins that are too large. Rows find their bin by arithmetic on their own value and one lookup of
their range, so a round is one scan with a map-side combine. Ranges are known by a *path*, one number per cut, and paths order
like the values. A range of one single value is not cut: quantiles need its count only, positions go on with the next order column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.session import written_table

__all__ = ["BUCKET", "ordered_ranges", "with_offsets", "at_ranks"]

BUCKET = 65_536  # rows of a range, unless they are alike in all order columns
MOST_BINS = 65_536  # bins of one cut
SMALL = 100_000  # ranges that are broadcast to the rows; more are joined as the planner sees fit
PREFIX = 6  # bytes of a text that one cut looks at

_INTEGERS = ("tinyint", "smallint", "int", "bigint", "boolean")


def _kind(dtype: str) -> str | None:
    """How values of a type are cut; None for nested ones, which are not."""
    if dtype in ("double", "float"):
        return "float"
    if dtype in _INTEGERS or dtype.startswith(("decimal", "interval day")) or dtype in ("date", "timestamp", "timestamp_ntz"):
        return "exact"
    if dtype.startswith(("string", "char", "varchar")) or dtype == "binary":
        return "text"
    return None


def _value(c: str, dtype: str) -> Column:
    """The column as numbers or texts whose order is that of the column."""
    col = F.col(f"`{c}`")
    if dtype == "date":
        return F.unix_date(col).cast("bigint")
    if dtype == "timestamp":
        return F.unix_micros(col)
    if dtype == "timestamp_ntz":  # zone-less, independent of the session time zone
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col)
    if dtype in _INTEGERS:
        return col.cast("bigint")
    if dtype == "float":
        return col.cast("double")
    if _kind(dtype) == "text":
        return F.hex(col.cast("binary"))
    return col


def _class(v: Column, kind: str) -> Column:
    """NULL first, as Spark orders it; then numbers by sign, so that one cut sees one sign; NaN last."""
    if kind == "text":
        return F.when(v.isNull(), 0).otherwise(1)
    signs = F.when(v < 0, 2).when(v == 0, 3).otherwise(4)
    if kind == "float":
        inf = F.lit(float("inf"))
        signs = F.when(F.isnan(v), 6).when(v == inf, 5).when(v == -inf, 1).otherwise(signs)
    return F.when(v.isNull(), 0).otherwise(signs)


def _common(lo: Column, hi: Column) -> Column:
    """Hexadecimal digits, an even number, that two texts begin with alike."""
    alike = F.zip_with(F.split(lo, ""), F.split(hi, ""), lambda a, b: a.eqNullSafe(b))
    first = F.array_position(alike, False)
    digits = F.when(first > 0, first - 1).otherwise(F.least(F.length(lo), F.length(hi)))
    return (F.floor(digits / 2) * 2).cast("int")


def _share(v: Column, kind: str) -> Column:
    """Where in its range (_lo .. _hi) a value lies: 0 .. 1, never falling as the value rises."""
    lo, hi = F.col("_lo"), F.col("_hi")
    if kind == "text":
        def number(x):
            part = F.substr(x, F.col("_skip") + 1, F.lit(2 * PREFIX))
            # a text that ends within the part comes before one that goes on with zero bytes
            return F.conv(F.rpad(part, 2 * PREFIX, "0"), 16, 10).cast("double") + F.length(part) / F.lit(32.0)

        return (number(v) - number(lo)) / (number(hi) - number(lo))
    linear = (v - lo).cast("double") / (hi - lo).cast("double")
    wide = F.greatest(F.abs(lo.cast("double")), F.abs(hi.cast("double"))) > 16 * F.least(F.abs(lo.cast("double")), F.abs(hi.cast("double")))
    log = lambda x: F.log(F.abs(x.cast("double"))) * F.signum(x.cast("double"))
    return F.when(wide, (log(v) - log(lo)) / (log(hi) - log(lo))).otherwise(linear)


def _counted(rows: DataFrame, key: str) -> DataFrame:
    stats = rows.groupBy(key, "_path").agg(F.min("_cv").alias("_lo"), F.max("_cv").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    return written_table(stats)


def _near(small: DataFrame) -> tuple[DataFrame, int]:
    """A written table, marked for broadcast if its count allows, and the count."""
    n = small.count()
    return (F.broadcast(small) if n <= SMALL else small), n


def with_offsets(ranges: DataFrame, key: str) -> DataFrame:
    """Adds ``_off``, the rows of the key in the ranges before."""
    before = Window.partitionBy(key).orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def _refined(rows: DataFrame, own: DataFrame, key: str, kind: str, bucket: int, chosen: Callable[[DataFrame], DataFrame]):
    """Cuts the ``chosen`` ranges of ``own`` by ``_cv`` until they hold ``bucket`` rows at most or one value."""
    while True:
        cut = chosen(own).where((F.col("_n") > bucket) & (F.col("_lo") < F.col("_hi")))
        cut = cut.select(key, "_path", "_lo", "_hi", F.least(F.lit(MOST_BINS), F.ceil(2 * F.col("_n") / bucket) + 1).alias("_bins"))
        if kind == "text":
            cut = cut.withColumn("_skip", _common(F.col("_lo"), F.col("_hi")))
        cut, n = _near(written_table(cut))
        if not n:
            return rows, own
        joined = rows.join(cut, [key, "_path"], "left")
        at = F.least(F.col("_bins") - 1, F.floor(_share(F.col("_cv"), kind) * F.col("_bins"))).cast("int")
        finer = F.when(F.col("_bins").isNull(), F.col("_path")).otherwise(F.concat("_path", F.array(at)))
        joined = joined.withColumn("_path", finer)
        parts = _counted(joined.where("_bins is not null"), key)
        own = own.join(cut.select(key, "_path"), [key, "_path"], "left_anti").unionByName(parts)
        rows = joined.select(*rows.columns)


def ordered_ranges(df: DataFrame, key: str, order_cols: Sequence[str], bucket: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(df with ``_path``, ranges): the rows of ``key`` (a column that is never NULL) in ranges ordered by ``order_cols``.

    ``ranges`` holds (key, _path, _n), written. A range has at most ``bucket`` rows, unless they are alike
    in all order columns or differ in a column of a nested type only. If no key has more rows than that, every
    key is one range and ``ranges`` is None: one count of the rows is all it takes.
    """
    bucket = bucket or BUCKET
    types = dict(df.dtypes)
    none = F.array().cast("array<int>")
    rows = df.withColumn("_path", none)
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    if (counts.agg(F.max("_n")).first()[0] or 0) <= bucket:
        return rows, None
    ranges = written_table(counts.select(key, none.alias("_path"), "_n"))
    for c in order_cols:
        large, n = _near(written_table(ranges.where(F.col("_n") > bucket).select(key, "_path", F.lit(True).alias("_large"))))
        kind = _kind(types[c])
        if not n or kind is None:
            break
        rows = rows.join(large, [key, "_path"], "left").withColumn("_cv", _value(c, types[c]))
        first = F.when(F.col("_large"), F.concat("_path", F.array(_class(F.col("_cv"), kind)))).otherwise(F.col("_path"))
        rows = rows.withColumn("_path", first)
        own = _counted(rows.where("_large"), key)
        rows, own = _refined(rows.drop("_large"), own, key, kind, bucket, lambda r: r)
        rest = ranges.join(large, [key, "_path"], "left_anti")
        ranges, rows = written_table(own.select(key, "_path", "_n").unionByName(rest)), rows.drop("_cv")
    return rows, ranges


def at_ranks(df: DataFrame, key: str, value_col: str, ranks: Callable[[Column], Sequence[Column]], bucket: int | None = None) -> DataFrame:
    """(key, _n, _values): the values at the ``ranks`` (0-based, from a key's row count) of every key, in the order asked for.

    Only ranges that hold a wanted rank are cut further. Those that end with one value need no rows any more; of the
    others, at most ``bucket`` rows each, one list is sorted. A group of the key is never held. The column is numeric
    and holds no NULL.
    """
    bucket = bucket or BUCKET
    dtype = dict(df.dtypes)[value_col]
    kind = _kind(dtype)
    if kind not in ("float", "exact"):
        raise TypeError(f"no order statistics of a column of type {dtype}")
    rows = df.select(key, F.col(value_col).alias("_given"), _value(value_col, dtype).alias("_cv"))
    rows = rows.withColumn("_path", F.array(_class(F.col("_cv"), kind)))
    own = _counted(rows, key)
    wanted = own.groupBy(key).agg(F.sum("_n").alias("_all"))
    wanted = wanted.select(key, "_all", F.posexplode(F.array(*[r.cast("bigint") for r in ranks(F.col("_all"))])).alias("_nth", "_rank"))
    wanted = written_table(wanted)

    def holding(ranges: DataFrame) -> DataFrame:
        found = with_offsets(ranges, key).join(wanted, key)
        return found.where("_rank >= _off and _rank < _off + _n")

    def chosen(ranges: DataFrame) -> DataFrame:
        return holding(ranges).select(*ranges.columns).distinct()

    rows, own = _refined(rows, own, key, kind, bucket, chosen)
    held = written_table(holding(own).select(key, "_path", "_lo", "_hi", "_all", "_nth", (F.col("_rank") - F.col("_off")).cast("int").alias("_at")))
    alike = F.col("_lo").eqNullSafe(F.col("_hi"))
    open_, n = _near(written_table(held.where(~alike).select(key, "_path").distinct()))
    if n:
        lists = rows.join(open_, [key, "_path"]).groupBy(key, "_path").agg(F.sort_array(F.collect_list("_cv")).alias("_list"))
        held = held.join(lists, [key, "_path"], "left")
        held = held.withColumn("_lo", F.when(~alike, F.get("_list", F.col("_at"))).otherwise(F.col("_lo")))
    values = F.transform(F.array_sort(F.collect_list(F.struct("_nth", "_lo"))), lambda x: x["_lo"])
    return held.groupBy(key, F.col("_all").alias("_n")).agg(values.alias("_values"))
