"""Weekly and hourly panels derived from the test tables, in Spark and as DuckDB SQL twins.

lineitem  -> weekly panel per l_returnflag (W-MON bins of l_shipdate)
orders    -> weekly per-nation "case count" panel (status F / O / all), gaps where a nation has
             no order that week
events    -> hourly grid per event_type (mean value, NULL for empty hours)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.resample import hourly_grid, weekly_rollup
from panelcast.sources.readers import read_test_table

LW_MEANS = ["l_discount", "l_tax"]
LW_SUMS = ["l_quantity", "l_extendedprice"]
LW_FIRSTS: list[str] = []
NW_MEASURES = ["INF_A", "INF_B", "INF_ALL"]


def lineitem_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_test_table(spark, sf_dir, "lineitem")
    return weekly_rollup(li, ["l_returnflag"], "l_shipdate", LW_MEANS, LW_SUMS, LW_FIRSTS)


def nation_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_test_table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    c = read_test_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read_test_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select("n_name", "o_orderdate",
                    F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("INF_A"),
                    F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).alias("INF_B"),
                    F.col("o_totalprice").alias("INF_ALL"))


def nation_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly_rollup(nation_orders(spark, sf_dir), ["n_name"], "o_orderdate", NW_MEASURES)


def orders_weekly_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_test_table(spark, sf_dir, "orders")
    return weekly_rollup(o, ["o_orderstatus"], "o_orderdate", ["o_totalprice"], [], ["o_orderpriority", "o_custkey"])


def events_hourly(spark: SparkSession, sf_dir: str, mode: str = "truncate") -> DataFrame:
    ev = read_test_table(spark, sf_dir, "events")
    return hourly_grid(ev, ["event_type"], "ts", ["value"], mode=mode)


_DAILY = {f"{flag}_{status}_{name}": (flag, status, how, col) for flag in "ANR" for status in "FO"
          for name, how, col in (("qty", F.sum, "l_quantity"), ("disc", F.avg, "l_discount"))}
DAILY_VARS = [*_DAILY, "price", "tax"]


def daily_panel(spark: SparkSession, sf_dir: str, days: int) -> DataFrame:
    """One series of the last ``days`` days of lineitem, 14 variables; days without a line of a kind are
    interpolated."""
    from panelcast.operators.interp import interpolate_linear
    from panelcast.session import cut_lineage
    li = read_test_table(spark, sf_dir, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    aggs = [how(F.when((F.col("l_returnflag") == f) & (F.col("l_linestatus") == s), F.col(c))).alias(n) for n, (f, s, how, c) in _DAILY.items()]
    daily = li.groupBy("day").agg(*aggs, F.sum("l_extendedprice").alias("price"), F.avg("l_tax").alias("tax"))
    last = daily.agg(F.max("day").alias("last"))
    grid = last.select(F.posexplode(F.sequence(F.date_sub("last", days - 1), "last")).alias("t", "day"))
    whole = grid.join(daily, "day", "left").select(F.lit("all").alias("series_id"), F.col("t").cast("bigint").alias("t"), *DAILY_VARS)
    filled = interpolate_linear(whole, ["series_id"], ["t"], DAILY_VARS, position="t").fillna(0.0)
    return cut_lineage(filled)


# ------------------------------------------------------------------ SQL twins ----------------
def week_end_sql(expr: str) -> str:
    d = f"CAST({expr} AS DATE)"
    return f"({d} + CAST((8 - isodow({d})) % 7 AS INTEGER))"


def weekly_sql(name: str, source: str, keys: list[str], ts: str, means=(), sums=(), firsts=(), week_col: str = "week") -> str:
    """CTEs <name>_agg, <name>_grid, <name> reproducing weekly_rollup(complete=True)."""
    k = ", ".join(keys)
    wk = week_col
    aggs = ([f"avg({c}) AS {c}" for c in means] + [f"sum({c}) AS {c}" for c in sums]
            + [f"first({c} ORDER BY {ts}, {c}) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in firsts])
    kg = ", ".join(f"g.{x}" for x in keys)
    vals = ([f"a.{c}" for c in means] + [f"coalesce(a.{c}, 0.0) AS {c}" for c in sums] + [f"a.{c}" for c in firsts])
    return f"""
{name}_agg AS (SELECT {k}, {week_end_sql(ts)} AS {wk}, {', '.join(aggs)} FROM ({source}) s GROUP BY ALL),
{name}_grid AS (SELECT {k}, lo, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS {wk}
  FROM (SELECT {k}, min({wk}) AS lo, max({wk}) AS hi FROM {name}_agg GROUP BY ALL) b),
{name} AS (SELECT {kg}, g.{wk}, CAST(datediff('day', g.lo, g.{wk}) // 7 AS BIGINT) AS t,
  CAST(isoyear(g.{wk}) AS INTEGER) AS iso_year, CAST(week(g.{wk}) AS INTEGER) AS iso_week,
  CAST(isoyear(g.{wk}) * 100 + week(g.{wk}) AS INTEGER) AS isoyw, {', '.join(vals)}
  FROM {name}_grid g LEFT JOIN {name}_agg a USING ({k}, {wk}))"""


LW_SQL = weekly_sql("lw", "SELECT * FROM lineitem", ["l_returnflag"], "l_shipdate", LW_MEANS, LW_SUMS, LW_FIRSTS)

NW_SQL = weekly_sql(
    "nw",
    """SELECT n_name, o_orderdate,
         CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS INF_A,
         CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS INF_B,
         o_totalprice AS INF_ALL
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    ["n_name"], "o_orderdate", NW_MEASURES)

OF_SQL = weekly_sql("of", "SELECT * FROM orders", ["o_orderstatus"], "o_orderdate", ["o_totalprice"], [],
                    ["o_orderpriority", "o_custkey"])

EH_SQL = """
eh_obs AS (SELECT event_type, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY ALL),
eh_grid AS (SELECT event_type, lo, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts
  FROM (SELECT event_type, min(ts) AS lo, max(ts) AS hi FROM eh_obs GROUP BY ALL) b),
eh AS (SELECT g.event_type, CAST(date_diff('hour', g.lo, g.ts) AS BIGINT) AS t, g.ts, o.value
  FROM eh_grid g LEFT JOIN eh_obs o USING (event_type, ts))"""
