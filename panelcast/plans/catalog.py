"""Registered queries over the test tables, each with a DuckDB oracle where SQL can express it.

Every query reads whole tables (no id subsets, no row caps); limits appear only where the
operator is a top-k. Doubles are rounded identically on both sides for the value-hash check.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions import scalar as S
from panelcast.functions.fdist import f_upper_tail
from panelcast.operators import interp, quality, reshape
from panelcast.plans import derived as D
from panelcast.sources.readers import read_test_table


@dataclass
class Query:
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doubles: tuple[str, ...]
    digits: int
    sig: bool


CATALOG: dict[str, Query] = {}


def register(name: str, sql: str | None = None, doubles=(), digits: int = 6, sig: bool = False):
    """``digits`` decimals, or significant digits when ``sig`` (model outputs of any magnitude)."""
    def deco(fn):
        CATALOG[name] = Query(fn, sql, tuple(doubles), digits, sig)
        return fn
    return deco


# A tail probability from a finite series, 1 - sum, is only known to some 1e-16: such columns compare at
# 12 decimals at most. All other columns compare at significant digits down to the 22 decimals whose power of
# ten is an exact double.
P_COLUMNS = ("p_value", "reset_p", "asymptotic_p", "PValue", "AsymptoticP")
MAX_DECIMALS, ALL_DECIMALS = 12, 22


def _most(c: str) -> int:
    return MAX_DECIMALS if c in P_COLUMNS else ALL_DECIMALS


def _round_col(c: str, digits: int, sig: bool):
    x = F.col(c)
    if not sig:
        return F.round(x, digits) + F.lit(0.0)
    # k decimals keep ``digits`` significant digits; only exact powers 10^|k| are used, so both
    # engines produce the identical double
    k = F.least(F.lit(digits) - F.ceil(F.log10(F.abs(x))), F.lit(_most(c)))
    p = F.pow(F.lit(10.0), F.abs(k))
    r = F.when(k >= 0, F.round(x * p, 0) / p).otherwise(F.round(x / p, 0) * p)
    return F.when(x.isNull() | F.isnan(x) | (x == 0), x).otherwise(r) + F.lit(0.0)


def _round_sql(c: str, digits: int, sig: bool) -> str:
    if not sig:
        return f"round({c}, {digits}) + 0.0"
    k = f"least({digits} - ceil(log10(abs({c}))), {_most(c)})"
    p = f"pow(10.0, abs({k}))"
    return (f"(CASE WHEN {c} IS NULL OR isnan({c}) OR {c} = 0 THEN {c} WHEN {k} >= 0 THEN round({c} * {p}) / {p} "
            f"ELSE round({c} / {p}) * {p} END) + 0.0")


def _round_df(df: DataFrame, q: Query) -> DataFrame:
    return df.select(*[_round_col(c, q.digits, q.sig).alias(c) if c in q.doubles else F.col(c) for c in df.columns])


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def make(q: Query):
        return lambda spark, sf_dir: _round_df(q.fn(spark, sf_dir), q)
    return {name: make(q) for name, q in CATALOG.items()}


def oracle_queries() -> dict[str, str]:
    out = {}
    for name, q in CATALOG.items():
        if q.sql is None:
            continue
        if q.doubles:
            rep = ", ".join(f"{_round_sql(c, q.digits, q.sig)} AS {c}" for c in q.doubles)
            out[name] = f"SELECT * REPLACE ({rep}) FROM ({q.sql}) q"
        else:
            out[name] = q.sql
    return out


def f1_tail_ctes(src: str, keys: list[str], out: str) -> str:
    """CTEs computing P(F > f) for F ~ F(1, nu), integer nu, from the finite Student-t series:
    nu even: P(|T|<=t) = sin(th) sum_{k<nu/2} c_k cos^{2k} th, c_k = G(k+1/2)/(G(1/2) G(k+1));
    nu odd:  P(|T|<=t) = 2/pi (th + sin(th) sum_{k<(nu-1)/2} d_k cos^{2k+1} th), d_k = 4^k k!^2/(2k+1)!;
    th = atan(sqrt(f/nu)). ``src`` has columns keys..., f, nu."""
    k = ", ".join(keys)
    kt = ", ".join(f"t.{x}" for x in keys)
    return f"""
{out}_th AS (SELECT {k}, f, nu, atan(sqrt(greatest(f, 0) / nu)) AS th FROM {src}),
{out}_terms AS (SELECT {k}, nu, th, unnest(range(0, CAST(CASE WHEN nu % 2 = 0 THEN nu // 2 ELSE (nu - 1) // 2 END AS BIGINT))) AS kk
  FROM {out}_th WHERE f IS NOT NULL),
{out}_sum AS (SELECT {k}, sum(CASE WHEN nu % 2 = 0 THEN exp(lgamma(kk + 0.5) - lgamma(0.5) - lgamma(kk + 1)) * pow(cos(th), 2 * kk)
    ELSE exp(2 * kk * ln(2) + 2 * lgamma(kk + 1) - lgamma(2 * kk + 2)) * pow(cos(th), 2 * kk + 1) END) AS ssum
  FROM {out}_terms GROUP BY ALL),
{out} AS (SELECT {kt}, least(greatest(1 - CASE WHEN t.nu % 2 = 0 THEN sin(t.th) * coalesce(s.ssum, 0)
    ELSE 2 / pi() * (t.th + sin(t.th) * coalesce(s.ssum, 0)) END, 0.0), 1.0) AS p
  FROM {out}_th t LEFT JOIN {out}_sum s USING ({k}))"""


# =============================================================== 2.4 / 2.5 calendar panels ====
@register("A5_weekly_rollup", f"WITH {D.LW_SQL} SELECT * FROM lw",
          doubles=("l_discount", "l_tax", "l_quantity", "l_extendedprice"), digits=6)
def q_a5(spark, sf):
    return D.lineitem_weekly(spark, sf)


@register("A5_weekly_rollup_gaps", f"WITH {D.NW_SQL} SELECT * FROM nw", doubles=tuple(D.NW_MEASURES), digits=6)
def q_a5_gaps(spark, sf):
    return D.nation_weekly(spark, sf)


@register("A5_weekly_first_nonnull", f"WITH {D.OF_SQL} SELECT * FROM of", doubles=("o_totalprice",), digits=6)
def q_a5_first(spark, sf):
    return D.orders_weekly_first(spark, sf)


@register("W1_hourly_grid", f"WITH {D.EH_SQL} SELECT * FROM eh", doubles=("value",), digits=8)
def q_w1(spark, sf):
    return D.events_hourly(spark, sf)


@register("J3_exact_reindex", """
WITH h AS (SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) AS ts, avg(value) AS value FROM events GROUP BY ALL),
g AS (SELECT event_type, lo, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts
  FROM (SELECT event_type, min(ts) AS lo, max(ts) AS hi FROM h GROUP BY ALL) b)
SELECT g.event_type, CAST(date_diff('hour', g.lo, g.ts) AS BIGINT) AS t, g.ts, h.value
FROM g LEFT JOIN h USING (event_type, ts)""", doubles=("value",), digits=8)
def q_j3(spark, sf):
    """Readings of each half hour put on the exact hourly grid of their first stamp: those on the other
    half hour are off the grid and dropped."""
    from panelcast.operators.resample import hourly_grid
    ev = read_test_table(spark, sf, "events")
    c = F.col("ts")
    half = F.date_trunc("hour", c) + F.make_interval(mins=F.floor(F.minute(c) / 30).cast("int") * 30)
    seen = ev.groupBy("event_type", half.cast(dict(ev.dtypes)["ts"]).alias("ts")).agg(F.avg("value").alias("value"))
    return hourly_grid(seen, ["event_type"], "ts", ["value"], mode="exact")


_INTERP_SQL = """
ehp AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS pos FROM eh),
ehi AS (SELECT event_type, t, ts, value AS v, pos,
  last_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
  last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pi,
  first_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
  first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni
  FROM ehp)"""


@register("W2_interpolate", f"""WITH {D.EH_SQL}, {_INTERP_SQL}
SELECT event_type, t, ts, coalesce(v, pv + (nv - pv) * (pos - pi) / (ni - pi), pv, nv) AS value FROM ehi""",
          doubles=("value",), digits=8)
def q_w2(spark, sf):
    return interp.interpolate_linear(D.events_hourly(spark, sf), ["event_type"], ["ts"], ["value"], position="t")


@register("W3_ffill_bfill", f"""WITH {D.EH_SQL}, {_INTERP_SQL}
SELECT event_type, t, ts, coalesce(pv, nv) AS value FROM ehi""", doubles=("value",), digits=8)
def q_w3(spark, sf):
    return interp.ffill_bfill(D.events_hourly(spark, sf), ["event_type"], ["ts"], ["value"], position="t")


@register("W4_zero_fill", f"WITH {D.EH_SQL} SELECT event_type, t, ts, coalesce(value, 0.0) AS value FROM eh",
          doubles=("value",), digits=8)
def q_w4(spark, sf):
    return interp.zero_fill(D.events_hourly(spark, sf), ["value"])


_RANK_SQL = """
rk_g AS (SELECT n_name, count(*) AS Total_Records,
    count(*) FILTER (WHERE INF_A IS NULL) AS INF_A_NaN_Count,
    count(*) FILTER (WHERE INF_B IS NULL) AS INF_B_NaN_Count,
    count(*) FILTER (WHERE INF_ALL IS NULL) AS INF_ALL_NaN_Count
  FROM nw WHERE n_name IS NOT NULL GROUP BY n_name),
rk_t AS (SELECT *, INF_A_NaN_Count + INF_B_NaN_Count + INF_ALL_NaN_Count AS Total_NaN_Count FROM rk_g),
rk_p AS (SELECT *, round_even(Total_NaN_Count / (Total_Records * 3) * 100, 2) AS NaN_Percentage FROM rk_t),
rk AS (SELECT row_number() OVER (ORDER BY Total_NaN_Count, n_name) AS Rank, n_name, Total_Records,
    INF_A_NaN_Count, INF_B_NaN_Count, INF_ALL_NaN_Count, Total_NaN_Count, NaN_Percentage,
    round_even(100 - NaN_Percentage, 2) AS Data_Quality_Score FROM rk_p)"""


def _ranking(spark, sf):
    return quality.null_count_ranking(D.nation_weekly(spark, sf), ["n_name"], D.NW_MEASURES)


@register("A1_A2_A3_W5_null_ranking", f"WITH {D.NW_SQL}, {_RANK_SQL} SELECT * FROM rk",
          doubles=("NaN_Percentage", "Data_Quality_Score"))
def q_rank(spark, sf):
    return _ranking(spark, sf)


@register("A9_quality_buckets", f"""WITH {D.NW_SQL}, {_RANK_SQL}
SELECT count(*) FILTER (WHERE Data_Quality_Score > 90) AS excellent,
  count(*) FILTER (WHERE Data_Quality_Score > 75 AND Data_Quality_Score <= 90) AS good,
  count(*) FILTER (WHERE Data_Quality_Score > 50 AND Data_Quality_Score <= 75) AS fair,
  count(*) FILTER (WHERE Data_Quality_Score <= 50) AS poor,
  avg(Data_Quality_Score) AS mean_score, median(Data_Quality_Score) AS median_score FROM rk""",
          doubles=("mean_score", "median_score"))
def q_a9(spark, sf):
    return quality.quality_buckets(_ranking(spark, sf))


@register("A4_global_stats", f"""WITH {D.NW_SQL}, {_RANK_SQL}
SELECT min(Data_Quality_Score) AS min, max(Data_Quality_Score) AS max, avg(Data_Quality_Score) AS mean,
  median(Data_Quality_Score) AS median, count(DISTINCT n_name) AS n_distinct FROM rk""",
          doubles=("min", "max", "mean", "median"))
def q_a4(spark, sf):
    return quality.global_stats(_ranking(spark, sf), "Data_Quality_Score", "n_name")


TOP_K = 10


@register("O2_top_k", f"WITH {D.NW_SQL}, {_RANK_SQL} SELECT * FROM rk ORDER BY Rank LIMIT {TOP_K}",
          doubles=("NaN_Percentage", "Data_Quality_Score"))
def q_o2(spark, sf):
    return quality.top_k(_ranking(spark, sf), TOP_K, ["Rank"])


@register("O2_bottom_k", f"WITH {D.NW_SQL}, {_RANK_SQL} SELECT * FROM rk ORDER BY Rank DESC LIMIT {TOP_K}",
          doubles=("NaN_Percentage", "Data_Quality_Score"))
def q_o2b(spark, sf):
    return quality.bottom_k(_ranking(spark, sf), TOP_K, ["Rank"])


def _top_rows(spark, sf):
    top = quality.top_k(_ranking(spark, sf), TOP_K, ["Rank"])
    return quality.keep_keys(D.nation_weekly(spark, sf), top, ["n_name"])


_TOP_SQL = f"""top AS (SELECT n_name FROM rk ORDER BY Rank LIMIT {TOP_K}),
nt AS (SELECT * FROM nw WHERE n_name IN (SELECT n_name FROM top))"""


@register("P5_J4_top_semi_join", f"WITH {D.NW_SQL}, {_RANK_SQL}, {_TOP_SQL} SELECT * FROM nt",
          doubles=tuple(D.NW_MEASURES), digits=6)
def q_p5(spark, sf):
    return _top_rows(spark, sf)


def _top_interpolated(spark, sf):
    rows = _top_rows(spark, sf)
    return interp.fill_gaps(rows, ["n_name"], ["week"], D.NW_MEASURES, round_digits=0, position="t")


def _linear_sql(c: str, key: str) -> str:
    """A column interpolated by ``pos`` along its key, both ends with the nearest value."""
    back = f"PARTITION BY {key} ORDER BY iso_year, iso_week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    on = f"PARTITION BY {key} ORDER BY iso_year, iso_week ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    pv, nv = f"last_value({c} IGNORE NULLS) OVER ({back})", f"first_value({c} IGNORE NULLS) OVER ({on})"
    pi = f"last_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER ({back})"
    ni = f"first_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER ({on})"
    return f"coalesce({c}, {pv} + ({nv} - {pv}) * (pos - {pi}) / ({ni} - {pi}), {pv}, {nv})"


def _nw_interp_sql() -> str:
    cols = [f"coalesce(round_even({_linear_sql(c, 'n_name')}, 0), 0.0) AS {c}" for c in D.NW_MEASURES]
    rest = ["n_name", "week", "t", "iso_year", "iso_week", "isoyw"]
    return f"""ntp AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY iso_year, iso_week) AS pos FROM nt),
ni AS (SELECT {', '.join(rest)}, {', '.join(cols)} FROM ntp)"""


@register("W2_W3_W4_top_interpolated", f"WITH {D.NW_SQL}, {_RANK_SQL}, {_TOP_SQL}, {_nw_interp_sql()} SELECT * FROM ni",
          doubles=tuple(D.NW_MEASURES), digits=2)
def q_top_interp(spark, sf):
    return _top_interpolated(spark, sf)


@register("A11_null_totals", f"""WITH {D.NW_SQL}, {_RANK_SQL}, {_TOP_SQL}, {_nw_interp_sql()}
SELECT count(*) FILTER (WHERE INF_A IS NULL) AS INF_A_nulls, count(*) FILTER (WHERE INF_B IS NULL) AS INF_B_nulls,
  count(*) FILTER (WHERE INF_ALL IS NULL) AS INF_ALL_nulls,
  count(*) FILTER (WHERE INF_A IS NULL) + count(*) FILTER (WHERE INF_B IS NULL) + count(*) FILTER (WHERE INF_ALL IS NULL) AS total_nulls,
  'before' AS stage FROM nt
UNION ALL
SELECT count(*) FILTER (WHERE INF_A IS NULL), count(*) FILTER (WHERE INF_B IS NULL), count(*) FILTER (WHERE INF_ALL IS NULL),
  count(*) FILTER (WHERE INF_A IS NULL) + count(*) FILTER (WHERE INF_B IS NULL) + count(*) FILTER (WHERE INF_ALL IS NULL),
  'after' FROM ni""")
def q_a11(spark, sf):
    before = quality.null_totals(_top_rows(spark, sf), D.NW_MEASURES, "before")
    after = quality.null_totals(_top_interpolated(spark, sf), D.NW_MEASURES, "after")
    return before.unionByName(after)


@register("A8_completeness", f"""WITH {D.NW_SQL}
SELECT n_name, count(*) AS Records, round(count(INF_A) / count(*) * 100, 1) AS INF_A_complete_pct,
  round(count(INF_B) / count(*) * 100, 1) AS INF_B_complete_pct, round(count(INF_ALL) / count(*) * 100, 1) AS INF_ALL_complete_pct
FROM nw GROUP BY n_name""", doubles=("INF_A_complete_pct", "INF_B_complete_pct", "INF_ALL_complete_pct"))
def q_a8(spark, sf):
    return quality.completeness(D.nation_weekly(spark, sf), ["n_name"], D.NW_MEASURES)


@register("A6_nan_summary", f"""WITH {D.NW_SQL}
SELECT 'INF_A' AS column, count(*) FILTER (WHERE INF_A IS NULL) AS NaN_count, count(*) FILTER (WHERE INF_A IS NULL) / count(*) AS NaN_fraction FROM nw
UNION ALL SELECT 'INF_B', count(*) FILTER (WHERE INF_B IS NULL), count(*) FILTER (WHERE INF_B IS NULL) / count(*) FROM nw
UNION ALL SELECT 'INF_ALL', count(*) FILTER (WHERE INF_ALL IS NULL), count(*) FILTER (WHERE INF_ALL IS NULL) / count(*) FROM nw
UNION ALL SELECT 'n_name', count(*) FILTER (WHERE n_name IS NULL), count(*) FILTER (WHERE n_name IS NULL) / count(*) FROM nw
UNION ALL SELECT 'week', count(*) FILTER (WHERE week IS NULL), count(*) FILTER (WHERE week IS NULL) / count(*) FROM nw""",
          doubles=("NaN_fraction",))
def q_a6(spark, sf):
    return quality.nan_summary(D.nation_weekly(spark, sf), ["INF_A", "INF_B", "INF_ALL", "n_name", "week"])


@register("A15_column_minimums", f"WITH {D.NW_SQL} SELECT min(INF_A) AS INF_A, min(INF_B) AS INF_B, min(INF_ALL) AS INF_ALL FROM nw",
          doubles=tuple(D.NW_MEASURES))
def q_a15(spark, sf):
    return quality.column_minimums(D.nation_weekly(spark, sf), D.NW_MEASURES)


@register("A7_weekly_mean_by_isoweek", f"""WITH {D.EH_SQL}
SELECT CAST(isoyear(ts) AS INTEGER) AS iso_year, CAST(week(ts) AS INTEGER) AS iso_week, avg(value) AS value FROM eh GROUP BY ALL""",
          doubles=("value",), digits=8)
def q_a7(spark, sf):
    eh = D.events_hourly(spark, sf)
    return eh.groupBy(S.iso_year("ts").alias("iso_year"), S.iso_week("ts").alias("iso_week")).agg(F.avg("value").alias("value"))


_OW_SQL = f"""ow AS (SELECT CAST(isoyear({D.week_end_sql('o_orderdate')}) AS INTEGER) AS iso_year,
  CAST(week({D.week_end_sql('o_orderdate')}) AS INTEGER) AS iso_week, avg(o_totalprice) AS o_totalprice FROM orders GROUP BY ALL)"""


def _orders_weekly_mean(spark, sf):
    o = read_test_table(spark, sf, "orders")
    wk = S.week_end_monday("o_orderdate")
    return o.groupBy(S.iso_year(wk).alias("iso_year"), S.iso_week(wk).alias("iso_week")).agg(
        F.avg("o_totalprice").alias("o_totalprice"))


@register("J1_weekly_join", f"""WITH {D.LW_SQL}, {_OW_SQL}
SELECT l_returnflag, week, iso_year, iso_week, l_quantity, o_totalprice FROM lw JOIN ow USING (iso_year, iso_week)""",
          doubles=("l_quantity", "o_totalprice"), digits=8)
def q_j1(spark, sf):
    from panelcast.operators.joins import join_many_to_one
    lw = D.lineitem_weekly(spark, sf).select("l_returnflag", "week", "iso_year", "iso_week", "l_quantity")
    return join_many_to_one(lw, _orders_weekly_mean(spark, sf), ["iso_year", "iso_week"], validate="plan")


# =============================================================== 2.2 projections / filters ====
@register("P1_P2_P9_select_drop_rename",
          "SELECT l_orderkey, l_returnflag, l_quantity AS qty FROM lineitem", doubles=("qty",))
def q_p1(spark, sf):
    from panelcast.sources.readers import select_present
    li = read_test_table(spark, sf, "lineitem")
    kept = select_present(li, ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "not_a_column"])
    return kept.drop("l_linenumber", "not_a_column").withColumnsRenamed({"l_quantity": "qty"})


@register("P3_year_filter", """SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem
WHERE TRY_CAST(CAST(year(l_shipdate) AS VARCHAR) AS INTEGER) >= 1998""")
def q_p3(spark, sf):
    li = read_test_table(spark, sf, "lineitem")
    return (li.withColumn("Year", F.year("l_shipdate").cast("string"))
            .filter(S.lenient_int("Year") >= 1998).select("l_orderkey", "l_linenumber", "l_shipdate"))


@register("P4_upper_equality", "SELECT c_custkey, c_name FROM customer WHERE upper(lower(c_mktsegment)) = 'BUILDING'")
def q_p4(spark, sf):
    from panelcast.operators.filters import filter_upper_equals
    c = read_test_table(spark, sf, "customer").withColumn("c_mktsegment", F.lower("c_mktsegment"))
    return filter_upper_equals(c, "c_mktsegment", "building").select("c_custkey", "c_name")


@register("P6_dropna_subset", f"WITH {D.EH_SQL} SELECT * FROM eh WHERE value IS NOT NULL", doubles=("value",), digits=8)
def q_p6(spark, sf):
    return D.events_hourly(spark, sf).dropna(subset=["value"])


@register("P7_dropna_any", f"WITH {D.NW_SQL} SELECT * FROM nw WHERE INF_A IS NOT NULL AND INF_B IS NOT NULL AND INF_ALL IS NOT NULL",
          doubles=tuple(D.NW_MEASURES), digits=6)
def q_p7(spark, sf):
    return D.nation_weekly(spark, sf).dropna("any")


# =============================================================== 2.7 scalar functions ========
@register("F1_F3_lenient_parse_scale", """SELECT event_type,
  sum(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS k_sum,
  count(TRY_CAST(props AS DOUBLE)) AS bad_parsed, avg(TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) / 10.0) AS value_scaled
FROM events GROUP BY event_type""", doubles=("k_sum", "value_scaled"))
def q_f1(spark, sf):
    ev = read_test_table(spark, sf, "events")
    return ev.groupBy("event_type").agg(
        F.sum(S.lenient_double(F.get_json_object("props", "$.k"))).alias("k_sum"),
        F.count(S.lenient_double("props")).cast("bigint").alias("bad_parsed"),
        F.avg(S.scale(F.col("value").cast("string"), 10.0)).alias("value_scaled"))


@register("F2_timestamp_parts", """SELECT event_id,
  make_timestamp(year(ts), month(ts), day(ts), hour(ts), minute(ts), 0) AS ts_minute,
  TRY(make_timestamp(year(ts), month(ts) + 12, day(ts), hour(ts), minute(ts), 0)) AS ts_bad FROM events""")
def q_f2(spark, sf):
    ev = read_test_table(spark, sf, "events")
    parts = [F.year("ts"), F.month("ts"), F.dayofmonth("ts"), F.hour("ts"), F.minute("ts")]
    bad = [F.year("ts"), F.month("ts") + 12, F.dayofmonth("ts"), F.hour("ts"), F.minute("ts")]
    return ev.select("event_id", S.timestamp_from_parts(*[p.cast("string") for p in parts]).alias("ts_minute"),
                     S.timestamp_from_parts(*[p.cast("string") for p in bad]).alias("ts_bad"))


@register("F4_iso_week", f"""SELECT DISTINCT CAST(l_shipdate AS DATE) AS d, CAST(isoyear(l_shipdate) AS INTEGER) AS iso_year,
  CAST(week(l_shipdate) AS INTEGER) AS iso_week, CAST(isoyear(l_shipdate) * 100 + week(l_shipdate) AS INTEGER) AS isoyw,
  {D.week_end_sql('l_shipdate')} AS week_end, CAST(date_trunc('week', CAST(l_shipdate AS DATE)) AS DATE) AS week_start FROM lineitem""")
def q_f4(spark, sf):
    li = read_test_table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct()
    return li.select("d", S.iso_year("d").alias("iso_year"), S.iso_week("d").alias("iso_week"),
                     S.iso_year_week("d").alias("isoyw"), S.week_end_monday("d").alias("week_end"),
                     S.week_start_monday("d").alias("week_start"))


@register("F5_F6_log_round", f"""WITH {D.LW_SQL}
SELECT l_returnflag, t, ln(1 + l_quantity) AS log_qty, round_even(l_quantity / 2, 0) AS half_qty_even,
  round_even(l_extendedprice, -3) AS price_k FROM lw""", doubles=("log_qty", "half_qty_even", "price_k"))
def q_f5(spark, sf):
    lw = D.lineitem_weekly(spark, sf)
    return lw.select("l_returnflag", "t", S.log1p("l_quantity").alias("log_qty"),
                     S.round_half_even(F.col("l_quantity") / 2, 0).alias("half_qty_even"),
                     S.round_half_even("l_extendedprice", -3).alias("price_k"))


@register("F7_date_format_parse", f"""WITH {D.LW_SQL}
SELECT l_returnflag, t, strftime(week, '%Y-%m-%d') AS week_str, CAST(strptime(strftime(week, '%Y-%m-%d'), '%Y-%m-%d') AS DATE) AS week_back FROM lw""")
def q_f7(spark, sf):
    lw = D.lineitem_weekly(spark, sf)
    s = S.format_date("week")
    return lw.select("l_returnflag", "t", s.alias("week_str"), S.parse_date(s).alias("week_back"))


@register("F8_log_names", "SELECT DISTINCT p_type, 'LOG_' || upper(replace(p_type, ' ', '_')) AS log_name FROM part")
def q_f8(spark, sf):
    p = read_test_table(spark, sf, "part").select("p_type").distinct()
    return p.select("p_type", S.log_name_expr("p_type").alias("log_name"))


@register("F9_f_upper_tail", f"""WITH {D.LW_SQL}
SELECT l_returnflag, t, pow(1 + 2 * (l_quantity / 1000) / (t + 5), -(t + 5) / 2) AS p FROM lw""", doubles=("p",), digits=9)
def q_f9(spark, sf):
    lw = D.lineitem_weekly(spark, sf)
    return lw.select("l_returnflag", "t", f_upper_tail(F.col("l_quantity") / 1000, 2.0, F.col("t") + 5).alias("p"))


@register("F10_F11_F12_labels", f"""WITH {D.LW_SQL}
SELECT l_returnflag, t,
  CASE WHEN l_quantity / 400 < 5 THEN 'OK' WHEN l_quantity / 400 < 10 THEN 'Moderate' ELSE 'High' END AS vif_class,
  CASE WHEN l_tax < 0.04 AND l_discount < 0.05 THEN 'Stationary' WHEN l_tax < 0.04 OR l_discount < 0.05 THEN 'Partially stationary'
       ELSE 'Non-stationary' END AS stationarity,
  CASE WHEN l_discount >= 0.05 THEN 'Linear' ELSE 'Non-linear' END AS linearity,
  l_discount < 0.05 AS significant, least(greatest(l_discount * 20 - 0.5, 0.0), 1.0) AS clamped FROM lw""",
          doubles=("clamped",))
def q_f10(spark, sf):
    lw = D.lineitem_weekly(spark, sf)
    return lw.select("l_returnflag", "t", S.vif_class(F.col("l_quantity") / 400).alias("vif_class"),
                     S.stationarity_class(F.col("l_tax") < 0.04, F.col("l_discount") < 0.05).alias("stationarity"),
                     S.linearity_class(F.col("l_discount") >= 0.05).alias("linearity"),
                     S.significant("l_discount", 0.05).alias("significant"),
                     S.clamp_p(F.col("l_discount") * 20 - 0.5).alias("clamped"))


@register("F13_quantile", """SELECT l_returnflag, quantile_cont(l_extendedprice, 0.025) AS q025, quantile_cont(l_extendedprice, 0.5) AS q500,
  quantile_cont(l_extendedprice, 0.975) AS q975, min(l_extendedprice) AS q_low, max(l_extendedprice) AS q_high FROM lineitem GROUP BY l_returnflag""",
          doubles=("q025", "q500", "q975", "q_low", "q_high"), digits=4)
def q_f13(spark, sf):
    li = read_test_table(spark, sf, "lineitem")
    wanted = {"q025": 0.025, "q500": 0.5, "q975": 0.975, "q_low": -1, "q_high": 2}
    return quality.quantiles(li, ["l_returnflag"], "l_extendedprice", wanted)


# =============================================================== 2.6 reshapes ================
@register("O4_unpivot", f"""WITH {D.LW_SQL}
SELECT l_returnflag, t, 'l_quantity' AS variable, l_quantity AS value FROM lw
UNION ALL SELECT l_returnflag, t, 'l_discount', l_discount FROM lw
UNION ALL SELECT l_returnflag, t, 'l_tax', l_tax FROM lw""", doubles=("value",))
def q_o4(spark, sf):
    lw = D.lineitem_weekly(spark, sf)
    return reshape.to_long(lw, ["l_returnflag", "t"], ["l_quantity", "l_discount", "l_tax"])


@register("W8_last_30_weeks", f"""WITH {D.LW_SQL},
n AS (SELECT l_returnflag, week, row_number() OVER (PARTITION BY l_returnflag ORDER BY week) AS week_no,
  row_number() OVER (PARTITION BY l_returnflag ORDER BY week DESC) AS rd FROM lw)
SELECT l_returnflag, week, week_no FROM n WHERE rd <= 30""")
def q_w8(spark, sf):
    lw = reshape.relative_week(D.lineitem_weekly(spark, sf), ["l_returnflag"], "week")
    return reshape.last_n(lw, ["l_returnflag"], "week", 30).select("l_returnflag", "week", "week_no")


# =============================================================== 2.8 model layer =============
from panelcast.operators import diagnostics as DG  # noqa: E402
from panelcast.operators.bootstrap import bootstrap_granger, bootstrap_irf, simulate_series  # noqa: E402
from panelcast.operators.forecast import forecast  # noqa: E402
from panelcast.operators.granger import granger_matrix  # noqa: E402
from panelcast.operators.irf import cumulative_impact, irf  # noqa: E402
from panelcast.operators.var import fit_var  # noqa: E402
from panelcast.sources.sinks import forecast_wide, irf_wide  # noqa: E402
from panelcast.spec import Det, VarSpec  # noqa: E402

K1 = ["qty"]
K2 = ["qty", "disc"]


def _panel(spark, sf):
    lw = D.lineitem_weekly(spark, sf)
    return lw.select(F.col("l_returnflag").alias("series_id"), "t", F.col("l_quantity").alias("qty"),
                     F.col("l_discount").alias("disc"))


def _model(spark, sf, variables, lags=1):
    panel = _panel(spark, sf)
    return panel, fit_var(panel.select("series_id", "t", *variables), variables, VarSpec(lags, Det.CONST))


_LV_SQL = D.LW_SQL + """,
lv AS (SELECT l_returnflag AS series_id, t, l_quantity AS qty, l_discount AS disc,
  lag(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY t) AS qty1,
  lag(l_discount) OVER (PARTITION BY l_returnflag ORDER BY t) AS disc1 FROM lw),
bad1 AS (SELECT DISTINCT series_id FROM lv WHERE qty IS NULL),
bad2 AS (SELECT DISTINCT series_id FROM lv WHERE qty IS NULL OR disc IS NULL),
lr AS (SELECT * FROM lv WHERE t >= 1 AND series_id NOT IN (SELECT series_id FROM bad1)),
lr2 AS (SELECT * FROM lv WHERE t >= 1 AND series_id NOT IN (SELECT series_id FROM bad2)),
k1 AS (SELECT series_id, count(*) AS n, regr_intercept(qty, qty1) AS a, regr_slope(qty, qty1) AS b,
  regr_syy(qty, qty1) - regr_sxy(qty, qty1) * regr_sxy(qty, qty1) / regr_sxx(qty, qty1) AS rss FROM lr GROUP BY series_id),
k2m AS (SELECT series_id, count(*) AS n, avg(qty1) AS m1, avg(disc1) AS m2, avg(qty) AS mq, avg(disc) AS md FROM lr2 GROUP BY series_id),
k2s AS (SELECT series_id, any_value(n) AS n, any_value(m1) AS m1, any_value(m2) AS m2, any_value(mq) AS mq, any_value(md) AS md,
  sum((qty1 - m1) * (qty1 - m1)) AS s11, sum((qty1 - m1) * (disc1 - m2)) AS s12, sum((disc1 - m2) * (disc1 - m2)) AS s22,
  sum((qty1 - m1) * (qty - mq)) AS s1q, sum((disc1 - m2) * (qty - mq)) AS s2q,
  sum((qty1 - m1) * (disc - md)) AS s1d, sum((disc1 - m2) * (disc - md)) AS s2d,
  sum((qty - mq) * (qty - mq)) AS sqq, sum((qty - mq) * (disc - md)) AS sqd, sum((disc - md) * (disc - md)) AS sdd
  FROM lr2 JOIN k2m USING (series_id) GROUP BY series_id),
k2b AS (SELECT *, (s1q * s22 - s2q * s12) / (s11 * s22 - s12 * s12) AS bq1, (s2q * s11 - s1q * s12) / (s11 * s22 - s12 * s12) AS bq2,
  (s1d * s22 - s2d * s12) / (s11 * s22 - s12 * s12) AS bd1, (s2d * s11 - s1d * s12) / (s11 * s22 - s12 * s12) AS bd2 FROM k2s),
k2 AS (SELECT *, mq - bq1 * m1 - bq2 * m2 AS aq, md - bd1 * m1 - bd2 * m2 AS ad,
  (sqq - bq1 * s1q - bq2 * s2q) / (n - 3) AS sig_qq, (sqd - bq1 * s1d - bq2 * s2d) / (n - 3) AS sig_qd,
  (sdd - bd1 * s1d - bd2 * s2d) / (n - 3) AS sig_dd FROM k2b),
chol AS (SELECT *, sqrt(sig_qq) AS l11, sig_qd / sqrt(sig_qq) AS l21, sqrt(sig_dd - sig_qd * sig_qd / sig_qq) AS l22 FROM k2)"""

_COEF_DIG = 6


@register("T1_var_k1", f"""WITH {_LV_SQL}
SELECT series_id, 'qty' AS equation, 'const' AS term, 0 AS lag, '' AS variable, a AS value FROM k1
UNION ALL SELECT series_id, 'qty', 'lag', 1, 'qty', b FROM k1""", doubles=("value",), digits=9, sig=True)
def q_t1(spark, sf):
    return _model(spark, sf, K1)[1].coefficients()


@register("T1_T3_var_k2", f"""WITH {_LV_SQL}
SELECT series_id, 'qty' AS equation, 'const' AS term, 0 AS lag, '' AS variable, aq AS value FROM k2
UNION ALL SELECT series_id, 'disc', 'const', 0, '', ad FROM k2
UNION ALL SELECT series_id, 'qty', 'lag', 1, 'qty', bq1 FROM k2
UNION ALL SELECT series_id, 'disc', 'lag', 1, 'qty', bd1 FROM k2
UNION ALL SELECT series_id, 'qty', 'lag', 1, 'disc', bq2 FROM k2
UNION ALL SELECT series_id, 'disc', 'lag', 1, 'disc', bd2 FROM k2""", doubles=("value",), digits=9, sig=True)
def q_t1k2(spark, sf):
    return _model(spark, sf, K2)[1].coefficients()


@register("A13_gram_k1", f"""WITH {_LV_SQL}
SELECT series_id, 0 AS i, 0 AS j, CAST(count(*) AS DOUBLE) AS value FROM lr GROUP BY series_id
UNION ALL SELECT series_id, 0, 1, sum(qty1) FROM lr GROUP BY series_id
UNION ALL SELECT series_id, 0, 2, sum(qty) FROM lr GROUP BY series_id
UNION ALL SELECT series_id, 1, 1, sum(qty1 * qty1) FROM lr GROUP BY series_id
UNION ALL SELECT series_id, 1, 2, sum(qty1 * qty) FROM lr GROUP BY series_id
UNION ALL SELECT series_id, 2, 2, sum(qty * qty) FROM lr GROUP BY series_id""", doubles=("value",), digits=9, sig=True)
def q_a13(spark, sf):
    return _model(spark, sf, K1)[1].gram()


@register("A14_sigma_k2", f"""WITH {_LV_SQL}
SELECT series_id, 'qty' AS row, 'qty' AS col, sig_qq AS value FROM k2
UNION ALL SELECT series_id, 'qty', 'disc', sig_qd FROM k2
UNION ALL SELECT series_id, 'disc', 'qty', sig_qd FROM k2
UNION ALL SELECT series_id, 'disc', 'disc', sig_dd FROM k2""", doubles=("value",), digits=9, sig=True)
def q_a14(spark, sf):
    return _model(spark, sf, K2)[1].sigma()


@register("T4_residuals_k1", f"""WITH {_LV_SQL}
SELECT series_id, t, qty - a - b * qty1 AS qty FROM lr JOIN k1 USING (series_id)""", doubles=("qty",), digits=9, sig=True)
def q_t4(spark, sf):
    panel, m = _model(spark, sf, K1)
    return m.residuals(panel.select("series_id", "t", "qty"))


STEPS = 10


@register("T5_forecast_k1", f"""WITH RECURSIVE {_LV_SQL},
last AS (SELECT series_id, qty AS y FROM lv WHERE (series_id, t) IN (SELECT series_id, max(t) FROM lv GROUP BY series_id)),
fc AS (SELECT series_id, 0 AS step, y FROM last
  UNION ALL SELECT fc.series_id, fc.step + 1, k1.a + k1.b * fc.y FROM fc JOIN k1 USING (series_id) WHERE fc.step < {STEPS})
SELECT series_id, CAST(step AS INTEGER) AS step, 'qty' AS variable, y AS value FROM fc WHERE step >= 1""",
          doubles=("value",), digits=9, sig=True)
def q_t5(spark, sf):
    panel, m = _model(spark, sf, K1)
    return forecast(m, panel.select("series_id", "t", "qty"), STEPS)


_FC2_SQL = f"""
last2 AS (SELECT series_id, qty AS yq, disc AS yd FROM lv WHERE (series_id, t) IN (SELECT series_id, max(t) FROM lv GROUP BY series_id)),
fc2 AS (SELECT series_id, 0 AS step, yq, yd FROM last2
  UNION ALL SELECT fc2.series_id, fc2.step + 1, k2.aq + k2.bq1 * fc2.yq + k2.bq2 * fc2.yd, k2.ad + k2.bd1 * fc2.yq + k2.bd2 * fc2.yd
  FROM fc2 JOIN k2 USING (series_id) WHERE fc2.step < {STEPS})"""


@register("S7_forecast_wide_k2", f"""WITH RECURSIVE {_LV_SQL}, {_FC2_SQL}
SELECT series_id, CAST(step AS INTEGER) AS step, yq AS qty, yd AS disc FROM fc2 WHERE step >= 1""",
          doubles=("qty", "disc"), digits=9, sig=True)
def q_s7(spark, sf):
    panel, m = _model(spark, sf, K2)
    return forecast_wide(forecast(m, panel, STEPS), K2)


HORIZON = 12


@register("T6_irf_k1", f"""WITH {_LV_SQL}
SELECT series_id, 'qty' AS shock, 'qty' AS response, CAST(h AS INTEGER) AS horizon, pow(b, h) * sqrt(rss / (n - 2)) AS value,
  'cholesky' AS shock_kind FROM k1, range(0, {HORIZON}) r(h)""", doubles=("value",), digits=9, sig=True)
def q_t6(spark, sf):
    return irf(_model(spark, sf, K1)[1], HORIZON)


_PSI_SQL = f"""
psi AS (SELECT series_id, 0 AS h, 1.0::DOUBLE AS p11, 0.0::DOUBLE AS p12, 0.0::DOUBLE AS p21, 1.0::DOUBLE AS p22 FROM k2
  UNION ALL SELECT psi.series_id, psi.h + 1, k2.bq1 * psi.p11 + k2.bq2 * psi.p21, k2.bq1 * psi.p12 + k2.bq2 * psi.p22,
    k2.bd1 * psi.p11 + k2.bd2 * psi.p21, k2.bd1 * psi.p12 + k2.bd2 * psi.p22
  FROM psi JOIN k2 USING (series_id) WHERE psi.h < {HORIZON - 1}),
resp AS (SELECT series_id, CAST(h AS INTEGER) AS horizon, p11 * l11 + p12 * l21 AS qq, p12 * l22 AS qd,
    p21 * l11 + p22 * l21 AS dq, p22 * l22 AS dd FROM psi JOIN chol USING (series_id)),
irf2 AS (SELECT series_id, 'qty' AS shock, 'qty' AS response, horizon, qq AS value, 'cholesky' AS shock_kind FROM resp
  UNION ALL SELECT series_id, 'disc', 'qty', horizon, qd, 'cholesky' FROM resp
  UNION ALL SELECT series_id, 'qty', 'disc', horizon, dq, 'cholesky' FROM resp
  UNION ALL SELECT series_id, 'disc', 'disc', horizon, dd, 'cholesky' FROM resp)"""


@register("T6_irf_k2", f"WITH RECURSIVE {_LV_SQL}, {_PSI_SQL} SELECT * FROM irf2", doubles=("value",), digits=9, sig=True)
def q_t6k2(spark, sf):
    return irf(_model(spark, sf, K2)[1], HORIZON)


@register("T7_irf_response_k2", f"WITH RECURSIVE {_LV_SQL}, {_PSI_SQL} SELECT * FROM irf2 WHERE response = 'qty'",
          doubles=("value",), digits=9, sig=True)
def q_t7(spark, sf):
    return irf(_model(spark, sf, K2)[1], HORIZON).filter(F.col("response") == "qty")


@register("S8_irf_wide_k2", f"""WITH RECURSIVE {_LV_SQL}, {_PSI_SQL}
SELECT series_id, horizon, qq AS Shock_qty, qd AS Shock_disc FROM resp""", doubles=("Shock_qty", "Shock_disc"), digits=9, sig=True)
def q_s8(spark, sf):
    return irf_wide(irf(_model(spark, sf, K2)[1], HORIZON), K2, "qty")


@register("A10_cumulative_irf_k2", f"""WITH RECURSIVE {_LV_SQL}, {_PSI_SQL}
SELECT series_id, shock, response, sum(value) AS cumulative FROM irf2 GROUP BY ALL""", doubles=("cumulative",), digits=9, sig=True)
def q_a10(spark, sf):
    return cumulative_impact(irf(_model(spark, sf, K2)[1], HORIZON))


_GR_SQL = """
gr_src AS (SELECT series_id, 'disc' AS cause, 'qty' AS effect, (sqq - s1q * s1q / s11) - (sqq - bq1 * s1q - bq2 * s2q) AS num,
    sqq - bq1 * s1q - bq2 * s2q AS rss_u, n FROM k2
  UNION ALL SELECT series_id, 'qty', 'disc', (sdd - s2d * s2d / s22) - (sdd - bd1 * s1d - bd2 * s2d), sdd - bd1 * s1d - bd2 * s2d, n FROM k2),
gr_f AS (SELECT series_id, cause, effect, CASE WHEN greatest(num, 0) = 0 OR rss_u <= 0 THEN 0.0
    ELSE greatest(num, 0) / (rss_u / (n - 3)) END AS f, CAST(n - 3 AS BIGINT) AS nu FROM gr_src),""" + f1_tail_ctes("gr_f", ["series_id", "cause", "effect"], "gr_p") + """,
gr AS (SELECT series_id, cause, effect, f AS f_stat, gr_p.p AS p_value, 1 AS lags, 1 AS df_num, nu AS df_den,
  gr_p.p < 0.05 AS significant, 'ok' AS status FROM gr_f JOIN gr_p USING (series_id, cause, effect))"""


@register("T8_T9_granger_k2", f"WITH {_LV_SQL}, {_GR_SQL} SELECT * FROM gr", doubles=("f_stat", "p_value"), digits=8, sig=True)
def q_t8(spark, sf):
    return granger_matrix(_model(spark, sf, K2)[1])


@register("O7_granger_labels", f"""WITH {_LV_SQL}, {_GR_SQL}
SELECT *, CASE WHEN significant THEN 'GC' ELSE '' END AS label FROM gr""", doubles=("f_stat", "p_value"), digits=8, sig=True)
def q_o7(spark, sf):
    return reshape.granger_labels(granger_matrix(_model(spark, sf, K2)[1]))


REPS_SIM, SEED = 500, 7


@register("T10_simulate_k1", f"""WITH RECURSIVE {_LV_SQL},
res AS (SELECT series_id, t - 1 AS i, qty - a - b * qty1 AS u FROM lr JOIN k1 USING (series_id)),
nreg AS (SELECT series_id, count(*) AS nr FROM res GROUP BY series_id),
idx AS (SELECT series_id, rep, i, CAST(('0x' || substr(md5(concat_ws(':', {SEED}, series_id, rep, i)), 1, 8))::BIGINT % nr AS BIGINT) AS j
  FROM (SELECT series_id, nr, rep, unnest(range(0, nr)) AS i FROM nreg, range(0, {REPS_SIM}) rr(rep)) x),
eps AS (SELECT idx.series_id, idx.rep, idx.i, res.u FROM idx JOIN res ON idx.series_id = res.series_id AND idx.j = res.i),
sim AS (SELECT lv.series_id, rr.rep, 0 AS t, lv.qty AS y FROM lv, range(0, {REPS_SIM}) rr(rep) WHERE lv.t = 0
  UNION ALL SELECT sim.series_id, sim.rep, sim.t + 1, k1.a + k1.b * sim.y + eps.u
  FROM sim JOIN k1 USING (series_id) JOIN eps ON eps.series_id = sim.series_id AND eps.rep = sim.rep AND eps.i = sim.t)
SELECT series_id, CAST(rep AS INTEGER) AS rep, CAST(t AS BIGINT) AS t, y AS qty FROM sim""", doubles=("qty",), digits=9, sig=True)
def q_t10(spark, sf):
    panel, m = _model(spark, sf, K1)
    return simulate_series(m, panel.select("series_id", "t", "qty"), REPS_SIM, SEED)


@register("T13_summary_k2", f"""WITH {D.LW_SQL},
s AS (SELECT l_returnflag AS series_id, count(*) AS n, count(*) FILTER (WHERE l_quantity IS NULL OR l_discount IS NULL) AS nulls
  FROM lw GROUP BY l_returnflag)
SELECT series_id, 2 AS k, 1 AS lags, 1 AS det, n AS n_obs, n - 1 AS n_reg, 4 AS n_lag_params, 2 AS c_rows, 1 AS c_cols,
  3 AS n_params, CASE WHEN nulls = 0 THEN CAST(n - 1 - 3 AS DOUBLE) END AS df_resid,
  CASE WHEN nulls = 0 THEN 'ok' ELSE 'null_input' END AS status, CASE WHEN nulls = 0 THEN 'normal' END AS solver FROM s""")
def q_t13(spark, sf):
    return _model(spark, sf, K2)[1].summary()


@register("O6_history_forecast_k1", f"""WITH RECURSIVE {_LV_SQL},
last AS (SELECT series_id, qty AS y FROM lv WHERE (series_id, t) IN (SELECT series_id, max(t) FROM lv GROUP BY series_id)),
fc AS (SELECT series_id, 0 AS step, y FROM last
  UNION ALL SELECT fc.series_id, fc.step + 1, k1.a + k1.b * fc.y FROM fc JOIN k1 USING (series_id) WHERE fc.step < {STEPS}),
h AS (SELECT series_id, t, qty, row_number() OVER (PARTITION BY series_id ORDER BY t DESC) AS rd FROM lv),
h30 AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY t) AS x, qty FROM h WHERE rd <= 30)
SELECT series_id, 'qty' AS variable, x, qty AS value, 'history' AS kind FROM h30
UNION ALL SELECT series_id, 'qty', 30 + step, y, 'forecast' FROM fc WHERE step >= 1""", doubles=("value",), digits=9, sig=True)
def q_o6(spark, sf):
    panel, m = _model(spark, sf, K1)
    p1 = panel.select("series_id", "t", "qty")
    hist = reshape.to_long(p1, ["series_id", "t"], ["qty"])
    return reshape.history_forecast_overlay(hist, forecast(m, p1, STEPS), 30)


# --------------------------------------------------------------- diagnostics -----------------
def _diag_long(spark, sf):
    lw = D.lineitem_weekly(spark, sf).withColumnRenamed("l_returnflag", "series_id")
    return DG.to_long_series(lw, ["l_quantity", "l_discount"], "series_id", "t")


_KL_SQL = """
kl AS (SELECT l_returnflag AS series_id, 'l_quantity' AS variable, t, l_quantity AS value FROM lw WHERE l_quantity IS NOT NULL
  UNION ALL SELECT l_returnflag, 'l_discount', t, l_discount FROM lw WHERE l_discount IS NOT NULL)"""

_KPSS_P = " ".join(
    [f"WHEN stat <= {DG.KPSS_CRIT[0]} THEN {DG.KPSS_PVAL[0]}"]
    + [f"WHEN stat <= {c1} THEN {p0} + (stat - {c0}) * (({p1} - {p0}) / ({c1} - {c0}))"
       for (c0, c1), (p0, p1) in zip(zip(DG.KPSS_CRIT, DG.KPSS_CRIT[1:]), zip(DG.KPSS_PVAL, DG.KPSS_PVAL[1:]))]
    + [f"ELSE {DG.KPSS_PVAL[-1]}"])


@register("T15_kpss_lag1", f"""WITH {D.LW_SQL}, {_KL_SQL},
ke AS (SELECT series_id, variable, t, value - avg(value) OVER (PARTITION BY series_id, variable) AS e,
  count(*) OVER (PARTITION BY series_id, variable) AS n FROM kl),
ks AS (SELECT *, sum(e) OVER (PARTITION BY series_id, variable ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s,
  lag(e) OVER (PARTITION BY series_id, variable ORDER BY t) AS e1 FROM ke),
ka AS (SELECT series_id, variable, any_value(n) AS n, sum(e * e) AS g0, sum(s * s) AS ss, coalesce(sum(e * e1), 0) AS g1 FROM ks GROUP BY ALL),
kt AS (SELECT *, (ss / (n * n)) / ((g0 + 2 * g1 * (1 - 1 / 2)) / n) AS stat FROM ka),
kp AS (SELECT *, CASE {_KPSS_P} END AS p FROM kt)
SELECT series_id, variable, CASE WHEN n >= 20 THEN stat END AS kpss_stat, CASE WHEN n >= 20 THEN p END AS kpss_p, 1 AS kpss_lags,
  coalesce(n >= 20 AND p >= 0.05, false) AS kpss_stationary FROM kp""", doubles=("kpss_stat", "kpss_p"), digits=9, sig=True)
def q_t15(spark, sf):
    return DG.kpss(_diag_long(spark, sf), nlags=1)


@register("T16_reset_linearity", f"""WITH {D.LW_SQL}, {_KL_SQL},
rp AS (SELECT series_id, variable, row_number() OVER (PARTITION BY series_id, variable ORDER BY t) - 1 AS pos,
  count(*) OVER (PARTITION BY series_id, variable) AS n, value - avg(value) OVER (PARTITION BY series_id, variable) AS e FROM kl),
rs AS (SELECT series_id, variable, any_value(n) AS n, sum(e * e) AS see, sum(e * (pos - (n - 1) / 2.0)) AS sep1,
  sum(e * ((pos - (n - 1) / 2.0) * (pos - (n - 1) / 2.0) - (n * n - 1) / 12.0)) AS sep2 FROM rp GROUP BY ALL),
r1 AS (SELECT *, see - sep1 * sep1 / (n * (n * n - 1) / 12.0) AS rss1 FROM rs),
r2 AS (SELECT *, rss1 - sep2 * sep2 / (n * (n * n - 1) * (n * n - 4) / 180.0) AS rss2 FROM r1),
rf AS (SELECT series_id, variable, CASE WHEN n >= 20 AND rss2 > 0 AND n - 3 > 0 THEN (rss1 - rss2) / (rss2 / (n - 3)) END AS f,
  CAST(n - 3 AS BIGINT) AS nu FROM r2),""" + f1_tail_ctes("rf", ["series_id", "variable"], "rpv") + """
SELECT rf.series_id, rf.variable, rf.f AS reset_f, rpv.p AS reset_p, coalesce(rpv.p >= 0.05, false) AS is_linear
FROM rf JOIN rpv USING (series_id, variable)""", doubles=("reset_f", "reset_p"), digits=9, sig=True)
def q_t16(spark, sf):
    return DG.reset_linearity(_diag_long(spark, sf))


@register("T17_vif_k2", f"""WITH {D.LW_SQL},
v AS (SELECT l_returnflag AS series_id, count(*) AS n, sum(l_quantity * l_quantity) AS saa, sum(l_discount * l_discount) AS sbb,
  sum(l_quantity * l_discount) AS sab FROM lw WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL GROUP BY 1),
vv AS (SELECT series_id, CASE WHEN n >= 10 THEN 1 / (1 - sab * sab / (saa * sbb)) END AS vif FROM v)
SELECT series_id, c.variable, vif, CASE WHEN vif IS NULL OR isnan(vif) THEN 'Could not calculate' WHEN vif < 5 THEN 'OK'
  WHEN vif < 10 THEN 'Moderate' ELSE 'High' END AS vif_class
FROM vv, (VALUES ('l_quantity'), ('l_discount')) c(variable)""", doubles=("vif",), digits=9, sig=True)
def q_t17(spark, sf):
    lw = D.lineitem_weekly(spark, sf).withColumnRenamed("l_returnflag", "series_id")
    return DG.vif(lw, ["l_quantity", "l_discount"])


@register("T14_adf")
def q_t14(spark, sf):
    return DG.adf(_diag_long(spark, sf))


@register("T18_stationarity")
def q_t18(spark, sf):
    long = _diag_long(spark, sf)
    return DG.stationarity(DG.adf(long), DG.kpss(long))


@register("T19_diagnostics_report")
def q_t19(spark, sf):
    lw = D.lineitem_weekly(spark, sf).withColumnRenamed("l_returnflag", "series_id")
    return DG.diagnostics_report(lw, ["l_quantity", "l_discount", "l_tax", "l_extendedprice"])


@register("T20_log_transform")
def q_t20(spark, sf):
    lw = D.lineitem_weekly(spark, sf).withColumnRenamed("l_returnflag", "series_id")
    cols = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    return DG.log_transform(lw, DG.diagnostics_report(lw, cols), cols)


# --------------------------------------------------------------- bootstrap -------------------
BOOT_REPS = 500


@register("T11_bootstrap_irf_k2")
def q_t11(spark, sf):
    panel, m = _model(spark, sf, K2)
    return bootstrap_irf(m, panel, reps=BOOT_REPS, horizon=HORIZON, alpha=0.05, seed=SEED)


@register("T12_A12_bootstrap_granger_k2")
def q_t12(spark, sf):
    panel, m = _model(spark, sf, K2)
    return bootstrap_granger(m, panel, reps=BOOT_REPS, alpha=0.05, seed=SEED)


# --------------------------------------------------------------- pipelines -------------------
from panelcast.plans import pipelines as PL  # noqa: E402

_TT_SQL = f"""WITH {D.NW_SQL}, nt AS (SELECT * FROM nw), {_nw_interp_sql()}, {D.LW_SQL},
cfg AS (SELECT n_name, CASE n_nationkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS source, n_nationkey % 2 = 0 AS with_tax FROM nation),
lwp AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY iso_year, iso_week) AS pos FROM lw),
lwi AS (SELECT l_returnflag AS source, iso_year, iso_week, {', '.join(f"{_linear_sql(c, 'l_returnflag')} AS {c}" for c in PL.COVARIATES)} FROM lwp),
lwk AS (SELECT source, iso_year, iso_week, avg(l_discount) AS l_discount, avg(l_tax) AS l_tax, avg(l_quantity) AS l_quantity,
  avg(l_extendedprice) AS l_extendedprice FROM lwi GROUP BY ALL),
m AS (SELECT ni.n_name, source, ni.week, iso_year, iso_week, ln(1 + ni.INF_A) AS LOG_INF_A, ln(1 + ni.INF_B) AS LOG_INF_B,
  lwk.l_discount, CASE WHEN cfg.with_tax THEN lwk.l_tax END AS l_tax, lwk.l_quantity, lwk.l_extendedprice
  FROM ni JOIN cfg USING (n_name) JOIN lwk USING (source, iso_year, iso_week))
SELECT n_name || '|LOG_INF_A' AS series_id, n_name, 'LOG_INF_A' AS strain, source, week, iso_year, iso_week, LOG_INF_A AS target,
  l_discount, l_tax, l_quantity, l_extendedprice FROM m
UNION ALL SELECT n_name || '|LOG_INF_B', n_name, 'LOG_INF_B', source, week, iso_year, iso_week, LOG_INF_B,
  l_discount, l_tax, l_quantity, l_extendedprice FROM m"""


@register("O5_T22_training_table", _TT_SQL,
          doubles=("target", "l_discount", "l_tax", "l_quantity", "l_extendedprice"), digits=6)
def q_t22(spark, sf):
    return PL.training_table(spark, sf)


@register("S6_T22_training_folders", _TT_SQL,
          doubles=("target", "l_discount", "l_tax", "l_quantity", "l_extendedprice"), digits=6)
def q_s6_folders(spark, sf):
    """The training tables written by country and strain with wrong targets, then every second country again
    and the others again, each run replacing its own folders only; read back."""
    from panelcast.session import cut_lineage
    path, table = _scratch(spark, "training"), cut_lineage(PL.training_table(spark, sf))
    second = F.pmod(F.xxhash64("n_name"), F.lit(2)) == 0
    for rows in (table.withColumn("target", -F.col("target") - 1), table.where(second), table.where(~second)):
        PL.write_training_tables(rows, path)
    return PL.read_training_tables(spark, path)


@register("T21_var_report")
def q_t21(spark, sf):
    panel = PL.flag_panel(spark, sf)
    return PL.var_report(spark, panel, PL.FLAG_VARS, lags=6, out=_scratch(spark, "var_report"))["granger"]


@register("S12_all_series_granger")
def q_s12(spark, sf):
    panel = PL.training_panel(spark, sf)
    model = fit_var(panel, ["target", *PL.SHARED_COVARIATES], VarSpec(2, Det.CONST))
    return granger_matrix(model)


# --------------------------------------------------------------- typed load / lag design ------
@register("S3_W7_load_series", f"""WITH {D.NW_SQL}
SELECT n_name AS series_id, CAST(row_number() OVER (PARTITION BY n_name ORDER BY week) - 1 AS BIGINT) AS t, INF_ALL
FROM nw""", doubles=("INF_ALL",), digits=6)
def q_s3(spark, sf):
    from panelcast.sources.readers import load_series
    nw = D.nation_weekly(spark, sf).select("n_name", "week", "INF_ALL")
    return load_series(nw.withColumnRenamed("n_name", "series_id"), ["INF_ALL"], "series_id", order_col="week")


@register("W6_W9_lag_design", f"""WITH {D.LW_SQL}
SELECT l_returnflag AS series_id, t, CAST(1.0 AS DOUBLE) AS const, CAST(t + 1 AS DOUBLE) AS trend,
  lag(l_quantity, 1) OVER w AS qty__lag1, lag(l_discount, 1) OVER w AS disc__lag1,
  lag(l_quantity, 2) OVER w AS qty__lag2, lag(l_discount, 2) OVER w AS disc__lag2
FROM lw WINDOW w AS (PARTITION BY l_returnflag ORDER BY t) QUALIFY t >= 2""",
          doubles=("qty__lag1", "disc__lag1", "qty__lag2", "disc__lag2"), digits=8)
def q_w6(spark, sf):
    from panelcast.operators.lags import design_columns, lag_embed
    spec = VarSpec(2, Det.CONST_TREND)
    lagged = lag_embed(_panel(spark, sf), K2, 2)
    d = design_columns(spec, K2)
    names = ["const", "trend", "qty__lag1", "disc__lag1", "qty__lag2", "disc__lag2"]
    return lagged.select("series_id", "t", *[c.alias(n) for c, n in zip(d, names)])


_RESET_SQL = f"""{D.LW_SQL}, {_KL_SQL},
rp AS (SELECT series_id, variable, row_number() OVER (PARTITION BY series_id, variable ORDER BY t) - 1 AS pos,
  count(*) OVER (PARTITION BY series_id, variable) AS n, value - avg(value) OVER (PARTITION BY series_id, variable) AS e FROM kl),
rs AS (SELECT series_id, variable, any_value(n) AS n, sum(e * e) AS see, sum(e * (pos - (n - 1) / 2.0)) AS sep1,
  sum(e * ((pos - (n - 1) / 2.0) * (pos - (n - 1) / 2.0) - (n * n - 1) / 12.0)) AS sep2 FROM rp GROUP BY ALL),
r1 AS (SELECT *, see - sep1 * sep1 / (n * (n * n - 1) / 12.0) AS rss1 FROM rs),
r2 AS (SELECT *, rss1 - sep2 * sep2 / (n * (n * n - 1) * (n * n - 4) / 180.0) AS rss2 FROM r1),
rf AS (SELECT series_id, variable, CASE WHEN n >= 20 AND rss2 > 0 AND n - 3 > 0 THEN (rss1 - rss2) / (rss2 / (n - 3)) END AS f,
  CAST(n - 3 AS BIGINT) AS nu FROM r2),""" + f1_tail_ctes("rf", ["series_id", "variable"], "rpv")


@register("T20_log_transform_given_verdicts", f"""WITH {_RESET_SQL},
need AS (SELECT rf.series_id, rf.variable FROM rf JOIN rpv USING (series_id, variable)
  WHERE NOT coalesce(rpv.p >= 0.05, false)
    AND (SELECT min(value) FROM kl WHERE kl.series_id = rf.series_id AND kl.variable = rf.variable) >= 0)
SELECT series_id, t, variable, value FROM kl
UNION ALL SELECT kl.series_id, kl.t, 'LOG_' || upper(kl.variable), ln(1 + kl.value) FROM kl JOIN need USING (series_id, variable)""",
          doubles=("value",), digits=9, sig=True)
def q_t20_fixed(spark, sf):
    """The transform step given a verdict table (here: RESET linearity only, stationarity assumed)."""
    long = _diag_long(spark, sf)
    verdicts = DG.reset_linearity(long).withColumn("stationarity", F.lit("Stationary"))
    lw = D.lineitem_weekly(spark, sf).withColumnRenamed("l_returnflag", "series_id")
    return DG.log_transform(lw, verdicts, ["l_quantity", "l_discount"])


# --------------------------------------------------------------- bootstrap with oracles -------
BOOT_SQL_REPS = BOOT_REPS

_SIM1_SQL = f"""
res AS (SELECT series_id, t - 1 AS i, qty - a - b * qty1 AS u FROM lr JOIN k1 USING (series_id)),
nreg AS (SELECT series_id, count(*) AS nr FROM res GROUP BY series_id),
idx AS (SELECT series_id, rep, i, CAST(('0x' || substr(md5(concat_ws(':', {SEED}, series_id, rep, i)), 1, 8))::BIGINT % nr AS BIGINT) AS j
  FROM (SELECT series_id, nr, rep, unnest(range(0, nr)) AS i FROM nreg, range(0, {BOOT_SQL_REPS}) rr(rep)) x),
eps AS (SELECT idx.series_id, idx.rep, idx.i, res.u FROM idx JOIN res ON idx.series_id = res.series_id AND idx.j = res.i),
sim AS (SELECT lv.series_id, rr.rep, 0 AS t, lv.qty AS y FROM lv JOIN k1 USING (series_id), range(0, {BOOT_SQL_REPS}) rr(rep) WHERE lv.t = 0
  UNION ALL SELECT sim.series_id, sim.rep, sim.t + 1, k1.a + k1.b * sim.y + eps.u
  FROM sim JOIN k1 USING (series_id) JOIN eps ON eps.series_id = sim.series_id AND eps.rep = sim.rep AND eps.i = sim.t),
sl AS (SELECT series_id, rep, t, y, lag(y) OVER (PARTITION BY series_id, rep ORDER BY t) AS y1 FROM sim),
kb AS (SELECT series_id, rep, count(*) AS n, regr_slope(y, y1) AS b,
  regr_syy(y, y1) - regr_sxy(y, y1) * regr_sxy(y, y1) / regr_sxx(y, y1) AS rss FROM sl WHERE t >= 1 GROUP BY ALL)"""


@register("T11_bootstrap_irf_k1", f"""WITH RECURSIVE {_LV_SQL}, {_SIM1_SQL},
draws AS (SELECT series_id, rep, h, pow(b, h) * sqrt(rss / (n - 2)) AS v FROM kb, range(0, {HORIZON}) hh(h)),
bands AS (SELECT series_id, h, quantile_cont(v, 0.025) AS lower, quantile_cont(v, 0.975) AS upper, count(*) AS n_reps
  FROM draws GROUP BY ALL)
SELECT k1.series_id, 'qty' AS shock, 'qty' AS response, CAST(hh.h AS INTEGER) AS horizon,
  pow(k1.b, hh.h) * sqrt(k1.rss / (k1.n - 2)) AS point, bands.lower, bands.upper, bands.n_reps
FROM k1, range(0, {HORIZON}) hh(h) JOIN bands ON bands.series_id = k1.series_id AND bands.h = hh.h""",
          doubles=("point", "lower", "upper"), digits=9, sig=True)
def q_t11_k1(spark, sf):
    panel, m = _model(spark, sf, K1)
    return bootstrap_irf(m, panel.select("series_id", "t", "qty"), reps=BOOT_SQL_REPS, horizon=HORIZON, alpha=0.05, seed=SEED)


_SIM2_SQL = f"""
res2 AS (SELECT series_id, t - 1 AS i, qty - aq - bq1 * qty1 - bq2 * disc1 AS uq, disc - ad - bd1 * qty1 - bd2 * disc1 AS ud
  FROM lr2 JOIN k2 USING (series_id)),
nreg2 AS (SELECT series_id, count(*) AS nr FROM res2 GROUP BY series_id),
idx2 AS (SELECT series_id, rep, i, CAST(('0x' || substr(md5(concat_ws(':', {SEED}, series_id, rep, i)), 1, 8))::BIGINT % nr AS BIGINT) AS j
  FROM (SELECT series_id, nr, rep, unnest(range(0, nr)) AS i FROM nreg2, range(0, {BOOT_SQL_REPS}) rr(rep)) x),
eps2 AS (SELECT idx2.series_id, idx2.rep, idx2.i, res2.uq, res2.ud FROM idx2 JOIN res2 ON idx2.series_id = res2.series_id AND idx2.j = res2.i),
sim2 AS (SELECT lv.series_id, rr.rep, 0 AS t, lv.qty AS yq, lv.disc AS yd FROM lv JOIN k2 USING (series_id), range(0, {BOOT_SQL_REPS}) rr(rep) WHERE lv.t = 0
  UNION ALL SELECT sim2.series_id, sim2.rep, sim2.t + 1,
    k2.aq + k2.bq1 * sim2.yq + k2.bq2 * sim2.yd + eps2.uq, k2.ad + k2.bd1 * sim2.yq + k2.bd2 * sim2.yd + eps2.ud
  FROM sim2 JOIN k2 USING (series_id) JOIN eps2 ON eps2.series_id = sim2.series_id AND eps2.rep = sim2.rep AND eps2.i = sim2.t),
sr AS (SELECT series_id, rep, t, yq AS qty, yd AS disc, lag(yq) OVER w AS qty1, lag(yd) OVER w AS disc1
  FROM sim2 WINDOW w AS (PARTITION BY series_id, rep ORDER BY t)),
srr AS (SELECT * FROM sr WHERE t >= 1),
bm AS (SELECT series_id, rep, count(*) AS n, avg(qty1) AS m1, avg(disc1) AS m2, avg(qty) AS mq, avg(disc) AS md FROM srr GROUP BY ALL),
bs AS (SELECT series_id, rep, any_value(n) AS n,
  sum((qty1 - m1) * (qty1 - m1)) AS s11, sum((qty1 - m1) * (disc1 - m2)) AS s12, sum((disc1 - m2) * (disc1 - m2)) AS s22,
  sum((qty1 - m1) * (qty - mq)) AS s1q, sum((disc1 - m2) * (qty - mq)) AS s2q,
  sum((qty1 - m1) * (disc - md)) AS s1d, sum((disc1 - m2) * (disc - md)) AS s2d,
  sum((qty - mq) * (qty - mq)) AS sqq, sum((disc - md) * (disc - md)) AS sdd
  FROM srr JOIN bm USING (series_id, rep) GROUP BY ALL),
bb AS (SELECT *, (s1q * s22 - s2q * s12) / (s11 * s22 - s12 * s12) AS bq1, (s2q * s11 - s1q * s12) / (s11 * s22 - s12 * s12) AS bq2,
  (s1d * s22 - s2d * s12) / (s11 * s22 - s12 * s12) AS bd1, (s2d * s11 - s1d * s12) / (s11 * s22 - s12 * s12) AS bd2 FROM bs),
bsrc AS (SELECT series_id, rep, 'disc' AS cause, 'qty' AS effect, (sqq - s1q * s1q / s11) - (sqq - bq1 * s1q - bq2 * s2q) AS num,
    sqq - bq1 * s1q - bq2 * s2q AS rss_u, n FROM bb
  UNION ALL SELECT series_id, rep, 'qty', 'disc', (sdd - s2d * s2d / s22) - (sdd - bd1 * s1d - bd2 * s2d), sdd - bd1 * s1d - bd2 * s2d, n FROM bb),
bf AS (SELECT series_id, rep, cause, effect, CASE WHEN greatest(num, 0) = 0 OR rss_u <= 0 THEN 0.0
  ELSE greatest(num, 0) / (rss_u / (n - 3)) END AS f_boot FROM bsrc)"""


@register("T12_A12_bootstrap_granger_oracle_k2", f"""WITH RECURSIVE {_LV_SQL}, {_GR_SQL}, {_SIM2_SQL},
ex AS (SELECT bf.series_id, bf.cause, bf.effect, count(*) FILTER (WHERE bf.f_boot >= gr.f_stat) AS n_exceed, count(*) AS n_reps
  FROM bf JOIN gr USING (series_id, cause, effect) GROUP BY ALL)
SELECT gr.series_id, gr.cause, gr.effect, gr.f_stat, gr.p_value AS asymptotic_p,
  (coalesce(ex.n_exceed, 0) + 1) / {BOOT_SQL_REPS + 1} AS boot_p, gr.lags, gr.significant AS significant_asymptotic,
  (coalesce(ex.n_exceed, 0) + 1) / {BOOT_SQL_REPS + 1} < 0.05 AS significant_bootstrap, 0.05 AS alpha, ex.n_reps
FROM gr LEFT JOIN ex USING (series_id, cause, effect)""",
          doubles=("f_stat", "asymptotic_p", "boot_p", "alpha"), digits=9, sig=True)
def q_t12_oracle(spark, sf):
    panel, m = _model(spark, sf, K2)
    return bootstrap_granger(m, panel, reps=BOOT_SQL_REPS, alpha=0.05, seed=SEED)


@register("T14_adf_fixed_lag0", f"""WITH {D.LW_SQL}, {_KL_SQL},
d AS (SELECT series_id, variable, t, value - lag(value) OVER w AS dy, lag(value) OVER w AS ylag,
  count(*) OVER (PARTITION BY series_id, variable) AS n FROM kl WINDOW w AS (PARTITION BY series_id, variable ORDER BY t)),
r AS (SELECT series_id, variable, any_value(n) AS n, count(*) AS nobs, regr_slope(dy, ylag) AS b, regr_sxx(dy, ylag) AS sxx,
  regr_syy(dy, ylag) - regr_sxy(dy, ylag) * regr_sxy(dy, ylag) / regr_sxx(dy, ylag) AS rss FROM d WHERE ylag IS NOT NULL GROUP BY ALL)
SELECT series_id, variable, CASE WHEN n >= 20 THEN b / sqrt(rss / (nobs - 2) / sxx) END AS adf_stat,
  CASE WHEN n >= 20 THEN 0 END AS adf_lags FROM r""", doubles=("adf_stat",), digits=9, sig=True)
def q_t14_fixed(spark, sf):
    """Dickey-Fuller statistic at a fixed lag 0 (the automatic-lag query is rows-only)."""
    return DG.adf(_diag_long(spark, sf), maxlag=0, autolag=None).select("series_id", "variable", "adf_stat", "adf_lags")


# --------------------------------------------------------------- file round trips -------------
def _scratch(spark, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    import uuid
    from panelcast.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("S1_station_scan_round_trip", """SELECT event_type AS Station_ID, 'EV_' || event_type AS Station_name,
  CAST(year(ts) - CAST(floor(value / 10) AS INTEGER) AS VARCHAR) AS Year, CAST(month(ts) AS VARCHAR) AS Month,
  CAST(day(ts) AS VARCHAR) AS Day, CAST(hour(ts) AS VARCHAR) AS Hour, CAST(minute(ts) AS VARCHAR) AS Minute,
  CAST(CAST(round(value * 10) AS BIGINT) AS VARCHAR) AS temperature
FROM events WHERE year(ts) - CAST(floor(value / 10) AS INTEGER) >= 2022""")
def q_s1(spark, sf):
    """Events written as a '|'-separated station file (with a column outside the whitelist), then
    scanned back: whitelist kept, strings untyped, Year >= bound applied after coercion."""
    from panelcast.sources.readers import read_station_file
    ev = read_test_table(spark, sf, "events")
    station = ev.select(
        F.col("event_type").alias("Station_ID"), F.concat(F.lit("EV_"), "event_type").alias("Station_name"),
        (F.year("ts") - F.floor(F.col("value") / 10).cast("int")).cast("string").alias("Year"),
        F.month("ts").cast("string").alias("Month"), F.dayofmonth("ts").cast("string").alias("Day"),
        F.hour("ts").cast("string").alias("Hour"), F.minute("ts").cast("string").alias("Minute"),
        F.round(F.col("value") * 10).cast("bigint").cast("string").alias("temperature"),
        F.col("props").alias("not_in_whitelist"))
    path = _scratch(spark, "station")
    station = station.withColumn("_late", F.col("Minute").cast("int") >= 30)
    layouts = {"a": station.columns[:-1], "b": sorted(station.columns[:-1], reverse=True)}
    for name, cols in layouts.items():  # two files whose columns stand in different orders
        rows = station.where(F.col("_late") if name == "b" else ~F.col("_late"))
        rows.select(*cols).write.option("header", True).option("sep", "|").csv(f"{path}/{name}")
    return read_station_file(spark, [f"{path}/a", f"{path}/b"], year_min=2022)


def _station_file(spark, sf):
    ev = read_test_table(spark, sf, "events")
    station = ev.select(
        F.col("event_type").alias("Station_ID"), F.concat(F.lit("EV_"), "event_type").alias("Station_name"),
        (F.year("ts") - F.floor(F.col("value") / 10).cast("int")).cast("string").alias("Year"),
        F.month("ts").cast("string").alias("Month"), F.dayofmonth("ts").cast("string").alias("Day"),
        F.hour("ts").cast("string").alias("Hour"), F.minute("ts").cast("string").alias("Minute"),
        F.round(F.col("value") * 10).cast("bigint").cast("string").alias("temperature"),
        F.col("user_id").cast("string").alias("precipitation"),
        F.col("props").alias("not_in_whitelist"))
    path = _scratch(spark, "station")
    station.write.option("header", True).option("sep", "|").csv(path)
    return path


_STATION_SQL = """
st AS (SELECT event_type AS Station_ID, 'EV_' || event_type AS Station_name,
  TRY(make_timestamp(year(ts) - CAST(floor(value / 10) AS INTEGER), month(ts), day(ts), hour(ts), minute(ts), 0)) AS datetime,
  round(value * 10) / 10.0 AS temperature, CAST(user_id AS DOUBLE) AS precipitation
  FROM events WHERE year(ts) - CAST(floor(value / 10) AS INTEGER) >= 2022
    AND TRY(make_timestamp(year(ts) - CAST(floor(value / 10) AS INTEGER), month(ts), day(ts), hour(ts), minute(ts), 0)) IS NOT NULL),
sh AS (SELECT Station_ID, date_trunc('hour', datetime) AS datetime, avg(temperature) AS temperature,
  avg(precipitation) AS precipitation, first(Station_name ORDER BY datetime, Station_name) AS Station_name FROM st GROUP BY ALL),
sg AS (SELECT Station_ID, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS datetime
  FROM (SELECT Station_ID, min(datetime) AS lo, max(datetime) AS hi FROM sh GROUP BY ALL) b),
sfull AS (SELECT g.Station_ID, g.datetime, h.temperature, h.precipitation, h.Station_name FROM sg g LEFT JOIN sh h USING (Station_ID, datetime)),"""


@register("E2_station_weekly_job", f"""WITH {_STATION_SQL}
{D.weekly_sql("sw", "SELECT * FROM sfull", ["Station_ID"], "datetime", ["temperature"], ["precipitation"], ["Station_name"],
               week_col="iso_weekstartdate")}
SELECT * FROM sw""", doubles=("temperature", "precipitation"), digits=9, sig=True)
def q_e2_station(spark, sf):
    """Station cleaning job over the events-derived station file: weekly table."""
    from panelcast.sources.readers import read_station_file
    raw = read_station_file(spark, _station_file(spark, sf), year_min=2022)
    return PL.station_weekly(raw)[0]


@register("E2_station_nan_summary", f"""WITH {_STATION_SQL}
{D.weekly_sql("sw", "SELECT * FROM sfull", ["Station_ID"], "datetime", ["temperature"], ["precipitation"], ["Station_name"],
               week_col="iso_weekstartdate")}
SELECT 'Station_ID' AS column, count(*) FILTER (WHERE Station_ID IS NULL) AS NaN_count, count(*) FILTER (WHERE Station_ID IS NULL) / count(*) AS NaN_fraction FROM sw
UNION ALL SELECT 'iso_weekstartdate' AS column, count(*) FILTER (WHERE iso_weekstartdate IS NULL) AS NaN_count, count(*) FILTER (WHERE iso_weekstartdate IS NULL) / count(*) AS NaN_fraction FROM sw
UNION ALL SELECT 'iso_year' AS column, count(*) FILTER (WHERE iso_year IS NULL) AS NaN_count, count(*) FILTER (WHERE iso_year IS NULL) / count(*) AS NaN_fraction FROM sw
UNION ALL SELECT 'iso_week' AS column, count(*) FILTER (WHERE iso_week IS NULL) AS NaN_count, count(*) FILTER (WHERE iso_week IS NULL) / count(*) AS NaN_fraction FROM sw
UNION ALL SELECT 'isoyw' AS column, count(*) FILTER (WHERE isoyw IS NULL) AS NaN_count, count(*) FILTER (WHERE isoyw IS NULL) / count(*) AS NaN_fraction FROM sw
UNION ALL SELECT 'temperature' AS column, count(*) FILTER (WHERE temperature IS NULL) AS NaN_count, count(*) FILTER (WHERE temperature IS NULL) / count(*) AS NaN_fraction FROM sw
UNION ALL SELECT 'precipitation' AS column, count(*) FILTER (WHERE precipitation IS NULL) AS NaN_count, count(*) FILTER (WHERE precipitation IS NULL) / count(*) AS NaN_fraction FROM sw
UNION ALL SELECT 'Station_name' AS column, count(*) FILTER (WHERE Station_name IS NULL) AS NaN_count, count(*) FILTER (WHERE Station_name IS NULL) / count(*) AS NaN_fraction FROM sw""", doubles=("NaN_fraction",), digits=9, sig=True)
def q_e2_nan(spark, sf):
    """Per-column missing counts and fractions of the station weekly table."""
    from panelcast.sources.readers import read_station_file
    raw = read_station_file(spark, _station_file(spark, sf), year_min=2022)
    return PL.station_weekly(raw)[1]


@register("S2_S6_csv_round_trip", f"WITH {D.NW_SQL} SELECT * FROM nw", doubles=tuple(D.NW_MEASURES), digits=6)
def q_s2(spark, sf):
    """The weekly nation panel written as header CSV and read back with an explicit schema."""
    from panelcast.sources.readers import read_table
    from panelcast.sources.sinks import write_table
    nw = D.nation_weekly(spark, sf)
    path = _scratch(spark, "nation_weekly_csv")
    write_table(nw, path, fmt="csv")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nw.schema.fields)
    return read_table(spark, path, fmt="csv", schema=schema)


# --------------------------------------------------------------- sinks, unions, lookups -------
def _written_and_read(spark, df, name: str, fmt: str = "csv", digits: int | None = None):
    from panelcast.sources.readers import read_table
    from panelcast.sources.sinks import write_table
    path = _scratch(spark, name)
    write_table(df, path, fmt=fmt, digits=digits)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return read_table(spark, path, fmt=fmt, schema=schema)


@register("S9_granger_output", f"""WITH {_LV_SQL}, {_GR_SQL}
SELECT series_id, cause AS CauseVar, effect AS EffectVar, f_stat AS FStatistic, p_value AS PValue, lags AS Lags,
  significant AS Significant FROM gr""", doubles=("FStatistic", "PValue"), digits=6, sig=False)
def q_s9(spark, sf):
    """The Granger table in its published layout, written as CSV and read back."""
    from panelcast.sources.sinks import granger_output
    return _written_and_read(spark, granger_output(granger_matrix(_model(spark, sf, K2)[1])), "granger")


@register("S10_bootstrap_irf_output", f"""SELECT series_id, shock AS ShockVar, response AS ResponseVar, horizon AS Horizon, point AS Point,
  lower AS Lower, upper AS Upper FROM ({CATALOG['T11_bootstrap_irf_k1'].sql}) q""", doubles=("Point", "Lower", "Upper"), digits=9, sig=True)
def q_s10(spark, sf):
    """IRF bands in their published layout, written as CSV and read back."""
    from panelcast.sources.sinks import bootstrap_irf_output
    return _written_and_read(spark, bootstrap_irf_output(q_t11_k1(spark, sf)), "bootstrap_irf")


@register("S11_bootstrap_granger_output", f"""SELECT series_id, cause AS CauseVar, effect AS EffectVar, f_stat AS FStatistic,
  asymptotic_p AS AsymptoticP, boot_p AS BootPValue, lags AS Lags, significant_asymptotic AS Significant_Asymptotic,
  significant_bootstrap AS Significant_Bootstrap FROM ({CATALOG['T12_A12_bootstrap_granger_oracle_k2'].sql}) q""",
          doubles=("FStatistic", "AsymptoticP", "BootPValue"), digits=9, sig=True)
def q_s11(spark, sf):
    """Bootstrap Granger table in its published layout, written as CSV and read back."""
    from panelcast.sources.sinks import bootstrap_granger_output
    return _written_and_read(spark, bootstrap_granger_output(q_t12_oracle(spark, sf)), "bootstrap_granger")


@register("P8_case_insensitive_lookup", """SELECT c_custkey, c_nationkey, c_mktsegment FROM customer""")
def q_p8(spark, sf):
    """Columns found whatever the case of their names."""
    from panelcast.sources.readers import present_columns, require_columns
    c = read_test_table(spark, sf, "customer")
    wanted = ["C_CUSTKEY", "C_NationKey", "c_mktSEGMENT", "no_such_column"]
    require_columns(c, wanted[:3])
    return c.select(*[F.col(x).alias(x.lower()) for x in present_columns(c, wanted)])


@register("O3_bag_union", """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'""", doubles=("o_totalprice",), digits=4)
def q_o3(spark, sf):
    """Chunks written apart and read as one table; rows that stand in two chunks stay twice."""
    o = read_test_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = _scratch(spark, "chunks")
    chunks = {"f": F.col("o_orderstatus") == "F", "rest": F.col("o_orderstatus") != "F", "again": F.col("o_orderstatus") == "F"}
    for name, which in chunks.items():
        o.where(which).write.parquet(f"{path}/{name}")
    return spark.read.parquet(*[f"{path}/{name}" for name in chunks])


# --------------------------------------------------------------- stable model statistics ------
@register("T2_min_norm_fit", f"""WITH {_LV_SQL}
SELECT series_id, e.equation, 'const' AS term, 0 AS lag, '' AS variable, e.f * a AS value FROM k1, (VALUES ('qty', 1), ('twice', 2)) e(equation, f)
UNION ALL SELECT series_id, e.equation, 'lag', 1, v.variable, e.f * v.f * b / 5 FROM k1, (VALUES ('qty', 1), ('twice', 2)) e(equation, f),
  (VALUES ('qty', 1), ('twice', 2)) v(variable, f)""", doubles=("value",), digits=5, sig=True)
def q_t2(spark, sf):
    """A singular design (a variable beside its double): the minimum-norm coefficients."""
    panel = _panel(spark, sf).select("series_id", "t", "qty", (F.col("qty") * 2).alias("twice"))
    return fit_var(panel, ["qty", "twice"], VarSpec(1, Det.CONST)).coefficients()


@register("T8_T9_granger_level", f"WITH {_LV_SQL}, {_GR_SQL} SELECT * FROM gr", doubles=("f_stat", "p_value"), digits=6, sig=True)
def q_t8_level(spark, sf):
    """A variable at a high level (a million added): F does not change."""
    panel = _panel(spark, sf).withColumn("qty", F.col("qty") + 1e6)
    return granger_matrix(fit_var(panel, K2, VarSpec(1, Det.CONST)))


def _det(cells: list[list[str]]) -> str:
    """A determinant in SQL, by its first row."""
    if len(cells) == 1:
        return cells[0][0]
    terms = [f"{'-' if j % 2 else '+'} {cells[0][j]} * ({_det([r[:j] + r[j + 1:] for r in cells[1:]])})" for j in range(len(cells))]
    return " ".join(terms)


_V4 = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
_G4 = [[f"g{min(i, j)}{max(i, j)} / sqrt(g{i}{i} * g{j}{j})" for j in range(4)] for i in range(4)]
_M4 = [[[r[j] for j in range(4) if j != i] for k, r in enumerate(_G4) if k != i] for i in range(4)]


@register("T17_vif_k4", f"""WITH {D.LW_SQL},
v AS (SELECT l_returnflag AS series_id, {', '.join(f'sum({_V4[i]} * {_V4[j]}) AS g{i}{j}' for i in range(4) for j in range(i, 4))}
  FROM lw WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _V4)} GROUP BY 1 HAVING count(*) >= 10),
vv AS ({' UNION ALL '.join(f"SELECT series_id, '{c}' AS variable, ({_det(_M4[i])}) / ({_det(_G4)}) AS vif FROM v" for i, c in enumerate(_V4))})
SELECT *, CASE WHEN vif < 5 THEN 'OK' WHEN vif < 10 THEN 'Moderate' ELSE 'High' END AS vif_class FROM vv""", doubles=("vif",), digits=6, sig=True)
def q_t17_k4(spark, sf):
    lw = D.lineitem_weekly(spark, sf).withColumnRenamed("l_returnflag", "series_id")
    return DG.vif(lw, _V4)


def _adf_long(spark, sf):
    lw = D.lineitem_weekly(spark, sf).withColumnRenamed("l_returnflag", "series_id")
    return DG.to_long_series(lw, ["l_quantity", "l_discount", "l_extendedprice"], "series_id", "t")


def _adf_fit_sql(name: str, where: str) -> str:
    """CTEs: centred sums of dy on ylag (and dy1) over a sample, SSR and slope variance of lags 0 and 1."""
    return f"""
{name}m AS (SELECT series_id, variable, avg(dy) AS my, avg(ylag) AS m1, avg(dy1) AS m2 FROM ad WHERE {where} GROUP BY ALL),
{name}s AS (SELECT series_id, variable, count(*) AS nobs, any_value(n) AS n, sum((dy - my) * (dy - my)) AS syy, sum((ylag - m1) * (ylag - m1)) AS s11,
  sum((dy1 - m2) * (dy1 - m2)) AS s22, sum((ylag - m1) * (dy1 - m2)) AS s12, sum((ylag - m1) * (dy - my)) AS s1y, sum((dy1 - m2) * (dy - my)) AS s2y
  FROM ad JOIN {name}m USING (series_id, variable) WHERE {where} GROUP BY ALL),
{name} AS (SELECT *, syy - s1y * s1y / s11 AS ssr0, s1y / s11 AS b0, s11 * s22 - s12 * s12 AS det, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1,
  syy - ((s1y * s22 - s2y * s12) * s1y + (s2y * s11 - s1y * s12) * s2y) / (s11 * s22 - s12 * s12) AS ssr1 FROM {name}s)"""


@register("T14_adf_aic_two_lags", f"""WITH {D.LW_SQL},
kl AS (SELECT l_returnflag AS series_id, 'l_quantity' AS variable, t, l_quantity AS value FROM lw WHERE l_quantity IS NOT NULL
  UNION ALL SELECT l_returnflag, 'l_discount', t, l_discount FROM lw WHERE l_discount IS NOT NULL
  UNION ALL SELECT l_returnflag, 'l_extendedprice', t, l_extendedprice FROM lw WHERE l_extendedprice IS NOT NULL),
d1 AS (SELECT series_id, variable, t, value - lag(value) OVER w AS dy, lag(value) OVER w AS ylag, row_number() OVER w - 1 AS pos,
  count(*) OVER (PARTITION BY series_id, variable) AS n FROM kl WINDOW w AS (PARTITION BY series_id, variable ORDER BY t)),
ad AS (SELECT *, lag(dy) OVER (PARTITION BY series_id, variable ORDER BY t) AS dy1 FROM d1),
{_adf_fit_sql("fc", "pos >= 2")}, {_adf_fit_sql("f0", "pos >= 1")},
ch AS (SELECT series_id, variable, CASE WHEN nobs * ln(ssr1 / nobs) + 6 < nobs * ln(ssr0 / nobs) + 4 THEN 1 ELSE 0 END AS lag FROM fc)
SELECT fc.series_id, fc.variable, CASE ch.lag WHEN 1 THEN fc.b1 / sqrt(fc.ssr1 / (fc.nobs - 3) * fc.s22 / fc.det)
  ELSE f0.b0 / sqrt(f0.ssr0 / (f0.nobs - 2) / f0.s11) END AS adf_stat, ch.lag AS adf_lags
FROM fc JOIN f0 USING (series_id, variable) JOIN ch USING (series_id, variable) WHERE fc.n >= 20""", doubles=("adf_stat",), digits=8, sig=True)
def q_t14_aic(spark, sf):
    """Dickey-Fuller with the lag chosen by AIC among 0 and 1, also on a column of large units."""
    found = DG.adf(_adf_long(spark, sf), maxlag=1)
    return found.where("adf_stat is not null").select("series_id", "variable", "adf_stat", "adf_lags")


# --------------------------------------------------------------- verdicts with oracles --------
CATALOG["T12_A12_bootstrap_granger_k2"].sql = CATALOG["T12_A12_bootstrap_granger_oracle_k2"].sql  # 500 draws both
CATALOG["T12_A12_bootstrap_granger_k2"].doubles = CATALOG["T12_A12_bootstrap_granger_oracle_k2"].doubles
CATALOG["T12_A12_bootstrap_granger_k2"].digits, CATALOG["T12_A12_bootstrap_granger_k2"].sig = 9, True

_VL_COLS = ["l_quantity", "l_discount", "l_extendedprice"]
_VL_SQL = "kl AS (" + " UNION ALL ".join(
    f"SELECT l_returnflag AS series_id, '{c}' AS variable, t, {c} AS value FROM lw WHERE {c} IS NOT NULL" for c in _VL_COLS) + ")"

# KPSS with the automatic lag: all lagged products of a series by a self-join on its positions
_KPSS_AUTO_SQL = f"""
qe AS (SELECT series_id, variable, row_number() OVER w - 1 AS pos, value - avg(value) OVER (PARTITION BY series_id, variable) AS e,
  count(*) OVER (PARTITION BY series_id, variable) AS n FROM kl WINDOW w AS (PARTITION BY series_id, variable ORDER BY t)),
qs AS (SELECT *, sum(e) OVER (PARTITION BY series_id, variable ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM qe),
qg AS (SELECT a.series_id, a.variable, a.pos - b.pos AS j, any_value(a.n) AS n, sum(a.e * b.e) AS g
  FROM qe a JOIN qe b ON a.series_id = b.series_id AND a.variable = b.variable AND a.pos >= b.pos GROUP BY ALL),
ql AS (SELECT series_id, variable, any_value(n) AS n,
  sum(CASE WHEN j = 0 THEN g / n WHEN j <= floor(pow(n, 2.0 / 9.0)) THEN g / (n / 2.0) ELSE 0 END) AS s0,
  sum(CASE WHEN j BETWEEN 1 AND floor(pow(n, 2.0 / 9.0)) THEN j * g / (n / 2.0) ELSE 0 END) AS s1 FROM qg GROUP BY ALL),
qa AS (SELECT *, CAST(least(floor({DG.KPSS_AUTOLAG_C} * pow(pow(s1 / s0, 2), 1.0 / 3.0) * pow(n, 1.0 / 3.0)), n - 1) AS INTEGER) AS L FROM ql),
qv AS (SELECT qg.series_id, qg.variable, any_value(qa.n) AS n, any_value(qa.L) AS L,
  sum(CASE WHEN j = 0 THEN g WHEN j <= L THEN 2 * g * (1 - j / (L + 1.0)) ELSE 0 END) AS lrv FROM qg JOIN qa USING (series_id, variable) GROUP BY ALL),
qss AS (SELECT series_id, variable, sum(s * s) AS ss FROM qs GROUP BY ALL),
qt AS (SELECT series_id, variable, n, L, ss / n / lrv AS stat FROM qv JOIN qss USING (series_id, variable)),
kpss AS (SELECT series_id, variable, n, L, stat, CASE {_KPSS_P} END AS p FROM qt)"""


@register("T15_kpss_auto", f"""WITH {D.LW_SQL}, {_VL_SQL}, {_KPSS_AUTO_SQL}
SELECT series_id, variable, stat AS kpss_stat, p AS kpss_p, L AS kpss_lags, coalesce(p >= 0.05, false) AS kpss_stationary
FROM kpss WHERE n >= 20""", doubles=("kpss_stat", "kpss_p"), digits=8, sig=True)
def q_t15_auto(spark, sf):
    """KPSS with the automatic lag, every series long enough to be tested."""
    return DG.kpss(_adf_long(spark, sf)).where("kpss_stat is not null")


# Dickey-Fuller with the lag chosen among 0 and 1; p < 0.05 as a bound on the p-value surface's argument
_SMALL_P = " + ".join(f"{c} * pow(tau, {i})" for i, c in enumerate(DG.ADF_SMALLP))
_LARGE_P = " + ".join(f"{c} * pow(tau, {i})" for i, c in enumerate(DG.ADF_LARGEP))
_VERDICT_SQL = f"""
d1 AS (SELECT series_id, variable, t, value - lag(value) OVER w AS dy, lag(value) OVER w AS ylag, row_number() OVER w - 1 AS pos,
  count(*) OVER (PARTITION BY series_id, variable) AS n FROM kl WINDOW w AS (PARTITION BY series_id, variable ORDER BY t)),
ad AS (SELECT *, lag(dy) OVER (PARTITION BY series_id, variable ORDER BY t) AS dy1 FROM d1),
{_adf_fit_sql("fc", "pos >= 2")}, {_adf_fit_sql("f0", "pos >= 1")},
ta AS (SELECT fc.series_id, fc.variable, CASE WHEN fc.nobs * ln(fc.ssr1 / fc.nobs) + 6 < fc.nobs * ln(fc.ssr0 / fc.nobs) + 4
  THEN fc.b1 / sqrt(fc.ssr1 / (fc.nobs - 3) * fc.s22 / fc.det) ELSE f0.b0 / sqrt(f0.ssr0 / (f0.nobs - 2) / f0.s11) END AS tau
  FROM fc JOIN f0 USING (series_id, variable) WHERE fc.n >= 20),
vd AS (SELECT series_id, variable, tau <= {DG.ADF_TAU_MAX} AND (tau < {DG.ADF_TAU_MIN}
  OR CASE WHEN tau <= {DG.ADF_TAU_STAR} THEN {_SMALL_P} ELSE {_LARGE_P} END < -1.6448536269514722) AS adf_stationary,
  coalesce(kpss.p >= 0.05, false) AS kpss_stationary FROM ta JOIN kpss USING (series_id, variable)),
st AS (SELECT *, CASE WHEN adf_stationary AND kpss_stationary THEN 'Stationary' WHEN NOT adf_stationary AND NOT kpss_stationary THEN 'Non-stationary'
  ELSE 'Partially stationary' END AS stationarity FROM vd)"""


@register("T18_stationarity_two_lags", f"""WITH {D.LW_SQL}, {_VL_SQL}, {_KPSS_AUTO_SQL}, {_VERDICT_SQL}
SELECT series_id, variable, adf_stationary, kpss_stationary, stationarity FROM st""")
def q_t18_two(spark, sf):
    """Verdicts from Dickey-Fuller (lag 0 or 1 by AIC) and KPSS (automatic lag)."""
    long = _adf_long(spark, sf)
    tested = DG.stationarity(DG.adf(long, maxlag=1).where("adf_stat is not null"), DG.kpss(long).where("kpss_stat is not null"))
    return tested.select("series_id", "variable", "adf_stationary", "kpss_stationary", "stationarity")


@register("T20_log_transform_two_lags", f"""WITH {_RESET_SQL.replace(_KL_SQL.strip(), _VL_SQL)}, {_KPSS_AUTO_SQL}, {_VERDICT_SQL},
need AS (SELECT st.series_id, st.variable FROM st JOIN rpv USING (series_id, variable)
  WHERE (st.stationarity = 'Non-stationary' OR NOT coalesce(rpv.p >= 0.05, false))
    AND (SELECT min(value) FROM kl WHERE kl.series_id = st.series_id AND kl.variable = st.variable) >= 0)
SELECT series_id, t, variable, value FROM kl
UNION ALL SELECT kl.series_id, kl.t, 'LOG_' || upper(kl.variable), ln(1 + kl.value) FROM kl JOIN need USING (series_id, variable)""",
          doubles=("value",), digits=9, sig=True)
def q_t20_two(spark, sf):
    """The whole transform: verdicts, linearity and minimum decide which columns get a logarithm."""
    lw = D.lineitem_weekly(spark, sf).withColumnRenamed("l_returnflag", "series_id")
    return DG.log_transform(lw, DG.diagnostics_report(lw, _VL_COLS, adf_maxlag=1), _VL_COLS)


@register("T21_var_report_k2", f"""WITH {_LV_SQL}, {_GR_SQL}
SELECT series_id, cause AS CauseVar, effect AS EffectVar, f_stat AS FStatistic, p_value AS PValue, lags AS Lags,
  significant AS Significant FROM gr""", doubles=("FStatistic", "PValue"), digits=6)
def q_t21_k2(spark, sf):
    """The report job with two variables: every table written, the causality table read back."""
    panel = _panel(spark, sf)
    usable = _model(spark, sf, K2)[1].fits.where("status = 'ok'").select("series_id")
    return PL.var_report(spark, panel.join(usable, "series_id", "left_semi"), K2, lags=1, out=_scratch(spark, "var_report"))["granger"]


# --------------------------------------------------------------- whole reports with oracles ---
@register("T19_diagnostics_report_two_lags", f"""WITH {_RESET_SQL}, {_KPSS_AUTO_SQL}, {_VERDICT_SQL},
v AS (SELECT l_returnflag AS series_id, count(*) AS n, sum(l_quantity * l_quantity) AS saa, sum(l_discount * l_discount) AS sbb,
  sum(l_quantity * l_discount) AS sab FROM lw WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL GROUP BY 1),
vv AS (SELECT series_id, CASE WHEN n >= 10 THEN 1 / (1 - sab * sab / (saa * sbb)) END AS vif FROM v)
SELECT st.series_id, st.variable, ta.tau AS adf_stat, kpss.stat AS kpss_stat, kpss.p AS kpss_p, kpss.L AS kpss_lags, st.adf_stationary,
  st.kpss_stationary, st.stationarity, rf.f AS reset_f, rpv.p AS reset_p, coalesce(rpv.p >= 0.05, false) AS is_linear, vv.vif
FROM st JOIN ta USING (series_id, variable) JOIN kpss USING (series_id, variable) JOIN rf USING (series_id, variable)
  JOIN rpv USING (series_id, variable) JOIN vv USING (series_id)""",
          doubles=("adf_stat", "kpss_stat", "kpss_p", "reset_f", "reset_p", "vif"), digits=7, sig=True)
def q_t19_two(spark, sf):
    """The report of all tests in one table, Dickey-Fuller lags 0 and 1; columns long enough to be tested."""
    lw = D.lineitem_weekly(spark, sf).withColumnRenamed("l_returnflag", "series_id")
    report = DG.diagnostics_report(lw, ["l_quantity", "l_discount"], adf_maxlag=1)
    return report.where("adf_stat is not null and kpss_stat is not null").select(
        "series_id", "variable", "adf_stat", "kpss_stat", "kpss_p", "kpss_lags", "adf_stationary", "kpss_stationary", "stationarity",
        "reset_f", "reset_p", "is_linear", "vif")


_ALL_LV_SQL = f"""tt AS ({_TT_SQL}),
lv0 AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY week) - 1 AS t, target AS qty, l_discount AS disc FROM tt),
lv AS (SELECT *, lag(qty) OVER (PARTITION BY series_id ORDER BY t) AS qty1, lag(disc) OVER (PARTITION BY series_id ORDER BY t) AS disc1 FROM lv0),
{_LV_SQL[_LV_SQL.index("bad1 AS"):]}"""


@register("S12_all_series_granger_k2", f"WITH {_ALL_LV_SQL}, {_GR_SQL} SELECT * FROM gr", doubles=("f_stat", "p_value"), digits=6, sig=True)
def q_s12_k2(spark, sf):
    """All configured countries and strains in one job: counts and one covariate, both directions."""
    panel = PL.training_panel(spark, sf).select("series_id", "t", F.col("target").alias("qty"), F.col("l_discount").alias("disc"))
    return granger_matrix(fit_var(panel, K2, VarSpec(1, Det.CONST)))


_SUMMARY_ITEMS = ["k", "lags", "det", "n_obs", "n_reg", "n_lag_params", "c_rows", "c_cols", "n_params", "df_resid"]


@register("T21_var_report_tables_k2", f"""WITH model AS ({CATALOG['T13_summary_k2'].sql}), fc AS ({CATALOG['S7_forecast_wide_k2'].sql}),
gr AS ({CATALOG['T8_T9_granger_k2'].sql}), ir AS ({CATALOG['S8_irf_wide_k2'].sql})
{' UNION ALL '.join(f"SELECT 'model' AS part, series_id, '{c}' AS item, 0 AS at_step, CAST({c} AS DOUBLE) AS value FROM model WHERE status = 'ok'" for c in _SUMMARY_ITEMS)}
UNION ALL SELECT 'forecast', series_id, 'qty', step, qty FROM fc UNION ALL SELECT 'forecast', series_id, 'disc', step, disc FROM fc
UNION ALL SELECT 'granger', series_id, cause || '>' || effect, CASE WHEN significant THEN 1 ELSE 0 END, f_stat FROM gr
UNION ALL SELECT 'irf', series_id, 'Shock_qty', horizon, Shock_qty FROM ir UNION ALL SELECT 'irf', series_id, 'Shock_disc', horizon, Shock_disc FROM ir""",
          doubles=("value",), digits=8, sig=True)
def q_t21_tables(spark, sf):
    """All four tables of the report job, written, read back and put below one another; the mark of a
    causality row is its significance."""
    panel = _panel(spark, sf)
    usable = _model(spark, sf, K2)[1].fits.where("status = 'ok'").select("series_id")
    report = PL.var_report(spark, panel.join(usable, "series_id", "left_semi"), K2, lags=1, out=_scratch(spark, "var_report"))

    def rows(part, df, cols, at):
        long = df.withColumn("_at", at).select("series_id", "_at", *[F.col(c).cast("double").alias(c) for c in cols])
        long = long.unpivot(["series_id", "_at"], cols, "item", "value")
        return long.select(F.lit(part).alias("part"), "series_id", "item", F.col("_at").cast("int").alias("at_step"), "value")

    g = report["granger"]
    causes = g.select(F.lit("granger").alias("part"), "series_id", F.concat("CauseVar", F.lit(">"), "EffectVar").alias("item"),
                      F.col("Significant").cast("int").alias("at_step"), F.col("FStatistic").alias("value"))
    return (rows("model", report["model"], _SUMMARY_ITEMS, F.lit(0)).unionByName(rows("forecast", report["forecast"], K2, F.col("step")))
            .unionByName(causes).unionByName(rows("irf", report["irf"], ["Shock_qty", "Shock_disc"], F.col("horizon"))))


# every replication's refit, Cholesky factor and responses; bands over all replications
_q = CATALOG["T11_bootstrap_irf_k2"]
_q.sql = f"""WITH RECURSIVE {_LV_SQL}, {_PSI_SQL}, {_SIM2_SQL},
bq AS (SELECT series_id, rep, sum((qty - mq) * (disc - md)) AS sqd FROM srr JOIN bm USING (series_id, rep) GROUP BY ALL),
bk AS (SELECT *, (sqq - bq1 * s1q - bq2 * s2q) / (n - 3) AS g11, (sqd - bq1 * s1d - bq2 * s2d) / (n - 3) AS g12,
  (sdd - bd1 * s1d - bd2 * s2d) / (n - 3) AS g22 FROM bb JOIN bq USING (series_id, rep)),
bc AS (SELECT *, sqrt(g11) AS l11, g12 / sqrt(g11) AS l21, sqrt(g22 - g12 * g12 / g11) AS l22 FROM bk),
bpsi AS (SELECT series_id, rep, 0 AS h, 1.0::DOUBLE AS p11, 0.0::DOUBLE AS p12, 0.0::DOUBLE AS p21, 1.0::DOUBLE AS p22 FROM bc
  UNION ALL SELECT bpsi.series_id, bpsi.rep, bpsi.h + 1, bc.bq1 * bpsi.p11 + bc.bq2 * bpsi.p21, bc.bq1 * bpsi.p12 + bc.bq2 * bpsi.p22,
    bc.bd1 * bpsi.p11 + bc.bd2 * bpsi.p21, bc.bd1 * bpsi.p12 + bc.bd2 * bpsi.p22
  FROM bpsi JOIN bc USING (series_id, rep) WHERE bpsi.h < {HORIZON - 1}),
bresp AS (SELECT series_id, CAST(h AS INTEGER) AS horizon, p11 * l11 + p12 * l21 AS qq, p12 * l22 AS qd, p21 * l11 + p22 * l21 AS dq,
  p22 * l22 AS dd FROM bpsi JOIN bc USING (series_id, rep)),
blong AS (SELECT series_id, 'qty' AS shock, 'qty' AS response, horizon, qq AS v FROM bresp UNION ALL SELECT series_id, 'disc', 'qty', horizon, qd FROM bresp
  UNION ALL SELECT series_id, 'qty', 'disc', horizon, dq FROM bresp UNION ALL SELECT series_id, 'disc', 'disc', horizon, dd FROM bresp),
bband AS (SELECT series_id, shock, response, horizon, quantile_cont(v, 0.025) AS lower, quantile_cont(v, 0.975) AS upper, count(*) AS n_reps
  FROM blong GROUP BY ALL)
SELECT irf2.series_id, irf2.shock, irf2.response, irf2.horizon, irf2.value AS point, lower, upper, n_reps
FROM irf2 JOIN bband USING (series_id, shock, response, horizon)"""
_q.doubles, _q.digits, _q.sig = ("point", "lower", "upper"), 7, True
