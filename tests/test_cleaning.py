"""Cleaning layer: calendars, grids, gap filling, quality ranking, readers, scalar functions."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.functions import scalar as S
from panelcast.operators import interp, quality
from panelcast.operators.filters import filter_upper_equals, year_at_least
from panelcast.operators.joins import join_many_to_one
from panelcast.operators.resample import hourly_grid, weekly_rollup
from panelcast.sources.readers import read_station_file, require_columns


def test_week_label_boundaries_and_iso_year(spark):
    days = ["2024-01-01", "2024-01-02", "2024-01-07", "2024-01-08", "2024-12-30", "2024-12-31"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.to_date("d").alias("d"))
    got = {str(r.d): r for r in df.select("d", S.week_end_monday("d").alias("end"), S.week_start_monday("d").alias("start"),
                                         S.iso_year("d").alias("y"), S.iso_week("d").alias("w")).collect()}
    # Monday closes its own bin; Tuesday..Sunday belong to the next Monday
    assert str(got["2024-01-01"].end) == "2024-01-01"
    assert str(got["2024-01-02"].end) == "2024-01-08"
    assert str(got["2024-01-07"].end) == "2024-01-08"
    assert str(got["2024-01-08"].start) == "2024-01-08"
    assert (got["2024-12-30"].y, got["2024-12-30"].w) == (2025, 1)


def test_weekly_rollup_matches_pandas_resample(spark):
    idx = pd.date_range("2024-01-02 00:00", "2024-02-20 23:00", freq="h")
    rng = np.random.default_rng(0)
    temp = rng.standard_normal(len(idx))
    rain = rng.random(len(idx))
    temp[100:300] = np.nan
    rain[150:400] = np.nan  # includes a whole week without rain readings
    sid = np.where(rng.random(len(idx)) < 0.5, "A", "B").astype(object)
    sid[400:600] = None
    pdf = pd.DataFrame({"ts": idx, "temperature": temp, "precipitation": rain, "Station_ID": sid})
    expected = pdf.set_index("ts").resample("W-MON").agg({"temperature": "mean", "precipitation": "sum", "Station_ID": "first"})
    sdf = spark.createDataFrame(pdf.assign(k="x")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    sdf = sdf.withColumn("temperature", S.nan_to_null("temperature")).withColumn("precipitation", S.nan_to_null("precipitation"))
    got = weekly_rollup(sdf, ["k"], "ts", ["temperature"], ["precipitation"], ["Station_ID"]).orderBy("week").toPandas()
    assert [str(d) for d in got.week] == [str(d.date()) for d in expected.index]
    assert np.allclose(got.temperature.astype(float), expected.temperature, equal_nan=True)
    assert np.allclose(got.precipitation, expected.precipitation)
    assert list(got.t) == list(range(len(got)))
    # first non-null within the week, by time
    assert list(got.Station_ID.fillna("-")) == list(expected.Station_ID.fillna("-"))


def test_hourly_grid_exact_mode_drops_off_grid(spark):
    rows = [("s", dt.datetime(2024, 1, 1, 0, 30), 1.0), ("s", dt.datetime(2024, 1, 1, 1, 0), 2.0),
            ("s", dt.datetime(2024, 1, 1, 1, 30), 3.0), ("s", dt.datetime(2024, 1, 1, 3, 30), 4.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    exact = hourly_grid(df, ["k"], "ts", ["v"], mode="exact").orderBy("t").collect()
    assert [r.v for r in exact] == [1.0, 3.0, None, 4.0]
    trunc = hourly_grid(df, ["k"], "ts", ["v"]).orderBy("t").collect()
    assert [r.v for r in trunc] == [1.0, 2.5, None, 4.0]
    dup = df.unionByName(df.limit(1))
    with pytest.raises(ValueError):
        hourly_grid(dup, ["k"], "ts", ["v"], mode="exact", check_unique=True)


def test_interpolation_matches_pandas(spark):
    vals = {"g1": [None, None, 1.0, None, None, 4.0, None, 10.0, None],
            "g2": [None, None, None], "g3": [5.0, None, None, None, 1.0]}
    rows = [(k, i, v) for k, vs in vals.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "k string, i bigint, v double")
    got = interp.interpolate_linear(df, ["k"], ["i"], ["v"]).collect()
    for k, vs in vals.items():
        exp = pd.Series(vs, dtype=float).interpolate(method="linear", limit_direction="both")
        g = [r.v for r in sorted(got, key=lambda r: r.i) if r.k == k]
        assert np.allclose(np.array(g, dtype=float), exp.to_numpy(), equal_nan=True)
    z = interp.zero_fill(interp.ffill_bfill(df, ["k"], ["i"], ["v"]), ["v"]).collect()
    assert all(r.v == 0.0 for r in z if r.k == "g2")


def test_interpolation_rounds_half_even(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("a", 2, 4.0)], "k string, i bigint, v double")
    assert interp.interpolate_linear(df, ["k"], ["i"], ["v"], round_digits=0).orderBy("i").collect()[1].v == 2.0


def test_null_ranking_formulas_and_ties(spark):
    # two groups with equal totals: code breaks the tie
    rows = [("QAT", i, 1.0, 1.0, None if i < 55 else 2.0) for i in range(774)] + \
           [("SGP", i, None if i < 17 else 1.0, None if i < 17 else 1.0, None if i < 127 else 1.0) for i in range(1008)] + \
           [("AAA", i, None if i < 55 else 1.0, 1.0, 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "code string, i int, a double, b double, c double")
    r = {x.code: x for x in quality.null_count_ranking(df, ["code"], ["a", "b", "c"]).collect()}
    assert (r["QAT"].Total_NaN_Count, r["QAT"].NaN_Percentage, r["QAT"].Data_Quality_Score) == (55, 2.37, 97.63)
    assert (r["SGP"].Total_NaN_Count, r["SGP"].NaN_Percentage, r["SGP"].Data_Quality_Score) == (161, 5.32, 94.68)
    assert (r["AAA"].Rank, r["QAT"].Rank, r["SGP"].Rank) == (1, 2, 3)
    b = quality.quality_buckets(quality.null_count_ranking(df, ["code"], ["a", "b", "c"])).first()
    assert (b.excellent, b.good, b.fair, b.poor) == (2, 1, 0, 0)  # AAA scores 81.67


def test_nan_summary_sorted(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, 1.0)], "x double, y double")
    got = quality.nan_summary(df).collect()
    assert [(r.column, r.NaN_count) for r in got] == [("y", 2), ("x", 1)]
    assert got[0].NaN_fraction == pytest.approx(2 / 3)


def test_lenient_parse_and_names(spark):
    df = spark.createDataFrame([("12.5",), ("9x",), ("NaN",), (None,), ("2000.0",)], "s string")
    got = [r[0] for r in df.select(S.lenient_double("s")).collect()]
    assert got == [12.5, None, None, None, 2000.0]
    assert [r[0] for r in df.select(S.lenient_int("s")).collect()] == [None, None, None, None, 2000]
    assert S.log_column_name("sea level pressure") == "LOG_SEA_LEVEL_PRESSURE"
    ts = spark.range(1).select(S.timestamp_from_parts(F.lit("2024"), F.lit("2"), F.lit("30"), F.lit("1"), F.lit("0"))).first()[0]
    assert ts is None


def test_filters_and_join(spark):
    df = spark.createDataFrame([("qat", "1999"), ("QAT", "2001"), ("sgp", "x")], "code string, Year string")
    assert filter_upper_equals(df, "code", "Qat").count() == 2
    with pytest.raises(ValueError):
        filter_upper_equals(df, "country", "QAT")
    assert [r.Year for r in year_at_least(df, "Year", 2000).collect()] == ["2001"]
    left = spark.createDataFrame([(2024, 1, 1.0), (2024, 1, 2.0), (2024, 2, 3.0)], "y int, w int, v double")
    right = spark.createDataFrame([(2024, 1, 10.0), (2024, 1, 11.0)], "y int, w int, x double")
    with pytest.raises(ValueError):
        join_many_to_one(left, right, ["y", "w"], validate=True)
    assert join_many_to_one(left, right.limit(1), ["y", "w"], validate=True).count() == 2
    with pytest.raises(ValueError):
        require_columns(df, ["code", "missing"])


def test_station_file_scan(spark, tmp_path):
    header = "Station_ID|Station_name|Year|Month|Day|Hour|Minute|temperature|junk_col|precipitation"
    lines = [header, "S1|Alpha|1999|12|31|23|00|250|x|1", "S1|Alpha|2000|01|01|00|00|251|y|", "S1|Alpha|bad|01|01|01|00|252|z|0",
             "S1|Alpha|2001|02|03|04|00|9x|w|2"]
    p = tmp_path / "station.psv"
    p.write_text("\n".join(lines) + "\n")
    df = read_station_file(spark, str(p), year_min=2000)
    assert "junk_col" not in df.columns and "temperature" in df.columns
    assert [r.Year for r in df.collect()] == ["2000", "2001"]
    assert dict(df.dtypes)["temperature"] == "string"
    with pytest.raises(ValueError):
        read_station_file(spark, str(p), year_min=2100, check_nonempty=True)
    temps = [r[0] for r in df.select(S.scale("temperature", 10.0)).collect()]
    assert temps == [25.1, None]


def test_hourly_index_ignores_session_time_zone(spark):
    rows = [("s", "2024-03-10 00:10:00", 1.0), ("s", "2024-03-10 05:00:00", 2.0)]
    df = spark.createDataFrame(rows, "k string, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # DST starts 2024-03-10 02:00
        got = hourly_grid(df, ["k"], "ts", ["v"]).orderBy("ts").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert [r.t for r in got] == list(range(6))
    assert [str(r.ts) for r in got][:3] == ["2024-03-10 00:00:00", "2024-03-10 01:00:00", "2024-03-10 02:00:00"]


@pytest.mark.parametrize("block", [2, 3, 1000])
def test_blocked_scans_cross_block_borders(spark, block):
    from panelcast.operators.scan import prefix_sum
    vals = {"g1": [None, None, 1.0, None, None, 4.0, None, None, None, 10.0, None],
            "g2": [None] * 5, "g3": [5.0, None, None, None, None, None, 1.0]}
    rows = [(k, i, v) for k, vs in vals.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "k string, i bigint, v double")
    got = interp.interpolate_linear(df, ["k"], ["i"], ["v"], position="i", block=block).collect()
    ff = interp.ffill_bfill(df, ["k"], ["i"], ["v"], position="i", block=block).collect()
    ps = prefix_sum(df, ["k"], "i", "v", "cs", block=block).collect()
    for k, vs in vals.items():
        s = pd.Series(vs, dtype=float)
        exp = s.interpolate(method="linear", limit_direction="both")
        g = [r.v for r in sorted(got, key=lambda r: r.i) if r.k == k]
        assert np.allclose(np.array(g, dtype=float), exp.to_numpy(), equal_nan=True)
        f = [r.v for r in sorted(ff, key=lambda r: r.i) if r.k == k]
        assert np.allclose(np.array(f, dtype=float), s.ffill().bfill().to_numpy(), equal_nan=True)
        c = [r.cs for r in sorted(ps, key=lambda r: r.i) if r.k == k]
        assert np.allclose(c, s.fillna(0).cumsum().to_numpy())


def test_interpolation_whole_frame_without_keys(spark):
    vals = [None, 2.0, None, None, 8.0, None]
    df = spark.createDataFrame([(float(i), v) for i, v in enumerate(vals)], "week double, v double")
    got = [r.v for r in interp.interpolate_linear(df, [], ["week"], ["v"], block=2).orderBy("week").collect()]
    assert np.allclose(got, pd.Series(vals, dtype=float).interpolate(limit_direction="both").to_numpy())


def test_station_weekly_job_semantics(spark, tmp_path):
    from panelcast.plans.pipelines import station_weekly
    header = "Station_ID|Station_name|Year|Month|Day|Hour|Minute|Latitude|temperature|precipitation|precipitation_24_hour|sky_cover_1"
    lines = [header,
             "S1|Alpha|2024|01|02|00|00|1.5|250|1|5|CLR",     # week closing Mon 2024-01-08
             "S1|Alpha|2024|01|02|00|30|1.5|270||6|CLR",      # same hour: averaged
             "S1|Alpha|2024|01|03|05|00|1.5|bad|2||FEW",
             "S1|Alpha|2024|01|17|01|00|1.5|300|4|7|OVC",     # week closing Mon 2024-01-22; 2024-01-15 empty
             "S1|Alpha|2024|02|30|01|00|1.5|300|4|7|OVC"]     # invalid date: dropped
    p = tmp_path / "st.psv"
    p.write_text("\n".join(lines) + "\n")
    raw = read_station_file(spark, str(p), year_min=2000)
    weekly, summary = station_weekly(raw)
    rows = {str(r.iso_weekstartdate): r for r in weekly.collect()}
    assert sorted(rows) == ["2024-01-08", "2024-01-15", "2024-01-22"]
    assert "sky_cover_1" not in weekly.columns
    w1 = rows["2024-01-08"]
    assert w1.temperature == pytest.approx(26.0)          # hourly mean of 25.0 and 27.0, tenths scaled
    assert w1.precipitation == pytest.approx(3.0) and w1.precipitation_24_hour == pytest.approx(5.5)
    assert w1.Station_name == "Alpha" and w1.Latitude == 1.5
    w2 = rows["2024-01-15"]
    assert w2.temperature is None and w2.precipitation == 0.0 and w2.Station_name is None
    assert (w1.iso_year, w1.iso_week) == (2024, 2)
    s = {r.column: r.NaN_count for r in summary.collect()}
    assert s["temperature"] == 1 and s["precipitation"] == 0


def test_week_label_start_option(spark):
    df = spark.createDataFrame([("k", "2024-01-02", 1.0), ("k", "2024-01-08", 2.0)], "k string, d string, v double") \
        .withColumn("d", F.to_date("d"))
    got = weekly_rollup(df, ["k"], "d", ["v"], label="start").orderBy("week").collect()
    assert [str(r.week) for r in got] == ["2024-01-01", "2024-01-08"]
    assert [r.v for r in got] == [1.0, 2.0]


def test_all_fills_in_one_pass(spark):
    """Linear, then both ends, then zero for a series without any value; one neighbour window in the plan."""
    vals = {"g1": [None, 1.0, None, 4.0, None], "g2": [None] * 3, "g3": [5.0, None, None, None, 1.0]}
    rows = [(k, i, v, None if v is None else -v) for k, vs in vals.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "k string, i bigint, v double, w double")
    old = interp.interpolate_linear(df, ["k"], ["i"], ["v", "w"], round_digits=0, position="i", block=2)
    old = interp.zero_fill(interp.ffill_bfill(old, ["k"], ["i"], ["v", "w"], position="i", block=2), ["v", "w"])
    new = interp.fill_gaps(df, ["k"], ["i"], ["v", "w"], round_digits=0, position="i", block=2)
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, old.collect()))
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [last") <= 2  # rows within blocks, and the summary of blocks
    kept = interp.fill_gaps(df, ["k"], ["i"], ["v"], zero=False).where("k = 'g2'").collect()
    assert [r.v for r in kept] == [None] * 3


def test_checks_ride_on_the_plan(spark):
    """Unique keys and NULL values are checked by the job that reads them, with one scan of the checked side."""
    from panelcast.sources.readers import load_series
    left = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "y int, w int, l string")
    right = spark.createDataFrame([(1, 1, 5.0, None), (1, 2, None, "x")], "y int, w int, v double, s string")
    out = join_many_to_one(left, right, ["y", "w"], validate="plan")
    assert out.columns == ["y", "w", "l", "v", "s"]
    assert sorted(map(tuple, out.collect())) == [(1, 1, "a", 5.0, None), (1, 2, "b", None, "x")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
    with pytest.raises(Exception, match="not unique"):
        join_many_to_one(left, right.union(right), ["y", "w"], validate="plan").collect()
    series = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None)], "series_id string, t int, v double")
    with pytest.raises(Exception, match="NULL value in column v"):
        load_series(series, ["v"], check="plan").collect()
    assert load_series(series.where("v is not null"), ["v"], check="plan").count() == 1
