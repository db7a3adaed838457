"""Sinks (long tables, wide pivots, published layouts), multi-path scans, case-insensitive lookup."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import panel_df
from panelcast.operators.bootstrap import bootstrap_granger, bootstrap_irf
from panelcast.operators.forecast import forecast
from panelcast.operators.granger import granger_matrix
from panelcast.operators.var import fit_var
from panelcast.sources import sinks
from panelcast.sources.readers import read_station_file, read_table
from panelcast.spec import Det, VarSpec


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(4)
    y = np.cumsum(rng.standard_normal((60, 2)), axis=0) * 0.1 + rng.standard_normal((60, 2))
    panel = panel_df(spark, {"s": y.tolist()}, 2)
    return panel, fit_var(panel, ["var0", "var1"], VarSpec(1, Det.CONST))


def test_granger_sink_round_trip(spark, fitted, tmp_path):
    _, model = fitted
    out = sinks.granger_output(granger_matrix(model))
    assert out.columns == ["series_id", "CauseVar", "EffectVar", "FStatistic", "PValue", "Lags", "Significant"]
    path = str(tmp_path / "granger")
    sinks.write_table(out, path, fmt="csv", partition_by=["series_id"], digits=6)
    back = read_table(spark, path, fmt="csv")
    rows = back.collect()
    assert len(rows) == 2 and all(r.CauseVar != r.EffectVar for r in rows)
    assert all(len(r.PValue.split(".")[-1]) <= 6 for r in rows)


def test_bootstrap_sinks(spark, fitted, tmp_path):
    panel, model = fitted
    bi = sinks.bootstrap_irf_output(bootstrap_irf(model, panel, reps=10, horizon=3, seed=1))
    assert bi.columns[1:] == ["ShockVar", "ResponseVar", "Horizon", "Point", "Lower", "Upper"]
    bg = sinks.bootstrap_granger_output(bootstrap_granger(model, panel, reps=10, seed=1))
    assert bg.columns[1:] == ["CauseVar", "EffectVar", "FStatistic", "AsymptoticP", "BootPValue", "Lags",
                              "Significant_Asymptotic", "Significant_Bootstrap"]
    sinks.write_table(bg, str(tmp_path / "bg"), fmt="parquet")
    assert spark.read.parquet(str(tmp_path / "bg")).count() == 2


def test_forecast_wide_names(spark, fitted):
    panel, model = fitted
    fl = forecast(model, panel, 3)
    w = sinks.forecast_wide(fl, ["var0", "var1"], names=["a", "b"])
    assert w.columns == ["series_id", "step", "a", "b"]
    w2 = sinks.forecast_wide(fl, ["var0", "var1"], names=["only_one"])
    assert w2.columns == ["series_id", "step", "Var1", "Var2"]


def test_multi_path_union_scan(spark, tmp_path):
    header = "Station_ID|Year|Month|Day|Hour|Minute|temperature"
    for i, year in enumerate((1999, 2003)):
        (tmp_path / f"s{i}.psv").write_text(f"{header}\nS{i}|{year}|1|1|0|0|{100 + i}\n")
    df = read_station_file(spark, [str(tmp_path / "s0.psv"), str(tmp_path / "s1.psv")], year_min=1990)
    assert sorted(r.Station_ID for r in df.collect()) == ["S0", "S1"]


def test_case_insensitive_lookup(spark):
    df = spark.createDataFrame([("QAT", 1.0)], "COUNTRY_CODE string, INF_A double")
    assert df.select("country_code", "inf_a").first() == ("QAT", 1.0)


def test_configuration_drives_the_training_table(spark):
    """Only configured countries, their own source, their own columns; a repeated code raises."""
    from panelcast.plans import pipelines as PL
    sf = "/root/testdata/sf0.001"
    one, two = sorted(r.n_name for r in spark.read.parquet(f"{sf}/nation.parquet").collect())[:2]
    config = spark.createDataFrame([(one, "A", ["l_tax"]), (two, "R", ["l_discount", "l_quantity"])],
                                   "code string, source string, covariates array<string>")
    rows = PL.training_table(spark, sf, config).collect()
    assert {(r.n_name, r.source) for r in rows} == {(one, "A"), (two, "R")}
    assert all((r.l_tax is not None, r.l_discount is None) == (r.n_name == one,) * 2 for r in rows)
    with pytest.raises(ValueError):
        PL.training_table(spark, sf, config.union(config))


def test_station_files_of_different_layouts(spark, tmp_path):
    from panelcast.sources.readers import read_station_file
    (tmp_path / "a.csv").write_text("Station_ID|Year|temperature|wind_speed\nx|2001|7|100\n")
    (tmp_path / "b.csv").write_text("wind_speed|temperature|Station_ID|Year|visibility\n200|8|y|2002|5\n")
    rows = {r.Station_ID: r for r in read_station_file(spark, str(tmp_path)).collect()}
    assert (rows["x"].temperature, rows["x"].wind_speed, rows["x"].visibility) == ("7", "100", None)
    assert (rows["y"].temperature, rows["y"].wind_speed, rows["y"].visibility) == ("8", "200", "5")


def test_input_checks(spark):
    from panelcast.sources.readers import load_series
    load = lambda rows: load_series(spark.createDataFrame(rows, "series_id string, t bigint, v double"), ["v"], check=True)
    assert load([("a", 0, 1.0), ("a", 1, 2.0)]).count() == 2
    for rows in ([], [("a", 0, None)], [("a", 1, 1.0), ("a", 2, 1.0)], [("a", 0, 1.0), ("a", 2, 1.0)], [("a", 0, 1.0), ("a", 0, 1.0), ("a", 1, 1.0)]):
        with pytest.raises(ValueError):
            load(rows)


def test_station_heads_of_many_files_in_one_job(spark, tmp_path):
    """Three layouts over sixty files, a quoted name, a byte-order mark, an empty file."""
    from panelcast.sources.readers import station_layouts
    heads = ["Station_ID|Year|temperature", "Year|Station_ID", '﻿"Station_ID"|temperature|Year']
    for i in range(60):
        body = "".join(f"{x}|{y}|{z}\n"[: 6 if i % 3 == 1 else None] for x, y, z in [(1, 2, 3)] * (i % 5))
        (tmp_path / f"f{i:02}.psv").write_text(heads[i % 3] + "\n" + body)
    (tmp_path / "none.psv").write_text("")
    group = "station-heads"
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = station_layouts(spark, str(tmp_path))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {k: len(v) for k, v in found.items()} == {("Station_ID", "Year", "temperature"): 20, ("Year", "Station_ID"): 20, ("Station_ID", "temperature", "Year"): 20}
    assert len(jobs) <= 3  # the shuffle's map stage, its result, a coalesced read: whatever the number of files


def test_partitions_are_replaced_and_pruned(spark, tmp_path):
    from panelcast.plans import pipelines as PL
    path = str(tmp_path / "tables")
    rows = [(f"{c}|{s}", c, s, w, float(w)) for c in ("X", "Y", None) for s in ("A", "B") for w in range(5)]
    table = spark.createDataFrame(rows, "series_id string, n_name string, strain string, week int, target double").repartition(7)
    PL.write_training_tables(table, path)
    files = len(list((tmp_path / "tables").glob("n_name=X/strain=A/*.parquet")))
    assert files == 1  # rebalanced: not one file per task
    PL.write_training_tables(table.where("n_name = 'X'").withColumn("target", F.lit(-1.0)), path)
    back = PL.read_training_tables(spark, path)
    assert back.columns == table.columns and back.count() == 30
    assert back.where("target = -1").count() == 10 and back.where("target = -1 and n_name <> 'X'").count() == 0
    one = PL.read_training_tables(spark, path, country="Y", strain="B")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 5 and "PartitionFilters: [isnotnull(n_name" in plan
    assert len(one.inputFiles()) == 1 or one.select(F.input_file_name()).distinct().count() == 1
