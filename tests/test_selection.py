"""Counting selection: ordered ranges, positions and quantiles against plain sorting."""

import datetime as dt
import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import selection as S
from panelcast.operators.lags import positional_index
from panelcast.operators.quality import quantiles


def _columns(rng, n):
    inf, nan = float("inf"), float("nan")
    heavy = [rng.choice((-1, 1)) * 10.0 ** rng.uniform(-300, 300) for _ in range(n)]
    near = [1e15 + rng.randrange(4) / 8 for _ in range(n)]
    odd = [rng.choice([0.0, -0.0, inf, -inf, nan, None, 5e-324, -5e-324, 1.7e308, -1.7e308, rng.gauss(0, 1)]) for _ in range(n)]
    longs = [rng.choice([None, 2**63 - 1, -(2**63), 2**62 + rng.randrange(50), -(2**62) + rng.randrange(50), 0]) for _ in range(n)]
    texts = [rng.choice([None, "", "a", "a\0", "a\0\0", "ab", "é", "common prefix " * 9 + chr(97 + rng.randrange(20)) * rng.randrange(5), "z" * rng.randrange(30)]) for _ in range(n)]
    days = [None if rng.random() < 0.1 else dt.date(1, 1, 1) + dt.timedelta(days=rng.randrange(3_000_000)) for _ in range(n)]
    stamps = [dt.datetime(1960, 1, 1) + dt.timedelta(seconds=rng.randrange(10**9)) for _ in range(n)]
    exact = [Decimal(rng.randrange(-(10**20), 10**20)) / 1000 for _ in range(n)]
    return {"heavy double": heavy, "near double": near, "odd double": odd, "longs bigint": longs, "texts string": texts, "days date": days,
            "stamps timestamp_ntz": stamps, "exact decimal(25,3)": exact, "flags boolean": [rng.choice([None, True, False]) for _ in range(n)]}


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(7)
    n = 240
    cols = _columns(rng, n)
    rows = list(zip(range(n), (rng.choice(["a", "b", "b", "b", None]) for _ in range(n)), *cols.values()))
    return spark.createDataFrame(rows, "u int, k string, " + ", ".join(cols)).repartition(5).cache()


@pytest.mark.parametrize("col", ["heavy", "odd", "longs", "texts", "exact"])
def test_positions_in_small_ranges(spark, mixed, col):
    """Every kind of type, with ties settled by the next column, as Spark's own sort numbers them."""
    got = {(r.u): r.t for r in positional_index(mixed, "k", [col, "u"], bucket=20).select("u", "t").collect()}
    ordered = mixed.orderBy("k", col, "u").select("k", "u").collect()
    place, seen = {}, {}
    for r in ordered:
        place[r.u] = seen.get(r.k, 0)
        seen[r.k] = place[r.u] + 1
    assert got == place


def test_ranges_are_bounded_whatever_the_ties(mixed):
    rows, ranges = S.ordered_ranges(mixed.withColumn("one", F.lit("x")), "one", ["flags", "texts", "u"], bucket=15)
    assert ranges.agg(F.max("_n")).first()[0] <= 15
    assert ranges.agg(F.sum("_n")).first()[0] == 240
    counted = {tuple(r._path): r.n for r in rows.groupBy("_path").agg(F.count("*").alias("n")).collect()}
    assert counted == {tuple(r._path): r._n for r in ranges.collect()}


@pytest.mark.parametrize("bucket", [40, None])
def test_quantiles_against_numpy(spark, bucket, monkeypatch):
    if bucket:
        monkeypatch.setattr(S, "BUCKET", bucket)
    rng = np.random.default_rng(3)
    values = {"ties": rng.integers(0, 4, 900) / 10, "normal": rng.normal(size=700), "one": np.array([2.5]), None: rng.exponential(size=300) ** 9}
    rows = [(k, float(v)) for k, own in values.items() for v in own] + [("ties", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    wanted = {"low": 0.0, "a": 0.025, "mid": 0.5, "b": 0.975, "high": 7.0}
    got = {r.k: r for r in quantiles(df, ["k"], "v", wanted).collect()}
    assert set(got) == set(values)
    for k, own in values.items():
        for name, q in wanted.items():
            assert math.isclose(got[k][name], np.quantile(own, min(q, 1.0)), rel_tol=1e-12, abs_tol=1e-300)
    whole = quantiles(df, [], "v", {"m": 0.5}).collect()
    assert len(whole) == 1 and math.isclose(whole[0].m, np.median(np.concatenate(list(values.values()))), rel_tol=1e-12)
    assert quantiles(df.where("v > 1e300"), [], "v", {"m": 0.5}).count() == 0


def test_quantiles_of_few_values_need_no_window_and_no_list(spark, monkeypatch):
    """Eleven values: counts alone settle it; the rows are neither sorted nor collected."""
    monkeypatch.setattr(S, "BUCKET", 50)
    df = spark.range(5000).select((F.col("id") % 11 / 100).alias("v"))
    out = quantiles(df, [], "v", {"m": 0.5, "q": 0.9})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and out.collect()[0].asDict() == {"m": 0.05, "q": 0.09}
