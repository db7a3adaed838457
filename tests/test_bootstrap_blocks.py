"""Series that no task may hold: simulated in blocks, chained by affine maps, equal to the recursion as a whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import panel_df
from panelcast.operators import bootstrap as B
from panelcast.operators import kernels as K
from panelcast.operators.var import fit_var
from panelcast.spec import Det, VarSpec


def _data(n, seed, k):
    rng = np.random.default_rng(seed)
    y = np.zeros((n, k))
    for t in range(2, n):
        y[t] = 0.5 * y[t - 1] - 0.2 * y[t - 2][::-1] + rng.normal(size=k) + 0.01 * t
    return y


@pytest.fixture(scope="module", params=[(Det.CONST, 2), (Det.CONST_TREND, 1)], ids=str)
def fitted(spark, request):
    det, lags = request.param
    cases = {"long": _data(203, 1, 2), "longer": _data(260, 2, 2), "short": _data(40, 3, 2)}
    panel = panel_df(spark, {k: v.tolist() for k, v in cases.items()}, 2).cache()
    return panel, fit_var(panel, ["var0", "var1"], VarSpec(lags, det))


def _in_blocks(monkeypatch):
    """Only the 40 rows of one series may be held; the others fall into ten blocks and more."""
    monkeypatch.setattr(B, "LONG", 100)
    monkeypatch.setattr(B, "BLOCK", 20)


def test_simulation_in_ten_blocks(spark, fitted, monkeypatch):
    panel, model = fitted
    key = lambda r: (r.series_id, r.rep, r.t)
    whole = sorted(B.simulate_series(model, panel, 3, seed=5).collect(), key=key)
    _in_blocks(monkeypatch)
    parts = sorted(B.simulate_series(model, panel, 3, seed=5).collect(), key=key)
    assert [key(r) for r in whole] == [key(r) for r in parts] and len(whole) == 3 * (203 + 260 + 40)
    a, b = (np.array([[r.var0, r.var1] for r in rows]) for rows in (whole, parts))
    assert np.allclose(a, b, rtol=1e-9, atol=1e-9)


def test_bands_and_p_values_from_blocks(spark, fitted, monkeypatch):
    panel, model = fitted

    def run():
        irf = {(r.series_id, r.shock, r.response, r.horizon): (r.lower, r.upper, r.n_reps) for r in B.bootstrap_irf(model, panel, 20, 4, 0.1, 3).collect()}
        granger = {(r.series_id, r.cause, r.effect): (r.boot_p, r.n_reps) for r in B.bootstrap_granger(model, panel, 20, seed=3).collect()}
        return irf, granger

    whole = run()
    _in_blocks(monkeypatch)
    parts = run()
    for a, b in zip(whole, parts):
        assert a.keys() == b.keys()
        assert all(np.allclose(a[k], b[k], rtol=1e-7, atol=1e-9) for k in a)


def test_a_block_is_one_affine_map():
    rng = np.random.default_rng(1)
    a, c = rng.normal(size=(3, 2, 2)) * 0.3, rng.normal(size=(2, 2))
    spec = VarSpec(3, Det.CONST_TREND)
    start, eps = rng.normal(size=(3, 2)), rng.normal(size=(7, 2))
    at_zero = B._run_block(np.zeros((3, 2)), eps, a, c, spec, 11)[-3:].ravel()
    chained = np.linalg.matrix_power(B._companion(a), 7) @ start.ravel() + at_zero
    assert np.allclose(chained, B._run_block(start, eps, a, c, spec, 11)[-3:].ravel())


def test_draws_of_the_engine_are_those_of_the_kernel(spark):
    idx = K.draw_index(9, "s", 4, 50)
    rows = spark.range(50).select(F.md5(F.concat_ws(":", F.lit("9"), F.lit("s"), F.lit("4"), F.col("id").cast("string")).cast("binary")).alias("d"))
    got = rows.select((F.conv(F.substring("d", 1, 8), 16, 10).cast("bigint") % 50).alias("j")).collect()
    assert [r.j for r in got] == idx.tolist()


def test_items_follow_cost_and_shuffle_rows_are_items(spark, fitted, monkeypatch):
    """Few series: enough items for the cores. Much work: items of a fixed size. Never a task per item of a large panel."""
    panel, model = fitted
    cores = spark.sparkContext.defaultParallelism
    items = B._replicate(model, panel, 100, None, "t")
    n = items.groupBy("series_id").count().collect()
    assert all(r["count"] <= -(-2 * cores // 3) + 1 for r in n) and items.rdd.getNumPartitions() <= 4 * cores
    monkeypatch.setattr(B, "WORK", 4000)
    items = B._replicate(model, panel, 100, None, "t").select("series_id", "n_reg", "_rep_lo", "_rep_hi").collect()
    assert all((r._rep_hi - r._rep_lo) * r.n_reg * 2 <= 4000 or r._rep_hi - r._rep_lo == 1 for r in items)
    assert sum(r._rep_hi - r._rep_lo for r in items) == 300


def test_one_variable_has_no_pairs(spark):
    panel = panel_df(spark, {"s": [[float(x)] for x in np.random.default_rng(2).normal(size=40)]}, 1)
    model = fit_var(panel, ["var0"], VarSpec(1, Det.CONST))
    assert B.bootstrap_granger(model, panel, 5).count() == 0
    assert B.bootstrap_irf(model, panel, 5, 3).count() == 3
