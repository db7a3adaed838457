"""VAR numerics against direct least squares; invariants; partition independence."""

import numpy as np
import pytest

from conftest import panel_df
from panelcast.operators import kernels as K
from panelcast.operators.bootstrap import bootstrap_granger, simulate_series
from panelcast.operators.granger import granger_matrix
from panelcast.operators.var import fit_var
from panelcast.spec import Det, VarSpec

VARS3 = ["var0", "var1", "var2"]


def _var_data(n, seed, k=3):
    rng = np.random.default_rng(seed)
    a1 = np.array([[0.5, 0.1, 0.0], [0.2, 0.3, 0.1], [0.0, 0.2, 0.4]])[:k, :k]
    a2 = np.array([[0.1, 0.0, 0.05], [0.0, 0.1, 0.0], [0.05, 0.0, 0.1]])[:k, :k]
    y = np.zeros((n, k))
    for t in range(2, n):
        y[t] = 1.0 + 0.01 * t + a1 @ y[t - 1] + a2 @ y[t - 2] + rng.standard_normal(k)
    return y


@pytest.mark.parametrize("det", [Det.NONE, Det.CONST, Det.TREND, Det.CONST_TREND])
def test_fit_matches_lstsq(spark, det):
    ys = {f"s{i}": _var_data(120 + 10 * i, i) for i in range(3)}
    spec = VarSpec(2, det)
    model = fit_var(panel_df(spark, {k: v.tolist() for k, v in ys.items()}, 3), VARS3, spec)
    fits = {r.series_id: r for r in model.fits.collect()}
    for sid, y in ys.items():
        x, yy = K.design(y, 2, spec.has_const, spec.has_trend)
        b = np.linalg.lstsq(x, yy, rcond=None)[0]
        u = yy - x @ b
        m = x.shape[1]
        got = np.array(fits[sid].coef).reshape(m, 3)
        assert np.allclose(got, b, atol=1e-8)
        assert np.allclose(np.array(fits[sid].sigma).reshape(3, 3), u.T @ u / (len(yy) - m), atol=1e-8)
        assert fits[sid].n_obs == len(y) and fits[sid].n_reg == len(y) - 2


def test_granger_matches_restricted_regressions(spark):
    y = _var_data(150, 11)
    model = fit_var(panel_df(spark, {"g": y.tolist()}, 3), VARS3, VarSpec(2, Det.CONST))
    rows = {(r.cause, r.effect): r for r in granger_matrix(model).collect()}
    x, yy = K.design(y, 2, True, False)
    n, m = x.shape
    from panelcast.functions.fdist import f_sf_numpy
    for c in range(3):
        keep = [0] + [1 + j * 3 + v for j in range(2) for v in range(3) if v != c]
        for e in range(3):
            if c == e:
                continue
            ru = yy[:, e] - x @ np.linalg.lstsq(x, yy[:, e], rcond=None)[0]
            rr = yy[:, e] - x[:, keep] @ np.linalg.lstsq(x[:, keep], yy[:, e], rcond=None)[0]
            f = ((rr @ rr - ru @ ru) / 2) / (ru @ ru / (n - m))
            r = rows[(f"var{c}", f"var{e}")]
            assert r.f_stat == pytest.approx(f, rel=1e-8)
            assert r.p_value == pytest.approx(float(f_sf_numpy(f, 2, n - m)), abs=1e-10)
            assert r.df_den == n - m


def test_residuals_orthogonal_to_design(spark):
    y = _var_data(100, 5)
    panel = panel_df(spark, {"r": y.tolist()}, 3)
    model = fit_var(panel, VARS3, VarSpec(2, Det.CONST))
    u = np.array([[r.var0, r.var1, r.var2] for r in sorted(model.residuals(panel).collect(), key=lambda r: r.t)])
    x, _ = K.design(y, 2, True, False)
    assert np.abs(x.T @ u).max() < 1e-6


def test_collinear_columns_use_min_norm(spark):
    rng = np.random.default_rng(0)
    a = np.cumsum(rng.standard_normal(60)) + 10
    y = np.column_stack([a, 2.0 * a])
    model = fit_var(panel_df(spark, {"c": y.tolist()}, 2), ["var0", "var1"], VarSpec(1, Det.CONST))
    f = model.fits.first()
    assert f.status == "ok" and f.solver == "min_norm"
    x, yy = K.design(y, 1, True, False)
    b = np.linalg.lstsq(x, yy, rcond=1e-12)[0]
    assert np.allclose(np.array(f.coef).reshape(3, 2), b, atol=1e-6)


def test_too_short_and_null_input_status(spark):
    cases = {"short": [[1.0, 2.0]], "ok": _var_data(30, 1, 2).tolist(), "nul": _var_data(30, 2, 2).tolist()}
    cases["nul"][10][1] = None
    df = spark.createDataFrame([(s, t, *(None if v is None else float(v) for v in row))
                                for s, rows in cases.items() for t, row in enumerate(rows)],
                               "series_id string, t bigint, var0 double, var1 double")
    status = {r.series_id: r.status for r in fit_var(df, ["var0", "var1"], VarSpec(1)).fits.collect()}
    assert status == {"short": "too_short", "ok": "ok", "nul": "null_input"}


def test_long_series_lag_blocks(spark):
    """A series longer than the lag block gives the same Gram as one window."""
    from panelcast.operators.lags import lag_embed
    y = _var_data(300, 4, 2)
    panel = panel_df(spark, {"L": y.tolist()}, 2)
    a = lag_embed(panel, ["var0", "var1"], 3, block=64).orderBy("t").collect()
    b = lag_embed(panel, ["var0", "var1"], 3, block=100000).orderBy("t").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]
    assert len(a) == 297


def test_same_seed_any_partitioning(spark):
    y = _var_data(80, 8, 2)
    panel = panel_df(spark, {"p": y.tolist(), "q": _var_data(70, 9, 2).tolist()}, 2)
    model = fit_var(panel, ["var0", "var1"], VarSpec(1, Det.CONST))
    a = sorted(tuple(r) for r in simulate_series(model, panel.repartition(1), 4, seed=3, block=1).collect())
    b = sorted(tuple(r) for r in simulate_series(model, panel.repartition(8), 4, seed=3, block=3).collect())
    assert a == b
    g1 = sorted(tuple(r) for r in bootstrap_granger(model, panel.repartition(1), reps=12, seed=2, block=12).collect())
    g8 = sorted(tuple(r) for r in bootstrap_granger(model, panel.repartition(8), reps=12, seed=2, block=2).collect())
    assert g1 == g8


def test_draw_index_matches_md5_rule():
    import hashlib
    idx = K.draw_index(7, "A", 2, 100)
    for i in (0, 5, 99):
        h = int(hashlib.md5(f"7:A:2:{i}".encode()).hexdigest()[:8], 16)
        assert idx[i] == h % 100


def test_positional_index_distributed(spark):
    from pyspark.sql import functions as F
    from panelcast.operators.lags import positional_index
    rng = np.random.default_rng(1)
    rows = [(s, float(x)) for s, n in (("a", 500), ("b", 37), ("c", 1)) for x in rng.permutation(n * 3)[:n]]
    df = spark.createDataFrame(rows, "series_id string, ord double").repartition(5)
    got = positional_index(df, "series_id", ["ord"], buckets=13).collect()
    for s in ("a", "b", "c"):
        vals = sorted((r.ord, r.t) for r in got if r.series_id == s)
        assert [t for _, t in vals] == list(range(len(vals)))


def test_simulate_batch_matches_the_recursion():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((3, 2, 2)) * 0.2
    c = rng.standard_normal((2, 2))
    resid = rng.standard_normal((40, 2))
    y0 = rng.standard_normal((3, 2))
    idx = rng.integers(0, 40, size=(5, 40))
    batch = K.simulate_batch(y0, resid, idx, a, c, True, True)
    for r in range(5):
        y = [row for row in y0]
        for t in range(3, 43):
            y.append(c[:, 0] + c[:, 1] * (t + 1) + sum(a[j] @ y[t - 1 - j] for j in range(3)) + resid[idx[r, t - 3]])
        assert np.allclose(batch[r], np.array(y), atol=1e-12)
    g = K.factors_batch(batch, 3, True, True, rows=7)
    z = np.hstack(K.design(batch[1], 3, True, True))
    assert np.allclose(g[1].T @ g[1], z.T @ z)


def test_trend_forecast_matches_recursion(spark):
    from panelcast.operators.forecast import forecast
    y = _var_data(90, 21, 2)
    panel = panel_df(spark, {"tr": y.tolist()}, 2)
    for det in (Det.TREND, Det.CONST_TREND):
        spec = VarSpec(2, det)
        model = fit_var(panel, ["var0", "var1"], spec)
        f = model.fits.first()
        b = np.array(f.coef).reshape(-1, 2)
        x, _ = K.design(y, 2, spec.has_const, spec.has_trend)
        hist = [row for row in y]
        for step in range(1, 6):
            t1 = len(y) + step  # 1-based trend index of the forecast row
            xrow = ([1.0] if spec.has_const else []) + [float(t1)] + list(hist[-1]) + list(hist[-2])
            hist.append(np.array(xrow) @ b)
        got = forecast(model, panel, 5).collect()
        for r in got:
            assert r.value == pytest.approx(hist[len(y) + r.step - 1][int(r.variable[-1])], rel=1e-9)


def test_near_collinear_log_pair(spark):
    """x beside log1p(x): a near-singular design still fits (min-norm fallback if needed)."""
    rng = np.random.default_rng(6)
    x = np.abs(np.cumsum(rng.standard_normal(120))) + 1.0
    y = np.column_stack([x, np.log1p(x)])
    panel = panel_df(spark, {"lg": y.tolist()}, 2)
    model = fit_var(panel, ["var0", "var1"], VarSpec(2, Det.CONST))
    f = model.fits.first()
    assert f.status == "ok"
    xx, yy = K.design(y, 2, True, False)
    fitted = xx @ np.array(f.coef).reshape(-1, 2)
    best = xx @ np.linalg.lstsq(xx, yy, rcond=None)[0]
    assert np.allclose(fitted, best, atol=1e-6)
    rows = granger_matrix(model).collect()
    assert all(0.0 <= r.p_value <= 1.0 for r in rows)


def test_min_norm_refit_combines_partitions(spark):
    """A singular series longer than several lag blocks: partial R factors from several tasks."""
    rng = np.random.default_rng(12)
    a = np.cumsum(rng.standard_normal(20000)) * 0.01 + 5
    y = np.column_stack([a, 3.0 * a])
    panel = panel_df(spark, {"long": y.tolist()}, 2).repartition(6)
    model = fit_var(panel, ["var0", "var1"], VarSpec(1, Det.CONST))
    f = model.fits.first()
    assert f.solver == "min_norm"
    x, yy = K.design(y, 1, True, False)
    b = np.linalg.lstsq(x, yy, rcond=1e-12)[0]
    assert np.allclose(np.array(f.coef).reshape(3, 2), b, atol=1e-6)
    u = yy - x @ b
    assert np.allclose(np.array(f.sigma).reshape(2, 2), u.T @ u / (len(yy) - 3), rtol=1e-6, atol=1e-9)


def test_results_do_not_change_with_the_level(spark):
    """y -> a + b y with levels up to 5e5 standard deviations: F, Sigma (scaled), VIF-free fits stay."""
    y = _var_data(300, 17, 2)
    rows = {}
    for level in (0.0, 1e3, 3e5, 5e5):
        panel = panel_df(spark, {"l": (y + level).tolist()}, 2)
        model = fit_var(panel, ["var0", "var1"], VarSpec(2, Det.CONST))
        rows[level] = ({(r.cause, r.effect): r.f_stat for r in granger_matrix(model).collect()}, np.array(model.fits.first().sigma))
    for level, (f, sigma) in rows.items():
        assert sigma == pytest.approx(rows[0.0][1], rel=1e-6)
        for pair, value in f.items():
            assert value == pytest.approx(rows[0.0][0][pair], rel=1e-6)


def test_index_with_holes_or_repeats_gets_a_status(spark):
    cases = {"late": range(1, 31), "hole": [*range(0, 10), *range(11, 31)], "twice": [*range(0, 29), 5], "whole": range(30)}
    y = _var_data(40, 4, 2)
    rows = [(s, int(t), float(y[i][0]), float(y[i][1])) for s, ts in cases.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "series_id string, t bigint, var0 double, var1 double")
    status = {r.series_id: r.status for r in fit_var(df, ["var0", "var1"], VarSpec(1, Det.CONST)).fits.collect()}
    assert status == {"late": "bad_index", "hole": "bad_index", "twice": "bad_index", "whole": "ok"}


def test_null_keys_are_kept(spark):
    from panelcast.functions.scalar import joined_key
    from panelcast.operators.interp import interpolate_linear
    from panelcast.operators.lags import positional_index
    df = spark.createDataFrame([(None, 0, 1.0), (None, 1, None), (None, 2, 3.0), ("a", 0, 5.0)], "k string, t bigint, v double")
    assert sorted(r.v for r in interpolate_linear(df, ["k"], ["t"], ["v"], position="t").collect()) == [1.0, 2.0, 3.0, 5.0]
    late = spark.createDataFrame([("a", None), ("a", 2.0), ("a", 1.0), (None, 7.0)], "k string, o double")
    assert sorted((r.k or "", r.t) for r in positional_index(late, "k", ["o"]).collect()) == [("", 0), ("a", 0), ("a", 1), ("a", 2)]
    keys = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "c"), ("\\N", "c"), ("a", "b")], "x string, y string")
    made = [r[0] for r in keys.select(joined_key(["x", "y"])).collect()]
    assert len(set(made)) == 5 and made[-1] == "a|b"
