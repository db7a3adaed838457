"""Operator fixtures of the reference test-suite (inputs and expected values as fixed data),
run through the Spark operators with every case of a group packed into one panel frame."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import panel_df
from panelcast.operators import kernels as K
from panelcast.operators.bootstrap import bootstrap_granger, bootstrap_irf, simulate_series
from panelcast.operators.forecast import forecast
from panelcast.operators.granger import granger, granger_matrix
from panelcast.operators.irf import irf
from panelcast.operators.var import fit_var, model_from_params
from panelcast.spec import Det, VarSpec


# ---- quantile (linear between order statistics) --------------------------------------------
@pytest.mark.parametrize("samples,q,expected", [
    ([1, 2, 3, 4, 5], 0.5, 3.0), ([1, 2, 3, 4, 5], 0.0, 1.0), ([1, 2, 3, 4, 5], 1.0, 5.0),
    (list(range(10, 101, 10)), 0.75, 77.5),
])
def test_bootstrap_quantile(spark, samples, q, expected):
    df = spark.createDataFrame([(float(s),) for s in samples], "v double")
    from panelcast.functions.scalar import quantile_expr
    assert df.agg(quantile_expr("v", q)).first()[0] == pytest.approx(expected, abs=1e-6)


def test_quantile_of_nothing_is_null(spark):
    from panelcast.functions.scalar import quantile_expr
    assert spark.createDataFrame([], "v double").agg(quantile_expr("v", 0.5)).first()[0] is None


# ---- forecast with known coefficients ------------------------------------------------------
FORECAST_CASES = {
    # name: (lags, det, steps, A list, C, history, expected)
    "ar1_half": (1, Det.NONE, 3, [[0.5]], None, [1.0, 0.5, 0.25, 0.125, 0.0625], [0.03125, 0.015625, 0.0078125]),
    "const_only": (1, Det.CONST, 4, [[0.0]], [1.0], [0.0, 0.0, 0.0], [1.0, 1.0, 1.0, 1.0]),
    "ar1_08": (1, Det.NONE, 5, [[0.8]], None, [1.0, 0.8, 0.64, 0.512], [0.4096, 0.32768, 0.262144, 0.2097152, 0.16777216]),
    "ar2": (2, Det.NONE, 3, [[0.3], [0.2]], None, [1.0, 0.5, 0.35, 0.205, 0.1315], [0.08045, 0.050435, 0.0312205]),
}


@pytest.mark.parametrize("name", list(FORECAST_CASES))
def test_forecast_fixture(spark, name):
    lags, det, steps, a, c, hist, expected = FORECAST_CASES[name]
    spec = VarSpec(lags, det)
    model = model_from_params(spark, {name: (a, c, [[1.0]])}, ["var0"], spec, n_obs={name: len(hist)})
    out = forecast(model, panel_df(spark, {name: hist}, 1), steps).orderBy("step").collect()
    assert [r.step for r in out] == list(range(1, steps + 1))
    assert [r.value for r in out] == pytest.approx(expected, abs=1e-4)


# ---- impulse responses -------------------------------------------------------------------
IRF_CASES = {
    "half": (1, 5, [[0.5]], [[1.0]], [1.0, 0.5, 0.25, 0.125, 0.0625]),
    "p08": (1, 4, [[0.8]], [[1.0]], [1.0, 0.8, 0.64, 0.512]),
    "sigma4": (1, 3, [[0.3]], [[4.0]], [2.0, 0.6, 0.18]),
    "ar2": (2, 4, [[0.4], [0.2]], [[1.0]], [1.0, 0.4, 0.36, 0.224]),
}


def test_irf_fixtures(spark):
    # one panel per lag order (the model spec is per panel)
    for lags in (1, 2):
        cases = {k: v for k, v in IRF_CASES.items() if v[0] == lags}
        h = max(v[1] for v in cases.values())
        model = model_from_params(spark, {k: (v[2], None, v[3]) for k, v in cases.items()}, ["var0"], VarSpec(lags, Det.NONE))
        rows = irf(model, h).collect()
        for name, (_, horizon, _, _, expected) in cases.items():
            got = sorted((r.horizon, r.value) for r in rows if r.series_id == name and r.horizon < horizon)
            assert [v for _, v in got] == pytest.approx(expected, abs=1e-4)
            assert all(r.shock_kind == "cholesky" for r in rows if r.series_id == name)


def test_run_irf_analysis_diagonal(spark):
    model = model_from_params(spark, {"d": ([[[0.5, 0.0], [0.0, 0.3]]], None, [[1.0, 0.0], [0.0, 1.0]])},
                              ["var0", "var1"], VarSpec(1, Det.NONE))
    rows = irf(model, 5).collect()
    resp0 = {s: [r.value for r in sorted(rows, key=lambda r: r.horizon) if r.shock == s and r.response == "var0"]
             for s in ("var0", "var1")}
    assert resp0["var0"] == pytest.approx([1.0, 0.5, 0.25, 0.125, 0.0625], abs=1e-2)
    assert resp0["var1"] == pytest.approx([0.0] * 5, abs=1e-2)
    resp1 = [r.value for r in sorted(rows, key=lambda r: r.horizon) if r.shock == "var1" and r.response == "var1"]
    assert resp1 == pytest.approx([1.0, 0.3, 0.09, 0.027, 0.0081], abs=1e-2)


def test_irf_unit_shock_fallback(spark):
    model = model_from_params(spark, {"npd": ([[[0.5, 0.1], [0.0, 0.3]]], None, [[1.0, 2.0], [2.0, 1.0]]),
                                      "none": ([[[0.5, 0.1], [0.0, 0.3]]], None, None)},
                              ["var0", "var1"], VarSpec(1, Det.NONE))
    rows = irf(model, 2).filter("horizon = 0").collect()
    assert {r.shock_kind for r in rows} == {"unit"}
    for r in rows:
        assert r.value == (1.0 if r.shock == r.response else 0.0)


def test_irf_off_diagonal_cholesky(spark):
    sigma = np.array([[4.0, 1.2], [1.2, 2.5]])
    model = model_from_params(spark, {"s": ([[[0.5, 0.2], [0.1, 0.3]]], None, sigma)}, ["var0", "var1"], VarSpec(1, Det.NONE))
    rows = irf(model, 3).collect()
    l = np.linalg.cholesky(sigma)
    a = np.array([[0.5, 0.2], [0.1, 0.3]])
    for r in rows:
        psi = np.linalg.matrix_power(a, r.horizon)
        ri, si = int(r.response[-1]), int(r.shock[-1])
        assert r.value == pytest.approx((psi @ l)[ri, si], abs=1e-12)


# ---- estimation -----------------------------------------------------------------------------
ESTIMATE_CASES = {
    "half": ([1.0, 0.5, 0.25, 0.125, 0.0625, 0.03125, 0.015625], 0.5),
    "zeros": ([0.0, 0.0, 0.0, 0.0], 0.0),
    "p08": ([1.0, 0.8, 0.64, 0.512, 0.4096, 0.32768], 0.8),
    "p03": ([1.0, 0.3, 0.09, 0.027, 0.0081, 0.00243, 0.000729, 0.0002187], 0.3),
}


def test_estimate_fixtures(spark):
    panel = panel_df(spark, {k: v[0] for k, v in ESTIMATE_CASES.items()}, 1)
    model = fit_var(panel, ["var0"], VarSpec(1, Det.NONE))
    coefs = {r.series_id: r.value for r in model.coefficients().collect()}
    for name, (_, phi) in ESTIMATE_CASES.items():
        assert coefs[name] == pytest.approx(phi, abs=1e-2)
    solver = {r.series_id: r.solver for r in model.fits.collect()}
    assert solver["zeros"] == "min_norm"


RESID_CASES = {
    "zero": (0.5, [1.0, 0.5, 0.25, 0.125, 0.0625], [0.0] * 4),
    "tenth": (0.5, [1.0, 0.6, 0.4, 0.3, 0.25], [0.1] * 4),
    "p08": (0.8, [1.0, 0.8, 0.64, 0.512, 0.4096, 0.32768], [0.0] * 5),
    "half": (0.3, [1.0, 0.8, 0.74, 0.722], [0.5] * 3),
}


def test_compute_residuals_fixtures(spark):
    model = model_from_params(spark, {k: ([[v[0]]], None, [[1.0]]) for k, v in RESID_CASES.items()}, ["var0"],
                              VarSpec(1, Det.NONE))
    panel = panel_df(spark, {k: v[1] for k, v in RESID_CASES.items()}, 1)
    got = model.residuals(panel).collect()
    for name, (_, ys, expected) in RESID_CASES.items():
        vals = [r.var0 for r in sorted(got, key=lambda r: r.t) if r.series_id == name]
        assert len(vals) == len(ys) - 1
        assert vals == pytest.approx(expected, abs=1e-4)


# ---- Granger ---------------------------------------------------------------------------------
def _causal_pair(n=50, seed=0):
    rng = np.random.default_rng(seed)
    y1 = np.zeros(n)
    y2 = np.zeros(n)
    y1[0] = 1.0
    for t in range(1, n):
        y1[t] = 0.9 * y1[t - 1] + 0.05 * rng.standard_normal()
        y2[t] = 0.5 * y2[t - 1] + 0.6 * y1[t - 1] + 0.05 * rng.standard_normal()
    return np.column_stack([y1, y2])


def test_granger_structure(spark):
    panel = panel_df(spark, {"c": _causal_pair().tolist()}, 2)
    model = fit_var(panel, ["var0", "var1"], VarSpec(2, Det.CONST))
    row = granger(model, "var0", "var1").first()
    assert (row.cause, row.effect, row.lags) == ("var0", "var1", 2)
    assert np.isfinite(row.f_stat) and 0.0 <= row.p_value <= 1.0
    assert row.significant
    with pytest.raises(ValueError):
        granger(model, "var0", "var0")


def test_granger_matrix_all_ordered_pairs(spark):
    rng = np.random.default_rng(3)
    cases = {f"k{k}": rng.standard_normal((40, 3)).tolist() for k in range(3)}
    model = fit_var(panel_df(spark, cases, 3), ["var0", "var1", "var2"], VarSpec(1, Det.CONST))
    rows = granger_matrix(model).collect()
    for sid in cases:
        pairs = {(r.cause, r.effect) for r in rows if r.series_id == sid}
        assert pairs == {(a, b) for a in ("var0", "var1", "var2") for b in ("var0", "var1", "var2") if a != b}
        assert all(r.lags == 1 for r in rows if r.series_id == sid)


# ---- simulation and bootstrap --------------------------------------------------------------
def test_simulate_shape_and_presample(spark):
    y = (np.arange(40).reshape(20, 2) / 10.0).tolist()
    panel = panel_df(spark, {"s": y}, 2)
    model = fit_var(panel, ["var0", "var1"], VarSpec(2, Det.CONST))
    sims = simulate_series(model, panel, reps=3, seed=42).collect()
    for rep in range(3):
        rows = sorted((r for r in sims if r.rep == rep), key=lambda r: r.t)
        assert len(rows) == 20
        assert [(r.var0, r.var1) for r in rows[:2]] == [tuple(y[0]), tuple(y[1])]


def test_bootstrap_irf_bands(spark):
    panel = panel_df(spark, {"b": _causal_pair(80, 1).tolist()}, 2)
    model = fit_var(panel, ["var0", "var1"], VarSpec(1, Det.CONST))
    rows = bootstrap_irf(model, panel, reps=40, horizon=5, alpha=0.1, seed=5).collect()
    assert len(rows) == 2 * 2 * 5
    for r in rows:
        assert r.lower <= r.upper and r.n_reps == 40


def test_bootstrap_granger_pvalues(spark):
    panel = panel_df(spark, {"b": _causal_pair(80, 2).tolist()}, 2)
    model = fit_var(panel, ["var0", "var1"], VarSpec(1, Det.CONST))
    rows = bootstrap_granger(model, panel, reps=30, seed=9).collect()
    assert len(rows) == 2
    for r in rows:
        assert 1 / 31 <= r.boot_p <= 1.0
        assert r.significant_bootstrap == (r.boot_p < 0.05)


# ---- spec / accessors -----------------------------------------------------------------------
@pytest.mark.parametrize("lags,det,exo", [(3, 1, False), (1, 0, False), (5, 2, False), (2, 3, True)])
def test_spec(lags, det, exo):
    if exo:
        with pytest.raises(ValueError):
            VarSpec(lags, det, exo)
        return
    s = VarSpec(lags, det)
    assert (s.lags, int(s.det), s.exogenous) == (lags, det, exo)


def test_phi_and_covu_accessors(spark):
    model = model_from_params(spark, {"a": ([[[0.5, 0.1], [0.2, 0.3]]], None, [[1.0, 0.5], [0.5, 2.0]])},
                              ["var0", "var1"], VarSpec(1, Det.NONE))
    co = {(r.equation, r.variable): r.value for r in model.coefficients().collect()}
    assert co[("var0", "var0")] == 0.5 and co[("var0", "var1")] == 0.1 and co[("var1", "var0")] == 0.2
    sg = {(r.row, r.col): r.value for r in model.sigma().collect()}
    assert sg[("var0", "var0")] == 1.0 and sg[("var0", "var1")] == 0.5


# Fixed expected values: lag count and first coefficient; covariance entries; scalar responses.
PHI_CASES = [(2, 0.5), (1, 0.7), (3, 0.3), (1, 0.9)]
COVU_CASES = {"a": [[1.0, 0.5], [0.5, 2.0]], "b": [[4.0]], "c": [[1.0, 0.0], [0.0, 1.0]], "d": [[2.5, 1.2], [1.2, 3.0]]}
SCALAR_RESPONSES = {0.8: [1.0, 0.8, 0.64, 0.512], 0.5: [1.0, 0.5, 0.25, 0.125]}


def test_phi_cases(spark):
    for lags in {n for n, _ in PHI_CASES}:
        own = {f"c{i}": phi for i, (n, phi) in enumerate(PHI_CASES) if n == lags}
        params = {name: ([[[phi]]] + [[[0.1]]] * (lags - 1), None, [[1.0]]) for name, phi in own.items()}
        model = model_from_params(spark, params, ["var0"], VarSpec(lags, Det.NONE))
        rows = model.coefficients().collect()
        assert {r.series_id: r.value for r in rows if r.lag == 1} == own
        assert {r.lag for r in rows} == set(range(1, lags + 1))


def test_covu_cases(spark):
    for k in (1, 2):
        own = {n: s for n, s in COVU_CASES.items() if len(s) == k}
        names = [f"var{i}" for i in range(k)]
        model = model_from_params(spark, {n: ([np.zeros((k, k)).tolist()], None, s) for n, s in own.items()}, names, VarSpec(1, Det.NONE))
        got = {(r.series_id, r.row, r.col): r.value for r in model.sigma().collect()}
        assert got == {(n, names[i], names[j]): s[i][j] for n, s in own.items() for i in range(k) for j in range(k)}


def test_scalar_response_cases(spark):
    model = model_from_params(spark, {str(phi): ([[[phi]]], None, [[1.0]]) for phi in SCALAR_RESPONSES}, ["var0"], VarSpec(1, Det.NONE))
    rows = irf(model, 4).collect()
    for phi, expected in SCALAR_RESPONSES.items():
        assert [r.value for r in sorted((r for r in rows if r.series_id == str(phi)), key=lambda r: r.horizon)] == pytest.approx(expected)


@pytest.mark.parametrize("k,cause,effect", [(2, "var1", "var0"), (3, "var0", "var2")])
def test_granger_one_lag_pairs(spark, k, cause, effect):
    y = np.random.default_rng(k).standard_normal((40, k))
    names = [f"var{i}" for i in range(k)]
    row = granger(fit_var(panel_df(spark, {"s": y.tolist()}, k), names, VarSpec(1, Det.CONST)), cause, effect).first()
    assert (row.cause, row.effect, row.lags) == (cause, effect, 1) and 0 <= row.p_value <= 1
