"""Diagnostics against brute-force numpy versions of the same tests."""

import math

import numpy as np
import pytest

from panelcast.functions.fdist import f_sf_numpy
from panelcast.operators import diagnostics as DG


def _long(spark, series: dict):
    rows = [(sid, col, t, float(v)) for (sid, col), ys in series.items() for t, v in enumerate(ys)]
    return spark.createDataFrame(rows, "series_id string, variable string, t bigint, value double")


def _series(seed, n, kind):
    rng = np.random.default_rng(seed)
    e = rng.standard_normal(n)
    if kind == "walk":
        return np.cumsum(e) + 50
    if kind == "ar":
        y = np.zeros(n)
        for t in range(1, n):
            y[t] = 0.5 * y[t - 1] + e[t]
        return y + 10
    return 0.002 * (np.arange(n) - n / 2) ** 2 + e  # quadratic trend


def adf_brute(x):
    n = len(x)
    maxlag = min(n // 2 - 2, int(math.ceil(12 * (n / 100) ** 0.25)))
    dx = np.diff(x)

    def design(lag, start):
        rows = range(start, n)  # index t of y_t, dy_t = y_t - y_{t-1}
        X = [[1.0, x[t - 1]] + [dx[t - 1 - j] for j in range(1, lag + 1)] for t in rows]
        return np.array(X), np.array([dx[t - 1] for t in rows])

    best = None
    for lag in range(maxlag + 1):
        X, y = design(lag, maxlag + 1)
        b = np.linalg.lstsq(X, y, rcond=None)[0]
        ssr = float(((y - X @ b) ** 2).sum())
        nobs = len(y)
        aic = -2 * (-nobs / 2 * (math.log(2 * math.pi) + math.log(ssr / nobs) + 1)) + 2 * X.shape[1]
        if best is None or aic < best[0]:
            best = (aic, lag)
    lag = best[1]
    X, y = design(lag, lag + 1)
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    r = y - X @ b
    s2 = r @ r / (len(y) - X.shape[1])
    tau = b[1] / math.sqrt(s2 * np.linalg.inv(X.T @ X)[1, 1])
    return tau, lag


def kpss_brute(x):
    n = len(x)
    e = x - x.mean()
    covl = int(n ** (2 / 9))
    s0 = (e @ e) / n
    s1 = 0.0
    for i in range(1, covl + 1):
        p = (e[i:] @ e[:n - i]) / (n / 2)
        s0 += p
        s1 += i * p
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    s_hat = e @ e
    for i in range(1, lags + 1):
        s_hat += 2 * (e[i:] @ e[:n - i]) * (1 - i / (lags + 1))
    stat = (np.cumsum(e) ** 2).sum() / n ** 2 / (s_hat / n)
    return stat, float(np.interp(stat, DG.KPSS_CRIT, DG.KPSS_PVAL)), lags


CASES = {("a", "walk"): _series(1, 200, "walk"), ("a", "ar"): _series(2, 150, "ar"),
         ("b", "quad"): _series(3, 120, "quad"), ("b", "short"): _series(4, 15, "ar")}


def test_adf_matches_brute_force(spark):
    got = {(r.series_id, r.variable): r for r in DG.adf(_long(spark, CASES)).collect()}
    for key, x in CASES.items():
        r = got[key]
        if len(x) < DG.MIN_OBS:
            assert r.adf_p is None and r.adf_stationary is False
            continue
        tau, lag = adf_brute(x)
        assert r.adf_lags == lag
        assert r.adf_stat == pytest.approx(tau, rel=1e-7)
        assert r.adf_p == pytest.approx(DG.mackinnon_p(tau), abs=1e-12)


def test_mackinnon_hand_value():
    assert DG.mackinnon_p(-2.86) == pytest.approx(0.050, abs=2e-3)
    assert DG.mackinnon_p(-30) == 0.0 and DG.mackinnon_p(3.0) == 1.0


def test_kpss_auto_lag_matches_brute_force(spark):
    got = {(r.series_id, r.variable): r for r in DG.kpss(_long(spark, CASES)).collect()}
    for key, x in CASES.items():
        r = got[key]
        if len(x) < DG.MIN_OBS:
            assert r.kpss_stationary is False and r.kpss_p is None
            continue
        stat, p, lags = kpss_brute(x)
        assert r.kpss_lags == lags
        assert r.kpss_stat == pytest.approx(stat, rel=1e-8)
        assert r.kpss_p == pytest.approx(p, abs=1e-12)
        assert r.kpss_stationary == (p >= 0.05)


def test_reset_matches_three_column_fit(spark):
    got = {(r.series_id, r.variable): r for r in DG.reset_linearity(_long(spark, CASES)).collect()}
    for key, y in CASES.items():
        r = got[key]
        n = len(y)
        if n < DG.MIN_OBS:
            assert r.reset_p is None and r.is_linear is False
            continue
        t = np.arange(n, dtype=float)
        X1 = np.column_stack([np.ones(n), t])
        yhat = X1 @ np.linalg.lstsq(X1, y, rcond=None)[0]
        X2 = np.column_stack([X1, yhat ** 2])
        rss1 = ((y - yhat) ** 2).sum()
        rss2 = ((y - X2 @ np.linalg.lstsq(X2, y, rcond=None)[0]) ** 2).sum()
        f = (rss1 - rss2) / (rss2 / (n - 3))
        assert r.reset_f == pytest.approx(f, rel=1e-6)
        assert r.reset_p == pytest.approx(float(f_sf_numpy(f, 1, n - 3)), abs=1e-9)
    assert got[("b", "quad")].is_linear is False


def test_vif_uncentred(spark):
    rng = np.random.default_rng(0)
    a = rng.standard_normal(50) + 3
    b = 0.7 * a + 0.3 * rng.standard_normal(50)
    c = rng.standard_normal(50)
    rows = [("s", t, float(a[t]), float(b[t]), float(c[t])) for t in range(50)] + \
           [("tiny", t, 1.0 + t, 2.0, 3.0 * t) for t in range(5)]
    wide = spark.createDataFrame(rows, "series_id string, t bigint, a double, b double, c double")
    got = {(r.series_id, r.variable): r for r in DG.vif(wide, ["a", "b", "c"]).collect()}
    X = np.column_stack([a, b, c])
    for i, name in enumerate("abc"):
        others = np.delete(X, i, axis=1)
        resid = X[:, i] - others @ np.linalg.lstsq(others, X[:, i], rcond=None)[0]
        r2 = 1 - (resid @ resid) / (X[:, i] @ X[:, i])
        assert got[("s", name)].vif == pytest.approx(1 / (1 - r2), rel=1e-8)
    assert got[("tiny", "a")].vif is None and got[("tiny", "a")].vif_class == "Could not calculate"


def test_report_and_log_transform(spark):
    n = 120
    walk = _series(7, n, "walk")
    rows = [("s", t, float(walk[t]), float(_series(8, n, "ar")[t]), float(-5 + walk[t] - 60)) for t in range(n)]
    wide = spark.createDataFrame(rows, "series_id string, t bigint, up double, temperature double, neg double")
    cols = ["up", "temperature", "neg"]
    rep = DG.diagnostics_report(wide, cols)
    r = {x.variable: x for x in rep.collect()}
    assert set(r) == set(cols)
    assert r["up"].stationarity in ("Non-stationary", "Partially stationary", "Stationary")
    out = DG.log_transform(wide, rep, cols)
    added = {x.variable for x in out.select("variable").distinct().collect()} - set(cols)
    # temperature is excluded by the fixed list, negative columns are never logged
    assert "LOG_TEMPERATURE" not in added and "LOG_NEG" not in added
    if r["up"].stationarity == "Non-stationary" or not r["up"].is_linear:
        assert added == {"LOG_UP"}
        rep_only = DG.log_transform(wide, rep, cols, replace=True)
        names = {x.variable for x in rep_only.select("variable").distinct().collect()}
        assert "LOG_UP" in names and "up" not in names


def test_kpss_long_lag_route_is_exact(spark):
    got = {(r.series_id, r.variable): r for r in DG.kpss(_long(spark, CASES)).collect()}
    for key, x in CASES.items():
        if len(x) < DG.MIN_OBS:
            continue
        stat, p, lags = kpss_brute(x)
        assert got[key].kpss_lags == lags
        assert got[key].kpss_stat == pytest.approx(stat, rel=1e-8)


def test_adf_fixed_lag_matches_brute_force(spark):
    got = {(r.series_id, r.variable): r for r in DG.adf(_long(spark, CASES), maxlag=2, autolag=None).collect()}
    for key, x in CASES.items():
        if len(x) < DG.MIN_OBS:
            continue
        n = len(x)
        dx = np.diff(x)
        X = np.array([[1.0, x[t - 1], dx[t - 2], dx[t - 3]] for t in range(3, n)])
        y = np.array([dx[t - 1] for t in range(3, n)])
        b = np.linalg.lstsq(X, y, rcond=None)[0]
        r = y - X @ b
        tau = b[1] / math.sqrt(r @ r / (len(y) - 4) * np.linalg.inv(X.T @ X)[1, 1])
        assert got[key].adf_lags == 2
        assert got[key].adf_stat == pytest.approx(tau, rel=1e-7)


def test_constant_and_one_value_series_have_no_verdict(spark):
    flat = {("c", "flat"): np.full(40, 3.0), ("c", "one"): np.array([1.0])}
    for rows in (DG.adf(_long(spark, flat)).collect(), DG.kpss(_long(spark, flat)).collect()):
        assert {r.variable for r in rows} == {"flat", "one"}
        assert not any(r[name] for r in rows for name in r.asDict() if name.endswith("_stationary"))


def test_vif_does_not_depend_on_units(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 4)) + 10
    x[:, 3] = x[:, 0] + x[:, 1] + rng.normal(size=200) * 0.01
    names = ["a", "b", "c", "d"]
    found = []
    for unit in ([1, 1, 1, 1], [1, 1e-3, 1e6, 1e3]):
        df = spark.createDataFrame([("s", *map(float, row)) for row in x * np.array(unit)], "series_id string, a double, b double, c double, d double")
        found.append({r.variable: r.vif for r in DG.vif(df, names).collect()})
    g = np.linalg.inv(x.T @ x)
    for i, n in enumerate(names):
        assert found[0][n] == pytest.approx((x[:, i] @ x[:, i]) * g[i, i], rel=1e-5) and found[1][n] == pytest.approx(found[0][n], rel=1e-6)
