"""Reduced-form VAR(p) estimation over a panel of series (one OLS fit per series)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType)

from panelcast.operators import kernels as K
from panelcast.operators.lags import lag_embed, lag_name
from panelcast.operators.rfactor import r_factors, unpack
from panelcast.session import cut_lineage
from panelcast.spec import VarSpec

__all__ = ["VarModel", "fit_var", "FIT_SCHEMA"]

FIT_SCHEMA = StructType([
    StructField("series_id", StringType()),
    StructField("n_obs", LongType()),
    StructField("n_reg", LongType()),
    StructField("n_params", IntegerType()),
    StructField("df_resid", DoubleType()),
    StructField("status", StringType()),
    StructField("solver", StringType()),
    StructField("coef", ArrayType(DoubleType())),
    StructField("sigma", ArrayType(DoubleType())),
    StructField("r", ArrayType(DoubleType())),
])


def _design_rows(variables: list[str], spec: VarSpec, time_col: str):
    """Rows of [X | Y] for t >= p, and the sums that tell whether t runs 0, 1, ... n - 1."""
    names = [lag_name(v, j) for j in range(1, spec.lags + 1) for v in variables] + variables

    def rows(part: pd.DataFrame) -> np.ndarray:
        part = part[part[time_col] >= spec.lags]
        cols = []
        if spec.has_const:
            cols.append(np.ones((len(part), 1)))
        if spec.has_trend:
            cols.append(part[time_col].to_numpy(float).reshape(-1, 1) + 1.0)
        return np.hstack([*cols, part[names].to_numpy(float, na_value=np.nan)])

    def counts(part: pd.DataFrame) -> list[float]:
        t = part[time_col].to_numpy(float, na_value=np.nan)
        return [float((t >= spec.lags).sum()), float(len(t)), float(t.sum()), float((t * t).sum())]

    return rows, counts


def _index_is_whole(n: float, s1: float, s2: float) -> bool:
    """Sums of t and t^2 as those of 0..n-1."""
    return s1 == n * (n - 1) / 2 and bool(np.isclose(s2, (n - 1) * n * (2 * n - 1) / 6, rtol=1e-12))


def _solve_fn(k: int, spec: VarSpec, d: int):
    p, n_det = spec.lags, spec.n_det
    m = n_det + p * k

    def fn(batches):
        for pdf in batches:
            rows = []
            for sid, counts, packed in zip(pdf["series_id"], pdf["counts"], pdf["r"]):
                n_reg, n_obs, s1, s2 = counts
                own = (sid, int(n_obs), int(n_reg), m)
                r = unpack(packed, d)
                status = ("bad_index" if not _index_is_whole(n_obs, s1, s2) else "too_short" if n_obs <= p or not n_reg
                          else "null_input" if not np.isfinite(r).all() else "ok")
                if status != "ok":
                    rows.append((*own, float("nan"), status, None, None, None, None))
                    continue
                b, sigma, solver, df = K.fit_from_r(r, k, p, n_det, int(n_reg))
                rows.append((*own, float(df), status, solver, b.ravel().tolist(), sigma.ravel().tolist(), np.asarray(packed, float).tolist()))
            yield pd.DataFrame(rows, columns=[f.name for f in FIT_SCHEMA.fields])

    return fn


@dataclass
class VarModel:
    """Fitted VAR panel. ``fits`` holds one row per series: coefficients B (m x K, row-major, rows
    ordered const, trend, lag 1 vars, lag 2 vars...), Sigma_u (K x K) and the packed factor R of [X | Y]."""

    fits: DataFrame
    variables: list[str]
    spec: VarSpec
    series_col: str = "series_id"

    @property
    def k(self) -> int:
        return len(self.variables)

    def coefficient_side(self, cols: Sequence[str], max_broadcast_bytes: int = 64 * 1024 * 1024) -> DataFrame:
        """Fit rows to join against data rows, broadcast only when their size is bounded.

        Size = series count (one cheap count of the checkpointed fit table) x coefficient width.
        Above the bound the join is left to the planner, whose AQE skew handling splits a hot
        series' partition instead of sending it to one task.
        """
        side = self.fits.filter(F.col("status") == "ok").select(*cols)
        if getattr(self, "_n_series", None) is None:
            self._n_series = side.count()
        width = 8 * (self.spec.n_regressors(self.k) * self.k + self.k * self.k) + 64
        return F.broadcast(side) if self._n_series * width <= max_broadcast_bytes else side

    # ---- tidy views -------------------------------------------------------------------
    def coefficients(self) -> DataFrame:
        """(series_id, equation, term, lag, variable, value); A_j[eq, var] = value of (eq, 'lag', j, var)."""
        terms = self.spec.term_names(self.variables)
        k = self.k
        meta = F.array(*[F.struct(F.lit(r * k + e).alias("idx"), F.lit(self.variables[e]).alias("equation"),
                                  F.lit(t).alias("term"), F.lit(j).alias("lag"), F.lit(v).alias("variable"))
                         for r, (t, j, v) in enumerate(terms) for e in range(k)])
        return (self.fits.filter(F.col("status") == "ok")
                .select("series_id", "coef", F.explode(meta).alias("m"))
                .select("series_id", "m.equation", "m.term", "m.lag", "m.variable",
                        F.element_at("coef", F.col("m.idx") + 1).alias("value")))

    def sigma(self) -> DataFrame:
        k = self.k
        meta = F.array(*[F.struct(F.lit(i * k + j).alias("idx"), F.lit(self.variables[i]).alias("row"),
                                  F.lit(self.variables[j]).alias("col")) for i in range(k) for j in range(k)])
        return (self.fits.filter(F.col("status") == "ok").select("series_id", "sigma", F.explode(meta).alias("m"))
                .select("series_id", "m.row", "m.col", F.element_at("sigma", F.col("m.idx") + 1).alias("value")))

    def gram(self) -> DataFrame:
        """(series_id, i, j, value) for i <= j: Z'Z = R'R over Z = [deterministic terms, lag blocks, y]."""
        d = self.spec.n_regressors(self.k) + self.k
        i, j = np.triu_indices(d)

        def fn(batches):
            for pdf in batches:
                for sid, packed in zip(pdf["series_id"], pdf["r"]):
                    r = unpack(packed, d)
                    yield pd.DataFrame({"series_id": sid, "i": i.astype(np.int32), "j": j.astype(np.int32), "value": (r.T @ r)[i, j]})

        fits = self.fits.filter(F.col("status") == "ok").select("series_id", "r")
        return fits.mapInPandas(fn, "series_id string, i int, j int, value double")

    def summary(self) -> DataFrame:
        """Per series: K, p, T, regression rows, K*K*p lag parameters, C dimensions, spec."""
        k, p = self.k, self.spec.lags
        return self.fits.select(
            "series_id", F.lit(k).alias("k"), F.lit(p).alias("lags"), F.lit(int(self.spec.det)).alias("det"),
            F.col("n_obs"), F.col("n_reg"), F.lit(k * k * p).alias("n_lag_params"),
            F.lit(k if self.spec.n_det else 0).alias("c_rows"), F.lit(self.spec.n_det).alias("c_cols"),
            "n_params", "df_resid", "status", "solver")

    def residuals(self, panel: DataFrame, time_col: str = "t") -> DataFrame:
        """u_t = y_t - fitted for t = p..T-1: lag design joined to the coefficient row of its series,
        evaluated as JVM array expressions."""
        lagged = lag_embed(panel, self.variables, self.spec.lags, self.series_col, time_col)
        from panelcast.operators.lags import design_columns
        x = F.array(*design_columns(self.spec, self.variables, time_col))
        coefs = self.coefficient_side([self.series_col, "coef"])
        j = lagged.join(coefs, self.series_col, "inner").withColumn("_x", x)
        k = self.k
        m = self.spec.n_regressors(k)
        cols = []
        for e, v in enumerate(self.variables):
            be = F.expr(f"transform(sequence(0, {m - 1}), r -> coef[r * {k} + {e}])")
            fitted = F.aggregate(F.zip_with("_x", be, lambda a, b: a * b), F.lit(0.0), lambda acc, z: acc + z)
            cols.append((F.col(v) - fitted).alias(v))
        return j.select(self.series_col, time_col, *cols)


def fit_var(panel: DataFrame, variables: Sequence[str], spec: VarSpec, series_col: str = "series_id",
            time_col: str = "t", checkpoint: bool = True) -> VarModel:
    """OLS VAR(p) per series: lag embedding -> one triangular factor per series -> small solve.

    ``panel``: (series_id, t 0..T-1, variables...). Every series gets a row; status tells of those
    with too few rows (too_short), NULL/NaN/infinite input (null_input) or a t that does not run
    0..T-1 without holes and repeats (bad_index). Singular designs get the minimum-norm solution.
    """
    variables = list(variables)
    df = panel if series_col == "series_id" else panel.withColumnRenamed(series_col, "series_id")
    lagged = lag_embed(df, variables, spec.lags, "series_id", time_col, keep_presample=True)
    d = spec.n_regressors(len(variables)) + len(variables)
    rows, counts = _design_rows(variables, spec, time_col)
    fits = r_factors(lagged, ["series_id"], d, rows, counts).mapInPandas(_solve_fn(len(variables), spec, d), FIT_SCHEMA)
    return VarModel(cut_lineage(fits) if checkpoint else fits, variables, spec, "series_id")


def model_from_params(spark, params: dict, variables: Sequence[str], spec: VarSpec, n_obs: dict | None = None) -> VarModel:
    """Build a VarModel from given coefficients instead of a fit (known-parameter analysis).

    ``params[series_id] = (A, C, sigma)`` with A a list of p (K x K) lag matrices, C a (K x n_det)
    matrix or None and sigma a (K x K) matrix or None (None -> unit shocks in the IRF).
    """
    k = len(variables)
    m = spec.n_regressors(k)
    rows = []
    for sid, (a, c, sigma) in params.items():
        b = np.zeros((m, k))
        if spec.n_det:
            b[:spec.n_det, :] = np.asarray(c, float).reshape(k, spec.n_det).T
        for j, aj in enumerate(a):
            b[spec.n_det + j * k: spec.n_det + (j + 1) * k, :] = np.asarray(aj, float).reshape(k, k).T
        sig = None if sigma is None else np.asarray(sigma, float).reshape(k, k).ravel().tolist()
        t = int((n_obs or {}).get(sid, 0))
        rows.append((sid, t, max(t - spec.lags, 0), m, float("nan"), "ok", "given", b.ravel().tolist(), sig, None))
    return VarModel(spark.createDataFrame(rows, FIT_SCHEMA), list(variables), spec, "series_id")
