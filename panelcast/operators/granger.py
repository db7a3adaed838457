"""Pairwise Granger-causality F tests, all ordered pairs of a series from its one triangular factor."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators import kernels as K
from panelcast.operators.rfactor import unpack
from panelcast.operators.var import VarModel

__all__ = ["granger_matrix", "granger", "GRANGER_SCHEMA"]

GRANGER_SCHEMA = ("series_id string, cause string, effect string, f_stat double, p_value double, lags int, "
                  "df_num int, df_den bigint, significant boolean, status string")


def granger_matrix(model: VarModel, alpha: float = 0.05) -> DataFrame:
    """K(K-1) rows per series: restricted model drops every lag of ``cause`` from the ``effect``
    equation; F = ((RSS_r - RSS_u)/p) / (RSS_u/(T_reg - m)), p-value from F(p, T_reg - m)."""
    variables, spec = model.variables, model.spec
    k, p, n_det = len(variables), spec.lags, spec.n_det
    m = spec.n_regressors(k)
    d = m + k

    def fn(batches):
        for pdf in batches:
            rows = []
            for sid, packed, coef, n_reg in zip(pdf["series_id"], pdf["r"], pdf["coef"], pdf["n_reg"]):
                res = K.granger_all_pairs(unpack(packed, d), np.asarray(coef, float), k, p, n_det, int(n_reg))
                for cause, effect, f, pv, status in res:
                    rows.append((sid, variables[cause], variables[effect], f, pv, p, p, int(n_reg) - m,
                                 bool(pv < alpha) if status == "ok" else False, status))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in GRANGER_SCHEMA.split(", ")])

    return (model.fits.filter(F.col("status") == "ok").select("series_id", "r", "coef", "n_reg")
            .mapInPandas(fn, GRANGER_SCHEMA))


def granger(model: VarModel, cause: str, effect: str, alpha: float = 0.05) -> DataFrame:
    if cause == effect:
        raise ValueError("cause and effect cannot be the same")
    for v in (cause, effect):
        if v not in model.variables:
            raise ValueError(f"unknown variable {v}")
    return granger_matrix(model, alpha).filter((F.col("cause") == cause) & (F.col("effect") == effect))
