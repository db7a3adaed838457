"""Impulse responses (orthogonalised by the Cholesky factor of Sigma_u, unit shocks as fallback)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators import kernels as K
from panelcast.operators.var import VarModel

__all__ = ["irf", "irf_response", "cumulative_impact", "IRF_SCHEMA"]

IRF_SCHEMA = "series_id string, shock string, response string, horizon int, value double, shock_kind string"


def irf(model: VarModel, horizon: int, shock: str | None = None) -> DataFrame:
    """(series_id, shock, response, horizon 0..H-1, value, shock_kind) for every shock at once (or
    one ``shock``), computed from the fit rows alone (no data pass)."""
    if horizon <= 0:
        raise ValueError("horizon must be > 0")
    if shock is not None:
        if shock not in model.variables:
            raise ValueError(f"unknown shock variable {shock}")
        return irf(model, horizon).filter(F.col("shock") == shock)
    variables, spec = model.variables, model.spec
    k = len(variables)
    names = np.array(variables, dtype=object)

    def fn(batches):
        for pdf in batches:
            frames = []
            for sid, coef, sigma in zip(pdf["series_id"], pdf["coef"], pdf["sigma"]):
                a = K.lag_matrices(np.asarray(coef, float), k, spec.lags, spec.n_det)
                sig = None if sigma is None else np.asarray(sigma, float).reshape(k, k)
                resp, kind = K.irf(a, sig, horizon)
                # resp[h, response, shock]
                h_idx, r_idx, s_idx = np.meshgrid(np.arange(horizon), np.arange(k), np.arange(k), indexing="ij")
                frames.append(pd.DataFrame({
                    "series_id": sid, "shock": names[s_idx.ravel()], "response": names[r_idx.ravel()],
                    "horizon": h_idx.ravel().astype(np.int32), "value": resp.ravel(), "shock_kind": kind}))
            if frames:
                yield pd.concat(frames, ignore_index=True)

    return model.fits.filter(F.col("status") == "ok").select("series_id", "coef", "sigma").mapInPandas(fn, IRF_SCHEMA)


def irf_response(model: VarModel, horizon: int, response: str) -> DataFrame:
    """Response of one variable to each shock (the reference's per-variable IRF analysis)."""
    return irf(model, horizon).filter(F.col("response") == response)


def cumulative_impact(irf_long: DataFrame) -> DataFrame:
    """Sum over the horizon of each (shock, response) path."""
    return irf_long.groupBy("series_id", "shock", "response").agg(F.sum("value").alias("cumulative"))
