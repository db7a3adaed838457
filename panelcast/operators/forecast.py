"""Multi-step recursive forecasts per series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators import kernels as K
from panelcast.operators.var import VarModel

__all__ = ["forecast"]


def forecast(model: VarModel, panel: DataFrame, steps: int, time_col: str = "t") -> DataFrame:
    """(series_id, step 1..steps, variable, value).

    Only the last p rows of each series reach Python: the tail is selected by a filter on
    t >= T - p against the (small) fit table, then one group of p rows per series recurses.
    """
    if steps <= 0:
        raise ValueError("steps must be > 0")
    spec, variables = model.spec, model.variables
    k, p = len(variables), spec.lags
    fits = model.coefficient_side(["series_id", "n_obs", "coef"])
    tail = (panel.select(F.col(model.series_col).alias("series_id"), time_col, *variables)
            .join(fits, "series_id").filter(F.col(time_col) >= F.col("n_obs") - p))

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time_col)
        coef = np.asarray(pdf["coef"].iloc[0], float)
        a = K.lag_matrices(coef, k, p, spec.n_det)
        c = K.det_coefs(coef, k, spec.n_det)
        out = K.forecast(pdf[variables].to_numpy(float), a, c, spec.has_const, spec.has_trend,
                         int(pdf["n_obs"].iloc[0]), steps)
        sid = pdf["series_id"].iloc[0]
        return pd.DataFrame({"series_id": sid, "step": np.repeat(np.arange(1, steps + 1), k),
                             "variable": np.tile(np.array(variables, dtype=object), steps), "value": out.ravel()})

    return tail.groupBy("series_id").applyInPandas(
        fn, "series_id string, step int, variable string, value double")
