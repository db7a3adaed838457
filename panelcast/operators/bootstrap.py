"""Residual bootstrap: simulated series, IRF confidence bands, bootstrap Granger p-values.

Replications are work items: each series' fit row is exploded into blocks of replications, as large as a fixed amount of
work allows, and items are spread over tasks by their cost. Residual rows are drawn with md5('seed:series:rep:i')
indices, so any partitioning gives the same draws.

A series of at most LONG residual numbers is simulated by one task, as many replications at once as fit CELLS numbers.
A longer one is never held: a step of the recursion is affine in the last p rows, so a block of BLOCK steps is one affine map.
The drawn residuals of every (series, replication, block) are folded to the offset of that map from a zero start, the maps
of a replication are chained, one row a block, to the start of every block, and the blocks are then simulated
independently. Their designs are folded to triangular factors like those of a fit.

An item sends on one array of responses per shock, or its counts of exceedances; bands are taken from the joined
arrays (reps x horizon x K numbers, whatever the data), p-values from the summed counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators import kernels as K
from panelcast.operators.granger import granger_matrix
from panelcast.operators.irf import irf
from panelcast.operators.rfactor import r_factors, unpack
from panelcast.operators.var import VarModel
from panelcast.session import cut_lineage

CELLS = 4_000_000  # simulated numbers a task holds at once, unless one replication has more
LONG = 4_000_000  # residual numbers of a series that one task may hold
BLOCK = 8192  # rows of a longer series simulated together
WORK = 50_000_000  # simulated numbers of an item

__all__ = ["bootstrap_inputs", "simulate_series", "bootstrap_irf", "bootstrap_granger"]


def _heads(model: VarModel, panel: DataFrame, time_col: str) -> DataFrame:
    """(series_id, y0): the first p observations."""
    row = F.array(*[F.col(v) for v in model.variables])
    head = panel.select(F.col(model.series_col).alias("series_id"), time_col, *model.variables).filter(F.col(time_col) < model.spec.lags)
    return (head.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct(F.col(time_col), row.alias("y")))).alias("_h"))
            .select("series_id", F.flatten(F.expr("transform(_h, x -> x.y)")).alias("y0")))


def _is_long(model: VarModel):
    return F.col("n_reg") * len(model.variables) > LONG


def bootstrap_inputs(model: VarModel, panel: DataFrame, time_col: str = "t") -> DataFrame:
    """One row per fitted series of at most LONG residual numbers: coefficients, first p observations, residual matrix."""
    fits = model.fits.filter((F.col("status") == "ok") & ~_is_long(model))
    row = F.array(*[F.col(v) for v in model.variables])
    short = panel.join(fits.select("series_id"), panel[model.series_col] == fits["series_id"], "left_semi")
    resid = (model.residuals(short, time_col).groupBy("series_id")
             .agg(F.sort_array(F.collect_list(F.struct(F.col(time_col), row.alias("u")))).alias("_r"))
             .select("series_id", F.flatten(F.expr("transform(_r, x -> x.u)")).alias("resid")))
    return (fits.select("series_id", "n_obs", "n_reg", "coef", "sigma").join(resid, "series_id")
            .join(_heads(model, short, time_col), "series_id"))


def _replicate(model: VarModel, panel: DataFrame, reps: int, block: int | None, time_col: str) -> DataFrame | None:
    """Work items (series, _rep_lo.._rep_hi) of the series that a task may hold, dealt to tasks by cost; None without such series."""
    k, cores = len(model.variables), panel.sparkSession.sparkContext.defaultParallelism
    short = model.fits.filter((F.col("status") == "ok") & ~_is_long(model))
    n, cells = short.agg(F.count(F.lit(1)), F.sum(F.col("n_reg") * k)).first()
    if not n:
        return None
    by_cores = -(-reps // -(-2 * cores // n))  # few series: enough items for all cores
    by_cost = F.greatest(F.lit(1), F.floor(F.lit(WORK) / F.greatest(F.lit(1), F.col("n_reg") * k))).cast("int")
    size = F.lit(block) if block else F.least(F.lit(by_cores), by_cost)
    items = bootstrap_inputs(model, panel, time_col).withColumn("_size", size)
    items = items.withColumn("_rep_lo", F.explode(F.sequence(F.lit(0), F.lit(reps - 1), F.col("_size"))))
    items = items.withColumn("_rep_hi", F.least(F.lit(reps), F.col("_rep_lo") + F.col("_size"))).drop("_size")
    tasks = max(min(n * reps, 4 * cores), -(-int(cells) * reps // WORK))
    return items.repartition(tasks, "series_id", "_rep_lo")


def _unpack(row, k: int, p: int, n_det: int):
    a, c = _recursion(row["coef"], k, p, n_det)
    resid = np.asarray(row["resid"], float).reshape(-1, k)
    y0 = np.asarray(row["y0"], float).reshape(p, k)
    return a, c, resid, y0


def _recursion(coef, k: int, p: int, n_det: int):
    coef = np.asarray(coef, float)
    return K.lag_matrices(coef, k, p, n_det), K.det_coefs(coef, k, n_det)


def _simulated(row, k: int, spec, seed: int):
    """(reps, simulated series of these reps) of one work item, a bounded number of replications at a time."""
    a, c, resid, y0 = _unpack(row, k, spec.lags, spec.n_det)
    lo, hi = int(row["_rep_lo"]), int(row["_rep_hi"])
    at_once = max(1, CELLS // max(1, resid.size * (spec.lags + 1)))
    for first in range(lo, hi, at_once):
        reps = np.arange(first, min(hi, first + at_once))
        idx = np.stack([K.draw_index(seed, row["series_id"], int(rep), len(resid)) for rep in reps])
        yield reps, K.simulate_batch(y0, resid, idx, a, c, spec.has_const, spec.has_trend)


def _long_blocks(model: VarModel, panel: DataFrame, reps: int, seed: int, time_col: str) -> DataFrame | None:
    """(series_id, rep, block, n, eps, start, coef): the drawn residuals and the p rows before every block of the
    series that no task may hold; None without such series."""
    variables, spec = model.variables, model.spec
    k, p, n_det = len(variables), spec.lags, spec.n_det
    fits = model.fits.filter((F.col("status") == "ok") & _is_long(model)).select("series_id", "n_reg", "coef")
    if fits.isEmpty():
        return None
    own = ["series_id", "rep", "block"]
    runs = fits.select("series_id", "n_reg", "coef", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    work = runs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_reg") - 1) / BLOCK)))).repartition(*own)
    last = F.least(F.col("n_reg"), (F.col("block") + 1) * BLOCK) - 1
    draws = work.select(*own, "n_reg", F.explode(F.sequence(F.col("block") * BLOCK, last)).alias("i"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "series_id", F.col("rep").cast("string"), F.col("i").cast("string")).cast("binary"))
    draws = draws.select(*own, "i", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.col("n_reg")).alias("j"))
    panel = panel.join(fits.select("series_id"), panel[model.series_col] == fits["series_id"], "left_semi")
    resid = model.residuals(panel, time_col)
    resid = resid.select(F.col(model.series_col).alias("series_id"), (F.col(time_col) - p).alias("j"), F.array(*variables).alias("u"))

    def fold(rows: pd.DataFrame, meta: pd.DataFrame) -> pd.DataFrame:
        eps = np.stack(rows.sort_values("i")["u"].to_numpy()).astype(float).reshape(-1, k)
        (sid, rep, block), a_c = meta[own].iloc[0], _recursion(meta["coef"].iloc[0], k, p, n_det)
        path = _run_block(np.zeros((p, k)), eps, *a_c, spec, int(block) * BLOCK)
        return pd.DataFrame([(sid, rep, block, len(eps), path[-p:].ravel(), eps.tobytes())], columns=[*own, "n", "offset", "eps"])

    meta = work.select(*[F.col(c).alias(c) for c in (*own, "coef")])  # columns of its own beside the draws
    drawn = draws.join(resid, ["series_id", "j"]).groupBy(*own).cogroup(meta.groupBy(*own))
    blocks = cut_lineage(drawn.applyInPandas(fold, "series_id string, rep int, block bigint, n int, offset array<double>, eps binary"))

    def chain(maps: pd.DataFrame, meta: pd.DataFrame) -> pd.DataFrame:
        step = _companion(_recursion(meta["coef"].iloc[0], k, p, n_det)[0])
        power = {n: np.linalg.matrix_power(step, int(n)) for n in maps["n"].unique()}
        state, out = np.asarray(meta["y0"].iloc[0], float), []
        for sid, rep, block, n, offset in maps.sort_values("block")[[*own, "n", "offset"]].itertuples(index=False):
            out.append((sid, rep, block, state))
            state = power[n] @ state + np.asarray(offset, float)
        return pd.DataFrame(out, columns=[*own, "start"])

    heads = runs.join(_heads(model, panel, time_col), "series_id").select("series_id", "rep", "coef", "y0")
    chained = blocks.select(*own, "n", "offset").groupBy("series_id", "rep").cogroup(heads.groupBy("series_id", "rep"))
    starts = chained.applyInPandas(chain, "series_id string, rep int, block bigint, start array<double>")
    return blocks.drop("offset").join(starts, own).join(fits.select("series_id", "coef"), "series_id")


def _companion(a: np.ndarray) -> np.ndarray:
    """The map of the last p rows, oldest first, to those one step later."""
    p, k = a.shape[0], a.shape[1]
    out = np.eye(p * k, k=k)
    out[-k:] = np.concatenate(a[::-1], axis=1)
    return out


def _run_block(start: np.ndarray, eps: np.ndarray, a, c, spec, first_t: int) -> np.ndarray:
    """The p rows before a block and its own; ``first_t`` is the position of the first of them."""
    return K.simulate_batch(start, eps, np.arange(len(eps))[None], a, c, spec.has_const, spec.has_trend, first_t)[0]


def _block_path(row, k: int, spec) -> tuple[int, np.ndarray]:
    """Position of the first row, and the rows, of one block of a long series."""
    a, c = _recursion(row["coef"], k, spec.lags, spec.n_det)
    first = int(row["block"]) * BLOCK
    start = np.asarray(row["start"], float).reshape(spec.lags, k)
    return first, _run_block(start, np.frombuffer(row["eps"]).reshape(-1, k), a, c, spec, first)


def simulate_series(model: VarModel, panel: DataFrame, reps: int, seed: int, block: int | None = None,
                    time_col: str = "t") -> DataFrame:
    """(series_id, rep, t, variables...) for each bootstrap replication."""
    variables, spec = model.variables, model.spec
    k, p = len(variables), spec.lags
    schema = "series_id string, rep int, t bigint, " + ", ".join(f"`{v}` double" for v in variables)

    def table(sid, rep, first: int, y: np.ndarray) -> pd.DataFrame:
        out = pd.DataFrame(y, columns=variables)
        out.insert(0, "t", first + np.arange(len(y), dtype=np.int64))
        out.insert(0, "rep", np.int32(rep))
        out.insert(0, "series_id", sid)
        return out

    def whole(batches):
        for pdf in batches:
            for _, row in pdf.iterrows():
                for reps_, ys in _simulated(row, k, spec, seed):
                    for rep, y in zip(reps_, ys):
                        yield table(row["series_id"], rep, 0, y)

    def parts(batches):
        for pdf in batches:
            for _, row in pdf.iterrows():
                first, y = _block_path(row, k, spec)
                skip = p if row["block"] else 0
                yield table(row["series_id"], row["rep"], first + skip, y[skip:])

    items, blocks = _replicate(model, panel, reps, block, time_col), _long_blocks(model, panel, reps, seed, time_col)
    return _either(items.mapInPandas(whole, schema) if items is not None else None,
                   blocks.mapInPandas(parts, schema) if blocks is not None else None, panel, schema)


def _either(a: DataFrame | None, b: DataFrame | None, panel: DataFrame, schema: str) -> DataFrame:
    if a is None and b is None:
        return panel.sparkSession.createDataFrame([], schema)
    return a.unionByName(b) if a is not None and b is not None else a if a is not None else b


def _statistics(model: VarModel, panel: DataFrame, reps: int, block: int | None, seed: int, time_col: str, of, schema: str,
                extra: DataFrame | None = None) -> DataFrame:
    """What ``of(row, factors of some replications)`` gives for the replications of every series; ``row``
    holds series_id, n_reg and the columns of ``extra``."""
    spec, k = model.spec, len(model.variables)
    d = spec.n_regressors(k) + k

    def whole(batches):
        for pdf in batches:
            for _, row in pdf.iterrows():
                for _, ys in _simulated(row, k, spec, seed):
                    yield of(row, K.factors_batch(ys, spec.lags, spec.has_const, spec.has_trend))

    def rows_of(part: pd.DataFrame) -> np.ndarray:
        paths = [_block_path(row, k, spec) for _, row in part.iterrows()]
        return np.concatenate([K.factors_batch(y[None], spec.lags, spec.has_const, spec.has_trend, first_t=at)[0] for at, y in paths])

    def merged(batches):
        for pdf in batches:
            for _, row in pdf.iterrows():
                yield of(row, unpack(row["r"], d)[None])

    def beside(df: DataFrame) -> DataFrame:
        return df if extra is None else df.join(extra, "series_id")

    items, blocks = _replicate(model, panel, reps, block, time_col), _long_blocks(model, panel, reps, seed, time_col)
    short = long_ = None
    if items is not None:
        short = beside(items).mapInPandas(whole, schema)
    if blocks is not None:
        factors = r_factors(blocks, ["series_id", "rep"], d, rows_of, lambda part: [len(part)])
        factors = factors.join(model.fits.select("series_id", "n_reg"), "series_id")
        long_ = beside(factors).mapInPandas(merged, schema)
    return _either(short, long_, panel, schema)


def _spark_percentile(values: np.ndarray, q: float) -> np.ndarray:
    """Exact percentile along the first, sorted axis, between neighbours as the engine's own ``percentile``."""
    at = (len(values) - 1) * q
    low, high = int(np.floor(at)), int(np.ceil(at))
    return values[low] if low == high else (high - at) * values[low] + (at - low) * values[high]


def bootstrap_irf(model: VarModel, panel: DataFrame, reps: int = 500, horizon: int = 12, alpha: float = 0.05,
                  seed: int = 1, block: int | None = None, time_col: str = "t") -> DataFrame:
    """(series_id, shock, response, horizon, point, lower, upper): bands are the alpha/2 and
    1-alpha/2 quantiles over replications; point is the original model's IRF."""
    if not 0 < alpha < 1:
        alpha = 0.05
    variables, spec = model.variables, model.spec
    k, p = len(variables), spec.lags

    def responses(row, r: np.ndarray) -> pd.DataFrame:
        n_reg = int(row["n_reg"])
        b, uu, _ = K.refit_batch(r, k, p, spec.n_det, n_reg)
        df = n_reg - b.shape[1] if n_reg > b.shape[1] else n_reg
        resp = np.stack([K.irf(K.lag_matrices(one.ravel(), k, p, spec.n_det), cross / df, horizon)[0] for one, cross in zip(b, uu)])
        return pd.DataFrame({"series_id": row["series_id"], "shock": variables, "draws": [resp[..., s].ravel() for s in range(k)]})

    def bands(group: pd.DataFrame) -> pd.DataFrame:
        draws = np.sort(np.concatenate([np.asarray(d, float).reshape(-1, horizon, k) for d in group["draws"]]), axis=0)
        h, r = np.indices((horizon, k)).reshape(2, -1)
        lower, upper = (_spark_percentile(draws, q).ravel() for q in (alpha / 2, 1 - alpha / 2))
        return pd.DataFrame({"series_id": group["series_id"].iloc[0], "shock": group["shock"].iloc[0], "response": np.array(variables, dtype=object)[r],
                             "horizon": h.astype(np.int32), "lower": lower, "upper": upper, "n_reps": len(draws)})

    draws = _statistics(model, panel, reps, block, seed, time_col, responses, "series_id string, shock string, draws array<double>")
    banded = draws.groupBy("series_id", "shock").applyInPandas(
        bands, "series_id string, shock string, response string, horizon int, lower double, upper double, n_reps bigint")
    point = irf(model, horizon).select("series_id", "shock", "response", "horizon", F.col("value").alias("point"))
    return point.join(banded, ["series_id", "shock", "response", "horizon"], "left")


def bootstrap_granger(model: VarModel, panel: DataFrame, reps: int = 500, alpha: float = 0.05, seed: int = 1,
                      block: int | None = None, time_col: str = "t") -> DataFrame:
    """Analytic Granger rows + boot_p = (#{F* >= F} + 1) / (reps + 1), significant_bootstrap = boot_p < alpha."""
    if not 0 < alpha < 1:
        alpha = 0.05
    variables, spec = model.variables, model.spec
    k, p = len(variables), spec.lags
    pairs = [(c, e) for c in range(k) for e in range(k) if c != e]
    cause, effect = (np.array(x) for x in zip(*pairs)) if pairs else (np.zeros(0, int), np.zeros(0, int))
    base = granger_matrix(model, 0.05)

    def f_draws(r: np.ndarray, n_reg: int) -> np.ndarray:
        b, uu, regular = K.refit_batch(r, k, p, spec.n_det, n_reg)
        dof = n_reg - b.shape[1]
        if dof <= 0:
            return np.zeros((len(r), k, k))
        gain = np.empty((len(r), k, k))
        if regular.any():
            gain[regular] = K.gains_batch(r[regular], b[regular], k, p, spec.n_det)
        for i in np.flatnonzero(~regular):
            gain[i] = K.cause_gains(r[i], k, p, spec.n_det)
        return K.f_statistics(gain, np.diagonal(uu, axis1=1, axis2=2)[:, None, :], p, dof)

    def exceedances(row, r: np.ndarray) -> pd.DataFrame:
        own = {(x["cause"], x["effect"]): x["f_stat"] for x in row["base"]}
        own = np.array([own.get((variables[c], variables[e]), np.nan) for c, e in pairs], dtype=float)
        counts = (f_draws(r, int(row["n_reg"]))[:, cause, effect] >= own).sum(axis=0)
        return pd.DataFrame({"series_id": [row["series_id"]], "reps": [len(r)], "counts": [counts.astype(np.int64)]})

    analytic = base.groupBy("series_id").agg(F.collect_list(F.struct("cause", "effect", "f_stat")).alias("base"))
    drawn = _statistics(model, panel, reps, block, seed, time_col, exceedances, "series_id string, reps bigint, counts array<bigint>", analytic)
    drawn = drawn.groupBy("series_id").agg(F.sum("reps").alias("n_reps"), F.collect_list("counts").alias("_all"))  # one array an item
    zero = F.array(*[F.lit(0).cast("bigint")] * len(pairs)) if pairs else F.array().cast("array<bigint>")
    total = F.aggregate("_all", zero, lambda s, x: F.zip_with(s, x, lambda u, v: u + v))
    names = F.array(*[F.struct(F.lit(variables[c]).alias("cause"), F.lit(variables[e]).alias("effect")) for c, e in pairs])
    if not pairs:
        exceed = drawn.select("series_id", F.lit("").alias("cause"), F.lit("").alias("effect"), F.lit(0).cast("bigint").alias("n_exceed"), "n_reps").limit(0)
    else:
        exceed = drawn.select("series_id", "n_reps", F.explode(F.arrays_zip(names.alias("pair"), total.alias("n"))).alias("_x"))
        exceed = exceed.select("series_id", "_x.pair.cause", "_x.pair.effect", F.col("_x.n").alias("n_exceed"), "n_reps")
    out = base.join(exceed, ["series_id", "cause", "effect"], "left")
    boot_p = (F.coalesce(F.col("n_exceed"), F.lit(0)) + 1) / F.lit(reps + 1)
    return out.select("series_id", "cause", "effect", "f_stat", F.col("p_value").alias("asymptotic_p"),
                      boot_p.alias("boot_p"), "lags", F.col("significant").alias("significant_asymptotic"),
                      (boot_p < F.lit(alpha)).alias("significant_bootstrap"), F.lit(alpha).alias("alpha"), "n_reps")
