"""VAR assumption diagnostics per (series, column): ADF, KPSS, RESET linearity, VIF, verdicts,
and the automatic log1p transform.

Input is the long form ``(series_id, variable, t, value)``; every test is an aggregation keyed by
(series_id, variable) over windowed features, with only tiny per-key solves in numpy.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.fdist import f_upper_tail
from panelcast.functions.scalar import joined_key, linearity_class, log_column_name, stationarity_class, vif_class
from panelcast.operators import kernels as K
from panelcast.operators.lags import LAG_BLOCK, positional_index
from panelcast.operators.rfactor import factor, merge_factors, pack, r_factors, unpack

__all__ = ["to_long_series", "kpss", "adf", "reset_linearity", "vif", "stationarity", "diagnostics_report",
           "log_transform", "MIN_OBS", "NO_LOG_COLUMNS"]

KEYS = ["series_id", "variable"]
MIN_OBS = 20
VIF_MIN_ROWS = 10

# KPSS (level) critical values and their p-values; Hobijn et al. auto-lag constant.
KPSS_CRIT = [0.347, 0.463, 0.574, 0.739]
KPSS_PVAL = [0.10, 0.05, 0.025, 0.01]
KPSS_AUTOLAG_C = 1.1447

# MacKinnon (1994) p-value surface, constant-only regression, one variable.
ADF_TAU_MAX, ADF_TAU_MIN, ADF_TAU_STAR = 2.74, -18.83, -1.61
ADF_SMALLP = [2.1659, 1.4412, 0.038269]
ADF_LARGEP = [1.7339, 0.93202, -0.12745, -0.010368]

# Fixed exclusion list of the automatic log transform.
NO_LOG_COLUMNS = ["LOG_INF_A", "LOG_INF_B", "temperature", "dew_point_temperature", "wet_bulb_temperature"]


def to_long_series(wide: DataFrame, columns: Sequence[str], series_col: str = "series_id", time_col: str = "t") -> DataFrame:
    """Wide training table -> (series_id, variable, t, value) with NULL/NaN dropped (tests use
    the non-missing values of each column)."""
    long = wide.unpivot([series_col, time_col], list(columns), "variable", "value")
    long = long.withColumnRenamed(series_col, "series_id").withColumnRenamed(time_col, "t")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("value", F.col("value").cast("double"))


def _positioned(long: DataFrame) -> DataFrame:
    """(series_id, variable, _skey, pos, n, value, e): position 0..n-1 among the non-missing values
    (distributed index), count and mean by a grouped aggregate joined back, e = value - mean.
    No window spans a whole series."""
    skey = joined_key(["series_id", "variable"])
    keyed = long.select(*KEYS, skey.alias("_skey"), "t", "value")
    stats = keyed.groupBy("_skey").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("_mean"))
    pos = positional_index(keyed, "_skey", ["t"], "pos")
    return (pos.join(stats, "_skey")
            .select(*KEYS, "_skey", "pos", "n", "value", (F.col("value") - F.col("_mean")).alias("e")))


BLOCK_SCHEMA = ("series_id string, variable string, _skey string, n bigint, L int, blk bigint, sums array<double>, "
                "products array<double>, counts array<double>, r array<double>, head array<struct<pos:bigint,z:array<double>>>")


def _block_pass(base: DataFrame, adf_range=None, products=None) -> DataFrame:
    """Everything the tests need of a (key, block) of a series, from one pass over ``base``; checkpointed.

    ``sums``: e^2, e P1, e P2 (orthogonal polynomials of the position), e, running sums of e within the block, their
    squares, rows. ``products``: e_t e_{t-j} for j up to the column ``products``. ``r``: packed factor of the
    Dickey-Fuller rows past the common start, as wide as the key's own range ``adf_range`` of lags asks for, and ``head``
    the few rows before it. A block also gets the rows of the block before that its lags reach, so a long series spreads over
    many tasks, and a key is never wider than its own lags.
    """
    from panelcast.session import cut_lineage
    rows = base.withColumn("L", F.lit(None).cast("int") if adf_range is None else adf_range.cast("int"))
    rows = rows.withColumn("P", F.lit(0) if products is None else products.cast("int"))
    reach = F.greatest(F.coalesce(F.col("L"), F.lit(0)) + 1, F.col("P"))
    width = F.greatest(F.lit(LAG_BLOCK), reach + 1)
    blk = F.floor(F.col("pos") / width)
    both = F.when(F.pmod(F.col("pos"), width) >= width - reach, F.array(blk, blk + 1)).otherwise(F.array(blk))
    rows = rows.withColumn("blk", F.explode(both)).withColumn("own", F.col("blk") == blk)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        first = pdf.iloc[0]
        n, own = float(first["n"]), pdf["own"].to_numpy(bool)
        if not own.any():  # the halo behind a series' last block
            return pd.DataFrame(columns=[f.split()[0] for f in BLOCK_SCHEMA.split(", ")])
        pos, y, e = pdf["pos"].to_numpy(), pdf["value"].to_numpy(float), pdf["e"].to_numpy(float)
        at = int(np.argmax(own))
        mine, p1 = e[at:], pos[at:] - (n - 1) / 2.0
        run = np.cumsum(mine)
        sums = [mine @ mine, mine @ p1, mine @ (p1 * p1 - (n * n - 1) / 12.0), mine.sum(), run.sum(), run @ run, len(mine)]
        lagged = [float(e[max(at, j):] @ e[max(at, j) - j: len(e) - j]) if len(e) > max(at, j) else 0.0 for j in range(1, int(first["P"]) + 1)]
        r = head = None
        if not pd.isna(first["L"]):
            size = int(first["L"])
            diff = np.concatenate([[0.0], np.diff(y)])  # of a halo's first row unknown, and never reached
            diff[pos == 0] = 0.0
            t = np.arange(max(at, 1), len(y))
            t = t[pos[t] >= 1]
            z = np.zeros((len(t), size + 3))
            z[:, 0], z[:, 1], z[:, -1] = 1.0, y[t - 1], diff[t]
            for j in range(1, size + 1):
                has = t >= j
                z[has, 1 + j] = diff[t[has] - j]
            late = pos[t] > size + 1
            r = pack(factor(z[late])) if late.any() else None
            head = [{"pos": int(p), "z": row} for p, row in zip(pos[t[~late]], z[~late])] or None
        return pd.DataFrame({"series_id": [first["series_id"]], "variable": [first["variable"]], "_skey": [first["_skey"]], "n": [int(n)],
                             "L": [first["L"]], "blk": [int(first["blk"])], "sums": [np.array(sums, float)], "products": [np.array(lagged, float)],
                             "counts": [np.array([float(len(mine))])], "r": [r], "head": [head]}).astype({"L": "Int32"})

    return cut_lineage(rows.groupBy("_skey", "blk").applyInPandas(fn, BLOCK_SCHEMA))


# ---------------------------------------------------------------- KPSS --------------------------
def _kpss_p(stat):
    """Linear interpolation on the critical-value table, clipped to its ends."""
    p = F.when(stat <= KPSS_CRIT[0], F.lit(KPSS_PVAL[0]))
    for (c0, c1), (p0, p1) in zip(zip(KPSS_CRIT, KPSS_CRIT[1:]), zip(KPSS_PVAL, KPSS_PVAL[1:])):
        p = p.when(stat <= c1, F.lit(p0) + (stat - F.lit(c0)) * F.lit((p1 - p0) / (c1 - c0)))
    return p.otherwise(F.lit(KPSS_PVAL[-1]))


def _lag_products(base: DataFrame, lags: DataFrame, weight: bool) -> DataFrame:
    """(_skey, products): sums over t of e_t e_{t-j} for j = 1..L of each key (``lags``: _skey, L).

    Positions are cut into blocks; a block also gets the last L values of the block before, so each
    (key, block) sums its own part and one long series spreads over many tasks, whatever its L. With
    ``weight`` the products are added up with Bartlett weights 1 - j / (L + 1) to a single number.
    """
    width = F.greatest(F.lit(LAG_BLOCK), F.col("L") + 1)
    block = F.floor(F.col("pos") / width)
    both = F.when(F.pmod(F.col("pos"), width) >= width - F.col("L"), F.array(block, block + 1)).otherwise(F.array(block))
    rows = base.select("_skey", "pos", "e").join(lags, "_skey").withColumn("_blk", F.explode(both)).withColumn("_own", F.col("_blk") == block)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        e, own, size = pdf["e"].to_numpy(float), pdf["_own"].to_numpy(), int(pdf["L"].iloc[0])
        first = int(np.argmax(own)) if own.any() else len(e)
        part = [float(e[max(first, j):] @ e[max(first, j) - j: len(e) - j]) if len(e) > max(first, j) else 0.0 for j in range(1, size + 1)]
        if weight:
            part = [float(sum(g * (1.0 - j / (size + 1.0)) for j, g in enumerate(part, 1)))]
        return pd.DataFrame({"_skey": [pdf["_skey"].iloc[0]], "part": [part]})

    parts = rows.groupBy("_skey", "_blk").applyInPandas(fn, "_skey string, part array<double>")
    cells = parts.select("_skey", F.posexplode("part").alias("j", "v")).groupBy("_skey", "j").agg(F.sum("v").alias("v"))
    whole = cells.groupBy("_skey").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("c"))
    return whole.select("_skey", F.expr("transform(c, x -> x.v)").alias("products"))


def _adf_range(maxlag: int | None = None):
    """Longest lag of a key's Dickey-Fuller test; NULL where it is not tested."""
    n = F.col("n").cast("double")
    own = F.lit(int(maxlag)) if maxlag is not None else F.least(F.floor(n / 2) - 2, F.ceil(12.0 * F.pow(n / 100.0, F.lit(0.25))))
    return F.when((F.col("n") >= MIN_OBS) & (own >= 0), own).cast("int")


def _kpss_range(nlags: int | str):
    """Lagged products that the first pass computes: those the automatic choice looks at, and as many as it usually takes."""
    n = F.col("n").cast("double")
    if nlags != "auto":
        return F.least(F.lit(int(nlags)), F.col("n") - 1).cast("int")
    return F.least(F.greatest(F.floor(F.pow(n, F.lit(2.0 / 9.0))), F.ceil(12.0 * F.pow(n / 100.0, F.lit(0.25)))), n - 1).cast("int")


def _bartlett(products, lag):
    """Products of lags 1..``lag`` under Bartlett weights 1 - j / (lag + 1)."""
    own = F.transform(F.slice(products, 1, F.greatest(lag, F.lit(0))), lambda g, j: g * (1.0 - (j + 1) / (lag + F.lit(1.0))))
    return F.aggregate(own, F.lit(0.0), lambda a, x: a + x)


def kpss(long: DataFrame, nlags: int | str = "auto", base: DataFrame | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """(series_id, variable, kpss_stat, kpss_p, kpss_lags, kpss_stationary = p >= 0.05).

    Level KPSS with Bartlett long-run variance; 'auto' picks the lag from the first n^(2/9)
    autocovariances (Hobijn et al.). A constant series has no statistic (NULL, not stationary).
    Running sums and lagged products come from the pass over blocks; only keys whose automatic lag is longer than
    usual take a second one.
    """
    from panelcast.session import cut_lineage
    if blocks is None:
        base = base if base is not None else cut_lineage(_positioned(long))
        blocks = _block_pass(base, products=_kpss_range(nlags))
    n = F.col("n").cast("double")
    s = [F.col("sums")[i] for i in range(7)]
    before = Window.partitionBy("_skey").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    runs = blocks.select(*KEYS, "_skey", "n", "sums", F.coalesce(F.sum(s[3]).over(before), F.lit(0.0)).alias("c"))
    square = s[6] * F.col("c") * F.col("c") + 2.0 * F.col("c") * s[4] + s[5]
    sums = runs.groupBy(*KEYS, "_skey").agg(F.first("n").alias("n"), F.sum(s[0]).alias("g0"), F.sum(square).alias("ss"))
    cells = blocks.select("_skey", F.posexplode("products").alias("j", "v")).groupBy("_skey", "j").agg(F.sum("v").alias("v"))
    whole = cells.groupBy("_skey").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("c"))
    sums = sums.join(whole.select("_skey", F.expr("transform(c, x -> x.v)").alias("products")), "_skey", "left")
    sums = sums.withColumn("products", F.coalesce("products", F.array().cast("array<double>")))
    if nlags == "auto":
        short = F.slice("products", 1, F.floor(F.pow(n, F.lit(2.0 / 9.0))).cast("int"))
        gammas = F.transform(short, lambda g, j: F.struct((g / (n / 2.0)).alias("g"), (j + 1).cast("double").alias("j")))
        s0 = F.col("g0") / n + F.aggregate(gammas, F.lit(0.0), lambda a, x: a + x["g"])
        s1 = F.aggregate(gammas, F.lit(0.0), lambda a, x: a + x["j"] * x["g"])
        lag = F.floor(F.lit(KPSS_AUTOLAG_C) * F.pow(F.pow(F.try_divide(s1, s0), 2), F.lit(1.0 / 3.0)) * F.pow(n, F.lit(1.0 / 3.0)))
        sums = sums.withColumn("lag", F.coalesce(F.least(lag, n - 1), F.lit(0)).cast("int"))
    else:
        sums = sums.withColumn("lag", F.least(F.lit(int(nlags)), F.col("n") - 1).cast("int"))
    stats = cut_lineage(sums).withColumn("w", _bartlett(F.col("products"), F.col("lag")))
    longer = stats.where(F.col("lag") > F.size("products")).select("_skey", F.col("lag").alias("L"))
    if not longer.isEmpty():
        base = base if base is not None else cut_lineage(_positioned(long))
        far = _lag_products(base, longer, weight=True).select("_skey", F.col("products")[0].alias("far"))
        stats = stats.join(far, "_skey", "left").withColumn("w", F.coalesce("far", "w"))
    long_run = F.col("g0") + 2.0 * F.col("w")
    stat = F.when(F.col("g0") > 0, F.try_divide(F.col("ss") / n, long_run))
    stats = stats.select(*KEYS, "n", stat.alias("stat"), F.col("lag").alias("kpss_lags"))
    stat = F.col("stat")
    p = _kpss_p(stat)
    ok = (F.col("n") >= MIN_OBS) & stat.isNotNull()
    return stats.select(*KEYS, F.when(ok, stat).alias("kpss_stat"), F.when(ok, p).alias("kpss_p"), "kpss_lags",
                        F.coalesce(ok & (p >= 0.05), F.lit(False)).alias("kpss_stationary"))


# ---------------------------------------------------------------- ADF ---------------------------
def _norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def mackinnon_p(tau: float) -> float:
    if not np.isfinite(tau):
        return float("nan")
    if tau > ADF_TAU_MAX:
        return 1.0
    if tau < ADF_TAU_MIN:
        return 0.0
    coef = ADF_SMALLP if tau <= ADF_TAU_STAR else ADF_LARGEP
    return _norm_cdf(sum(c * tau ** i for i, c in enumerate(coef)))


def _adf_from_factor(r: np.ndarray, head: dict[int, np.ndarray], n: int, max_lag: int, auto: bool) -> tuple[float, int]:
    """(tau, lag) from the factor of the rows past the common start and the few rows before it.

    Columns are [1, y_{t-1}, dy_{t-1}, ..., dy_{t-L}, dy_t]; the models are nested in this order, so the
    sums of squares of all lags are tails of the last column of one factor.
    """
    own = [*range(2 + max_lag), r.shape[1] - 1]

    def sample(lag: int) -> np.ndarray:  # rows at positions lag + 1 and later
        early = [head[t] for t in sorted(head) if t >= lag + 1]
        return factor(np.vstack([r, *early])[:, own])

    lag = max_lag
    if auto:
        y, nobs = sample(max_lag)[:, -1], n - 1 - max_lag
        tails = np.cumsum((y * y)[::-1])[::-1]
        ssr = np.array([tails[2 + j] if 2 + j < len(y) else 0.0 for j in range(max_lag + 1)])
        with np.errstate(divide="ignore"):
            aic = nobs * (np.log(2 * np.pi) + np.log(ssr / nobs) + 1) + 2 * (2 + np.arange(max_lag + 1))
        lag = int(np.argmin(aic))
    keep = [*range(2 + lag), len(own) - 1]
    f = factor(sample(lag)[:, keep])
    m = 2 + lag
    dof = n - 1 - lag - m
    x, norm = K.scaled(f[:m, :m])
    sv = np.linalg.svd(x, compute_uv=False)
    if dof <= 0 or not sv[-1] > K.RANK_TOL * sv[0] > 0:
        return float("nan"), lag
    inverse = np.linalg.inv(x) / norm[:, None]
    se = math.sqrt(f[m, m] ** 2 / dof * float(inverse[1] @ inverse[1]))
    return (float(inverse[1] @ f[:m, m] / se) if se > 0 else float("nan")), lag


def adf(long: DataFrame, base: DataFrame | None = None, maxlag: int | None = None, autolag: str | None = "AIC",
        blocks: DataFrame | None = None) -> DataFrame:
    """Augmented Dickey-Fuller with constant; lag by AIC over 0..maxlag on the common sample,
    then refit with the chosen lag on its own sample; p from the MacKinnon surface. With
    ``autolag=None`` the given ``maxlag`` is used as the lag.

    A key's lags reach 12 (n / 100)^(1/4) positions back, its own range whatever the others have. Per key one
    triangular factor of that width holds all rows past the common start; the rows before it, as many as
    lags, are kept as they are, so every lag's own sample is at hand without a second pass. Keys with
    fewer than MIN_OBS values or without a statistic (constant series) have NULL results.
    """
    from panelcast.session import cut_lineage
    if blocks is None:
        blocks = _block_pass(base if base is not None else cut_lineage(_positioned(long)), _adf_range(maxlag))
    every = blocks.groupBy(*KEYS).agg(F.first("n").alias("n"), F.first("L").alias("L"))
    late = merge_factors(blocks.where("r is not null"), KEYS)
    early = blocks.where("head is not null").groupBy(*KEYS).agg(F.flatten(F.collect_list("head")).alias("head"))  # L + 1 rows a key, at most
    per_key = every.join(late.select(*KEYS, "r"), KEYS, "left").join(early, KEYS, "left")

    def fn(batches):
        for pdf in batches:
            out = []
            for sid, col, n, max_lag, packed, head in zip(*(pdf[c] for c in ("series_id", "variable", "n", "L", "r", "head"))):
                tau, lag = float("nan"), None
                if head is not None:
                    d = int(max_lag) + 3
                    r = np.zeros((d, d)) if packed is None else unpack(packed, d)
                    tau, lag = _adf_from_factor(r, {int(h["pos"]): np.asarray(h["z"], float) for h in head}, int(n), int(max_lag), bool(autolag))
                p = mackinnon_p(tau)
                ok = bool(np.isfinite(tau))
                out.append((sid, col, tau if ok else None, p if ok else None, lag, ok and p < 0.05))
            yield pd.DataFrame(out, columns=["series_id", "variable", "adf_stat", "adf_p", "adf_lags", "adf_stationary"])

    return per_key.mapInPandas(fn, "series_id string, variable string, adf_stat double, adf_p double, adf_lags int, "
                                   "adf_stationary boolean")


# ---------------------------------------------------------------- RESET -------------------------
def reset_linearity(long: DataFrame, base: DataFrame | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """RESET on a time trend: y ~ 1 + t versus y ~ 1 + t + yhat^2, F(1, n - 3).

    yhat^2 is a quadratic in t, so the extended fit equals a quadratic trend; with orthogonal
    polynomials P1 = t - tbar, P2 = P1^2 - (n^2-1)/12 on equally spaced positions both RSS values
    come from four sums in one aggregation.
    """
    from panelcast.session import cut_lineage
    if blocks is None:
        blocks = _block_pass(base if base is not None else cut_lineage(_positioned(long)))
    part = [F.sum(F.col("sums")[i]) for i in range(3)]
    s = blocks.groupBy(*KEYS).agg(F.first("n").alias("n"), part[0].alias("see"), part[1].alias("sep1"), part[2].alias("sep2"))
    n = F.col("n").cast("double")
    sp1 = n * (n * n - 1) / 12.0
    sp2 = n * (n * n - 1) * (n * n - 4) / 180.0
    rss1 = F.col("see") - F.col("sep1") * F.col("sep1") / sp1
    rss2 = rss1 - F.col("sep2") * F.col("sep2") / sp2
    dfd = n - 3
    ok = (n >= MIN_OBS) & (rss2 > 0) & (dfd > 0)
    fstat = F.when(ok, (rss1 - rss2) / (rss2 / dfd))
    out = s.select(*KEYS, "n", fstat.alias("reset_f"), dfd.alias("_dfd"))
    out = out.withColumn("reset_p", f_upper_tail(F.col("reset_f"), F.lit(1.0), F.col("_dfd")))
    return out.select(*KEYS, "reset_f", "reset_p",
                      F.coalesce(F.col("reset_p") >= 0.05, F.lit(False)).alias("is_linear"))


# ---------------------------------------------------------------- VIF ---------------------------
def vif(wide: DataFrame, columns: Sequence[str], series_col: str = "series_id") -> DataFrame:
    """Uncentred VIF per column (no constant added): |x_i|^2 / SSR_i with SSR_i the residual sum of
    squares of column i on the others, from one triangular factor per series over complete rows."""
    columns = list(columns)
    complete = wide.withColumnRenamed(series_col, "series_id").select("series_id", *[F.col(c).cast("double").alias(c) for c in columns])
    rows = complete.dropna(subset=columns)  # NaN counts as missing too
    d = len(columns)
    factors = r_factors(rows, ["series_id"], d, lambda part: part[columns].to_numpy(float), lambda part: [float(len(part))])

    def fn(batches):
        for pdf in batches:
            out = []
            for sid, counts, packed in zip(pdf["series_id"], pdf["counts"], pdf["r"]):
                r = unpack(packed, d)
                for i, c in enumerate(columns):
                    if counts[0] < VIF_MIN_ROWS:
                        out.append((sid, c, float("nan")))
                        continue
                    rest = K.residual_part(np.delete(r, i, axis=1), r[:, i])
                    ssr, whole = float(rest @ rest), float(r[:, i] @ r[:, i])
                    out.append((sid, c, whole / ssr if ssr > (1e-14 * np.sqrt(d)) ** 2 * whole > 0 else float("inf")))
            yield pd.DataFrame(out, columns=["series_id", "variable", "vif"])

    return factors.mapInPandas(fn, "series_id string, variable string, vif double").withColumn("vif_class", vif_class("vif"))


# ---------------------------------------------------------------- verdicts ----------------------
def stationarity(adf_df: DataFrame, kpss_df: DataFrame) -> DataFrame:
    j = adf_df.join(kpss_df, KEYS, "full")
    return j.withColumn("stationarity", stationarity_class("adf_stationary", "kpss_stationary"))


def diagnostics_report(wide: DataFrame, columns: Sequence[str], series_col: str = "series_id",
                       time_col: str = "t", adf_maxlag: int | None = None) -> DataFrame:
    """ADF, KPSS, verdict, RESET and VIF of every (series, column), in one table."""
    from panelcast.session import cut_lineage
    wide = cut_lineage(wide.select(series_col, time_col, *columns))
    long = to_long_series(wide, columns, series_col, time_col)
    base = cut_lineage(_positioned(long))
    blocks = _block_pass(base, _adf_range(adf_maxlag), _kpss_range("auto"))  # one pass for the three tests of a column
    st = stationarity(adf(long, base, adf_maxlag, blocks=blocks), kpss(long, base=base, blocks=blocks))
    lin = reset_linearity(long, base, blocks).withColumn("linearity", linearity_class("is_linear"))
    v = vif(wide, columns, series_col)
    return st.join(lin, KEYS, "full").join(v, KEYS, "full")


def log_transform(wide: DataFrame, report: DataFrame, columns: Sequence[str], series_col: str = "series_id",
                  time_col: str = "t", exclude: Sequence[str] = NO_LOG_COLUMNS, replace: bool = False) -> DataFrame:
    """Add LOG_<COL> = log1p(col) (original kept) for columns that are non-stationary or
    non-linear, not excluded and with min >= 0 in that series; long output
    (series_id, t, column, value) holding the originals plus the added LOG rows, so each
    series gets its own column set without a driver-side decision. ``replace`` drops the
    original of every transformed column (avoids x beside log1p(x) in a later VAR fit)."""
    long = to_long_series(wide, columns, series_col, time_col)
    mins = long.groupBy(*KEYS).agg(F.min("value").alias("_min"))
    need = (report.filter((F.col("stationarity") == "Non-stationary") | ~F.coalesce(F.col("is_linear"), F.lit(False)))
            .select(*KEYS).filter(~F.col("variable").isin(list(exclude))))
    need = need.join(mins, KEYS).filter(F.col("_min") >= 0).select(*KEYS)
    name_map = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(log_column_name(c)))])
    added = (long.join(need, KEYS, "left_semi")
             .select("series_id", "t", F.element_at(name_map, F.col("variable")).alias("variable"),
                     F.log1p("value").alias("value")))
    kept = long.join(need, KEYS, "left_anti") if replace else long
    return kept.select("series_id", "t", "variable", "value").unionByName(added)
