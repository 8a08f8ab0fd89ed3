"""Convergence diagnostics and draw summaries.

A parameter is named by ``variable`` and, where it has them, ``idx`` and ``idx2``; scalars
have NULL indices, and keys are compared NULL-safe.  Moments, quantiles and both forms of
R-hat are grouped aggregates and windows over one parameter's draws, whose number is fixed by
the sampler settings (chains x iterations), not by the data.  The effective sample sizes need
autocovariances and run as one grouped pandas function per parameter."""

from __future__ import annotations

import sys
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .draws import DRAW_KEYS
from ..operators.relational import group_quantiles, join_keys
from ..operators.sampling import sample_global

# the grouped function below also runs on executors without this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# Coefficients of Acklam's rational approximation of the inverse
# standard normal CDF (published; relative error below 1.2e-9).
_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
      1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
      6.680131188771972e+01, -1.328068155288572e+01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
      -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
      3.754408661907416e+00)
_LOW = 0.02425  # below it and above 1 - it the tail form holds


def param_keys(draws: DataFrame) -> list[str]:
    """The columns that name a parameter in this table."""
    return [k for k in ("variable", "idx", "idx2") if k in draws.columns]


def summarise_draws(draws: DataFrame, by=None) -> DataFrame:
    """B2: mean, median, sd, mad (scaled by 1.4826), 5% and 95% quantiles
    (linear interpolation, R type 7) per parameter, scalars included."""
    by = list(by or param_keys(draws))
    base = draws.groupBy(*by).agg(
        F.avg("value").alias("mean"),
        F.percentile("value", 0.5).alias("median"),
        F.stddev_samp("value").alias("sd"),
        F.percentile("value", 0.05).alias("q5"),
        F.percentile("value", 0.95).alias("q95"))
    dev = join_keys(draws, base.select(*by, "median"), by) \
        .groupBy(*by).agg((F.percentile(F.abs(F.col("value") - F.col("median")), 0.5) * 1.4826).alias("mad"))
    return join_keys(base, dev, by).select(*by, "mean", "median", "sd", "mad", "q5", "q95")


def split_halves(draws: DataFrame, by=None) -> DataFrame:
    """Each chain cut in two halves of floor(n/2) draws by the rank of the iteration, so
    offsets, thinning and 1-based numbers do not matter (the middle draw of an odd-length
    chain is dropped, as the statistic asks); ``half`` is 0 or 1."""
    by = list(by or param_keys(draws))
    w = Window.partitionBy(*by, "chain")
    n = F.count(F.lit(1)).over(w)
    rank = F.row_number().over(w.orderBy("iteration"))
    h = F.floor(n / 2)
    half = F.when(rank <= h, 0).when(rank > n - h, 1)
    return draws.withColumn("half", half).where(F.col("half").isNotNull())


def _rhat_of_halves(halves: DataFrame, by, value: str) -> DataFrame:
    """Within-half variance W, between-half variance B = n var(half means),
    R = sqrt(((n-1)/n W + B/n) / W); NULL where nothing varies."""
    parts = halves.groupBy(*by, "chain", "half").agg(
        F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(F.lit(1)).alias("n"))
    per = parts.groupBy(*by).agg(
        F.avg("v").alias("W"), F.var_samp("m").alias("var_m"), F.min("n").alias("n"))
    n = F.col("n").cast("double")
    rhat = F.sqrt(((n - 1) / n * F.col("W") + F.col("var_m")) / F.col("W"))
    return per.select(*by, F.when(F.col("W") > 0, rhat).alias("rhat"))


def split_rhat(draws: DataFrame, by=None) -> DataFrame:
    """Split R-hat (Gelman et al.)."""
    by = list(by or param_keys(draws))
    return _rhat_of_halves(split_halves(draws, by), by, "value")


def inv_normal(p: Column) -> Column:
    """Inverse standard normal CDF by Acklam's rational approximation."""
    def poly(x, coefficients):
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + F.lit(c)
        return out

    q = p - 0.5
    r = q * q
    middle = poly(r, _A) * q / (poly(r, _B) * r + 1)

    def tail(x):
        t = F.sqrt(-2 * F.log(x))
        return poly(t, _C) / (poly(t, _D) * t + 1)

    return F.when(p < _LOW, tail(p)).when(p > 1 - _LOW, -tail(1 - p)).otherwise(middle)


def rank_rhat(draws: DataFrame, by=None) -> DataFrame:
    """B3, rank form (Vehtari et al. 2021): the split draws of a parameter are replaced by
    normal scores of their average ranks, and R-hat is the larger of the values for the
    draws and for their distances from the median."""
    by = list(by or param_keys(draws))
    med = draws.groupBy(*by).agg(F.percentile("value", 0.5).alias("_med"))
    t = split_halves(join_keys(draws, med, by), by).withColumn("_folded", F.abs(F.col("value") - F.col("_med")))
    group = Window.partitionBy(*by)
    size = F.count(F.lit(1)).over(group)

    def score(column):
        ties = F.count(F.lit(1)).over(Window.partitionBy(*by, column))
        rank = F.rank().over(group.orderBy(column)) + (ties - 1) / 2
        return inv_normal((rank - 3 / 8) / (size + 1 / 4))

    t = t.withColumn("_z", score("value")).withColumn("_zf", score("_folded"))
    bulk = _rhat_of_halves(t, by, "_z").withColumnRenamed("rhat", "bulk")
    folded = _rhat_of_halves(t, by, "_zf").withColumnRenamed("rhat", "folded")
    return join_keys(bulk, folded, by).select(*by, F.greatest("bulk", "folded").alias("rhat"))


def summarise_all(draws: DataFrame) -> DataFrame:
    """B2 complete: moments and quantiles with the R-hat column."""
    by = param_keys(draws)
    return join_keys(summarise_draws(draws, by), rank_rhat(draws, by), by, "left")


def rhat_table(rhats: DataFrame, type_col: str = "variable") -> DataFrame:
    """Mean / median / max / sd of R-hat per model (or variable) type and the
    share below 1.1 (NULL R-hats dropped)."""
    r = rhats.where(F.col("rhat").isNotNull())
    # a type (e.g. every voter's alpha) is not bounded: exact median by ranks
    med = group_quantiles(r, [type_col], "rhat", {"median": 0.5})
    agg = r.groupBy(type_col).agg(
        F.avg("rhat").alias("mean"), F.max("rhat").alias("max"), F.stddev_samp("rhat").alias("sd"),
        (F.sum(F.when(F.col("rhat") < 1.1, 1).otherwise(0)) / F.count(F.lit(1))).alias("share_below_1_1"))
    return join_keys(agg, med, [type_col]).select(type_col, "mean", "median", "max", "sd", "share_below_1_1")


def box_summary(rhats: DataFrame, type_col: str = "variable") -> DataFrame:
    """Quartiles and range of R-hat per type."""
    r = rhats.where(F.col("rhat").isNotNull())
    qs = group_quantiles(r, [type_col], "rhat", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    ext = r.groupBy(type_col).agg(F.min("rhat").alias("min"), F.max("rhat").alias("max"))
    return join_keys(ext, qs, [type_col]).select(type_col, "min", "q1", "median", "q3", "max")


def interval_summary(draws: DataFrame, by=None, value_col: str = "value") -> DataFrame:
    """Median with 66% and 95% central intervals per group."""
    by = list(by or param_keys(draws))
    v = F.col(value_col)
    probs = {"median": 0.5, "lower66": 0.17, "upper66": 0.83, "lower95": 0.025, "upper95": 0.975}
    if {"variable", "idx"} <= set(by):
        # one parameter's draws: bounded by the sampler settings
        return draws.groupBy(*by).agg(*[F.percentile(v, p).alias(k) for k, p in probs.items()],
                                      F.count(F.lit(1)).alias("n"))
    # other groupings (e.g. all voters of one choice) are unbounded: exact ranks
    n = draws.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return join_keys(n, group_quantiles(draws, by, value_col, probs), by, "left").select(*by, *probs, "n")


def trace_table(draws: DataFrame, n: int = 24, seed=2139, threshold: float = 0.1,
                exclude_pattern: str = "raw") -> DataFrame:
    """Traces of ``n`` randomly chosen parameters whose |mean| exceeds the
    threshold and whose name does not match ``exclude_pattern``."""
    keys = param_keys(draws)
    s = draws.groupBy(*keys).agg(F.avg("value").alias("mean"))
    eligible = s.where((F.abs(F.col("mean")) > threshold) & ~F.col("variable").rlike(exclude_pattern))
    picked = sample_global(eligible.select(*keys), keys, n, seed)
    return join_keys(draws, picked, keys, "left_semi").select(*keys, "chain", "iteration", "value")


# --------------------------------------------------------------- effective sample size

def _split(x: np.ndarray) -> np.ndarray:
    n = x.shape[0]
    h = n // 2
    return np.concatenate([x[:h], x[n - h:]], axis=1) if h else x


def _z_scale(x: np.ndarray) -> np.ndarray:
    flat = x.ravel(order="F")
    r = pd.Series(flat).rank(method="average").to_numpy()
    z = np.array([NormalDist().inv_cdf(p) for p in (r - 3.0 / 8.0) / (flat.size + 0.25)])
    return z.reshape(x.shape, order="F")


def _autocov(x: np.ndarray) -> np.ndarray:
    n = x.size
    size = 1 << int(np.ceil(np.log2(2 * n)))
    c = x - x.mean()
    f = np.fft.rfft(c, size)
    ac = np.fft.irfft(f * np.conj(f), size)[:n]
    return ac / n


def _ess_basic(x: np.ndarray) -> float:
    """Effective sample size of chains stored as columns: autocorrelations
    averaged over chains, Geyer's initial positive then monotone sequence,
    and the variance-reducing last term (Vehtari et al. 2021).  Lag k is at
    position k of ``rho``."""
    n, m = x.shape
    if n < 4 or not np.all(np.isfinite(x)):
        return float("nan")
    acov = np.stack([_autocov(x[:, j]) for j in range(m)], axis=1).mean(axis=1)
    mean_var = acov[0] * n / (n - 1.0)
    var_plus = mean_var * (n - 1.0) / n
    if m > 1:
        var_plus += x.mean(axis=0).var(ddof=1)
    if not var_plus > 0:
        return float("nan")
    rho = np.zeros(n)
    rho[0] = rho_even = 1.0
    rho[1] = rho_odd = 1.0 - (mean_var - acov[1]) / var_plus
    t = 0
    while t < n - 5 and (rho_even + rho_odd) > 0:
        t += 2
        rho_even = 1.0 - (mean_var - acov[t]) / var_plus
        rho_odd = 1.0 - (mean_var - acov[t + 1]) / var_plus
        if rho_even + rho_odd >= 0:
            rho[t] = rho_even
            rho[t + 1] = rho_odd
    max_t = t
    if rho_even > 0:
        rho[max_t] = rho_even
    t = 0
    while t <= max_t - 4:
        t += 2
        if rho[t] + rho[t + 1] > rho[t - 2] + rho[t - 1]:
            rho[t] = (rho[t - 2] + rho[t - 1]) / 2.0
            rho[t + 1] = rho[t]
    total = float(m * n)
    tau = -1.0 + 2.0 * rho[:max_t].sum() + rho[max_t]
    tau = max(tau, 1.0 / np.log10(total))
    return total / tau


def ess_pdf(pdf: pd.DataFrame) -> pd.DataFrame:
    """Bulk ESS and tail ESS of one parameter, over the iterations that every chain has
    (an autocovariance needs complete rows); NULL with fewer than four of them."""
    keys = [k for k in ("variable", "idx", "idx2") if k in pdf.columns]
    out = pdf[keys].iloc[:1].reset_index(drop=True)
    piv = pdf.pivot_table(index="iteration", columns="chain", values="value", aggfunc="first").sort_index()
    x = piv.dropna(axis=0).to_numpy(dtype=float)
    if x.shape[0] < 4:
        return out.assign(ess_bulk=np.nan, ess_tail=np.nan)
    q5, q95 = np.quantile(x, [0.05, 0.95])
    return out.assign(ess_bulk=_ess_basic(_z_scale(_split(x))),
                      ess_tail=min(_ess_basic(_split((x <= q).astype(float))) for q in (q5, q95)))


def ess(draws: DataFrame) -> DataFrame:
    """Per parameter bulk and tail effective sample size, scalars included."""
    keys = param_keys(draws)
    fields = [draws.schema[k] for k in keys] + [T.StructField(c, T.DoubleType()) for c in ("ess_bulk", "ess_tail")]
    return draws.select(*keys, "chain", "iteration", "value").groupBy(*keys).applyInPandas(ess_pdf, T.StructType(fields))


__all__ = ["summarise_draws", "split_rhat", "rank_rhat", "rhat_table", "box_summary", "interval_summary",
           "trace_table", "ess", "summarise_all", "inv_normal", "param_keys", "DRAW_KEYS"]
