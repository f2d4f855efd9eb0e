"""Choice-model quantities as column expressions over long tables, and fits that run side by side in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import log2cosh, log_sigmoid, sigmoid
from . import kernels


def gated_terms(delta: Column, gamma: Column, beta: Column, x: Column) -> dict[str, Column]:
    """Of one pair and criterion: gate probabilities, log likelihoods, residuals and Fisher weights."""
    zc, zd = log2cosh(delta) + gamma, delta + beta
    pc, pd_ = sigmoid(zc), sigmoid(zd)
    cited = F.when(x != 0, 1.0).otherwise(0.0)
    pos = F.when(x == 1, 1.0).otherwise(0.0)
    t = F.tanh(delta)
    rc, rd = cited - pc, pos - cited * pd_
    return {
        "p_cite": pc,
        "p_dir": pd_,
        "ll_cite": F.when(x != 0, log_sigmoid(zc)).otherwise(log_sigmoid(-zc)),
        "ll_dir": F.when(x == 1, log_sigmoid(zd)).when(x == -1, log_sigmoid(-zd)).otherwise(0.0),
        "r_cite": rc,
        "r_dir": rd,
        "slope": rc * t + rd,
        "h_dd": pc * (1 - pc) * t * t + cited * pd_ * (1 - pd_),
    }


def frozen_score(comparisons: Column, ridge: float = 1e-3, steps: int = 12) -> Column:
    """Newton's score of a query item from ``array<struct<sign, c, w>>``: winner logit sign * x + c, w is 1 if the first won."""

    def step(x: Column, _: Column) -> Column:
        p = lambda q: sigmoid(q["sign"] * x + q["c"])
        g = F.aggregate(comparisons, ridge * x, lambda s, q: s + q["sign"] * (p(q) - q["w"]))
        h = F.aggregate(comparisons, F.lit(ridge), lambda s, q: s + p(q) * (1 - p(q)))
        return x - g / h

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), step)


HOLISTIC = "gamma double, beta double, se_gamma double, se_beta double, spread double, noise double, se_spread double, spread_denoised double, kappa double, kappa_winner double, rho double, sign double, nll double, restart_gap double, accuracy double, steps int"


def fit_holistic(cells: DataFrame, run: str = "run", ridge: float = 1e-3, seed: int = 0) -> DataFrame:
    """Holistic fits, one per ``run``, of dense cells ``run, t, a, b, w, k, r``; a row per criterion.

    ``kappa`` and ``rho`` are those of the mention channel, ``kappa_winner`` that of the winners. ``sign`` is the
    correlation of scores with wins while mentioned; ``restart_gap`` is the difference in value to a fit from a random
    start, near 0 as the likelihood is concave. A run is one task that factors K criteria by the levels of its graph.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index=["t", "a", "b", "w"], columns="k", values="r").sort_index()
        at = wide.index.to_frame()
        nodes, numbers = np.unique(at[["a", "b"]].to_numpy(), return_inverse=True)
        m = kernels.Holistic(numbers.reshape(-1, 2), at["w"].to_numpy(), wide.to_numpy(float), len(nodes), ridge)
        p, steps = m.fit()
        again, _ = m.fit(start=np.random.default_rng(seed).normal(0, 0.1, m.size))
        s, g, b = m.split(p)
        z, _ = m.logits(p)
        return pd.DataFrame({run: pdf[run].iloc[0], "k": wide.columns, "gamma": g, "beta": b, **m.inference(p), "sign": m.signs(p), "nll": m.value(p), "restart_gap": abs(m.value(p) - m.value(again)), "accuracy": float(((z > 0) == (m.w > 0)).mean()), "steps": steps})[[run, "k", *[c.split()[0] for c in HOLISTIC.split(", ")]]]

    kind = cells.schema[run].dataType.simpleString()
    return cells.groupBy(run).applyInPandas(fit, f"{run} {kind}, k int, {HOLISTIC}")


def holistic_forecasts(cells: DataFrame, run: str = "run", ridge: float = 1e-3) -> DataFrame:
    """Forecasts of held-out pairs: ``run, held, t, k, w, r, p_win, p_mention``, from fits without their fold.

    Dense cells ``run, t, a, b, w, k, r, fold``; every run and fold is a fit of its own, side by side. ``p_mention``
    takes the winner as known, as the model does. An item that no training pair has scores 0.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index=["t", "a", "b", "w", "fold"], columns="k", values="r").sort_index()
        at = wide.index.to_frame(index=False)
        nodes, numbers = np.unique(at[["a", "b"]].to_numpy(), return_inverse=True)
        pairs, w, r = numbers.reshape(-1, 2), at["w"].to_numpy(), wide.to_numpy(float)
        out = (at["fold"] == pdf["held"].iloc[0]).to_numpy()
        p, _ = kernels.Holistic(pairs[~out], w[~out], r[~out], len(nodes), ridge).fit()
        z, zm = kernels.Holistic(pairs[out], w[out], r[out], len(nodes), ridge).logits(p)
        k, n = r.shape[1], int(out.sum())
        flat = {"t": np.repeat(at["t"][out], k), "k": np.tile(wide.columns, n), "w": np.repeat(w[out], k), "r": r[out].ravel().astype(int), "p_win": np.repeat(kernels.sigmoid(z), k), "p_mention": kernels.sigmoid(zm).ravel()}
        return pd.DataFrame({run: pdf[run].iloc[0], "held": pdf["held"].iloc[0], **flat})

    kind = cells.schema[run].dataType.simpleString()
    folds = cells.select(run, F.col("fold").alias("held")).distinct()
    return cells.join(folds, run).groupBy(run, "held").applyInPandas(fit, f"{run} {kind}, held int, t long, k int, w int, r int, p_win double, p_mention double")


def fit_bradley_terry(comparisons: DataFrame, by: list[str], ridge: float = 1e-3) -> DataFrame:
    """Scores per ``by`` and item of comparisons ``a`` (shown first), ``b``, ``w``."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, numbers = np.unique(pdf[["a", "b"]].to_numpy(), return_inverse=True)
        s, beta = kernels.bradley_terry(numbers.reshape(-1, 2), pdf["w"].to_numpy(), len(nodes), ridge)
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in by}, "item": nodes, "score": s, "beta": beta})

    kinds = ", ".join(f"{c} {comparisons.schema[c].dataType.simpleString()}" for c in by)
    return comparisons.groupBy(*by).applyInPandas(fit, f"{kinds}, item long, score double, beta double")


def calibration(cells: DataFrame, p: str, y: str, reference: str, by: list[str], bins: Column) -> DataFrame:
    """Expected calibration error, Brier score and its skill over one half and over ``reference``, per ``by``."""
    b = cells.withColumn("bin", bins).groupBy(*by, "bin").agg(
        F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum(y).alias("sy"), F.sum(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("se"), F.sum(F.pow(F.col(reference) - F.col(y), F.lit(2.0))).alias("sr")
    )
    g = b.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.abs(F.col("sp") - F.col("sy"))).alias("gap"), F.sum("se").alias("se"), F.sum("sr").alias("sr"))
    brier = F.col("se") / F.col("n")
    return g.select(*by, "n", (F.col("gap") / F.col("n")).alias("ece"), brier.alias("brier"), (1 - brier / 0.25).alias("skill_chance"), (1 - F.col("se") / F.when(F.col("sr") != 0, F.col("sr"))).alias("skill_reference"))


def likelihood_ratio_p(chi2: float, df: int) -> float:
    """Upper tail of chi-squared by the incomplete gamma function's series and continued fraction."""
    a, x = df / 2, chi2 / 2
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))
