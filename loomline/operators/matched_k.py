"""Accuracy curves of two panels at matched numbers of criteria, resampled over subsets and pairs together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import md5_number
from .stats import replicate_index


def draw(of: Column, *names: Column | str) -> Column:
    """A number below ``of`` from a hash of ``names``."""
    return md5_number(F.concat_ws(":", *[n.cast("string") if isinstance(n, Column) else F.lit(n) for n in names])) % of


def subset_weights(panels: DataFrame, reps: int) -> DataFrame:
    """``rep, arm, k, subset, w``, summing to one: alike where all subsets are listed, else shares of as many draws.

    ``panels``: ``arm, k, exact, n_subsets`` (subsets are numbered from 0).
    """
    each = panels.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    index = F.explode(F.sequence(F.lit(0), F.col("n_subsets").cast("int") - 1)).alias("j")
    alike = each.filter("exact").select("rep", "arm", "k", index, (F.lit(1.0) / F.col("n_subsets")).alias("w")).withColumnRenamed("j", "subset")
    drawn = each.filter("not exact").select("rep", "arm", "k", "n_subsets", index)
    drawn = drawn.select("rep", "arm", "k", draw(F.col("n_subsets"), "subset", F.col("rep"), F.col("arm"), F.col("k"), F.col("j")).alias("subset"), (F.lit(1.0) / F.col("n_subsets")).alias("w"))
    drawn = drawn.groupBy("rep", "arm", "k", "subset").agg(F.sum("w").alias("w"))
    return alike.select("rep", "arm", "k", F.col("subset").cast("long").alias("subset"), "w").unionByName(drawn)


def resampled(correct: DataFrame, panels: DataFrame, n_pairs: int, reps: int) -> DataFrame:
    """``rep, arm, k, acc`` for replicates that redraw subsets per panel and pairs for all panels alike.

    ``correct``: ``arm, k, subset, pair, ok``, pairs numbered from 0. A pair counts as often as it is drawn, so the
    resample meets the verdicts once, and only sums by replicate and panel are shuffled.
    """
    times = replicate_index(correct, n_pairs, reps, "pairs").groupBy("rep", F.col("i").alias("pair")).agg(F.count("*").alias("times"))
    met = correct.join(times, "pair").join(F.broadcast(subset_weights(panels, reps)), ["rep", "arm", "k", "subset"])
    return met.groupBy("rep", "arm", "k").agg((F.sum(F.col("times") * F.col("w") * F.col("ok")) / float(n_pairs)).alias("acc"))


def curves(correct: DataFrame, panels: DataFrame, a: str, b: str, n_pairs: int, reps: int, level: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Per k the difference of ``a`` and ``b`` with pointwise and simultaneous bounds, and the replicates' differences.

    First: ``k, acc_a, acc_b, delta, lo, hi, se, lo_simul, hi_simul, spread_lo, spread_hi, p_subset_a_wins``; the
    simultaneous band is wide enough for the largest standardised deviation over all k. Second: ``rep, k, d``.
    """
    tail = (1 - level) / 2
    two = lambda df, v: df.groupBy(*[c for c in df.columns if c not in ("arm", v)]).pivot("arm", [a, b]).agg(F.first(v))
    d = two(resampled(correct, panels, n_pairs, reps), "acc").select("rep", "k", (F.col(a) - F.col(b)).alias("d"))
    point = two(correct.groupBy("arm", "k").agg(F.avg("ok").alias("acc")), "acc").select("k", F.col(a).alias("acc_a"), F.col(b).alias("acc_b"), (F.col(a) - F.col(b)).alias("delta"))
    bounds = d.groupBy("k").agg(F.percentile("d", F.lit(tail)).alias("lo"), F.percentile("d", F.lit(1 - tail)).alias("hi"), F.stddev_samp("d").alias("se"))
    by_k = point.join(bounds, "k")
    far = d.join(F.broadcast(by_k.select("k", "delta", "se")), "k").groupBy("rep").agg(F.max(F.when(F.col("se") > 0, F.abs(F.col("d") - F.col("delta")) / F.col("se"))).alias("t"))
    q = far.agg(F.coalesce(F.percentile("t", F.lit(level)), F.lit(0.0)).alias("q"))
    subset = correct.groupBy("arm", "k", "subset").agg(F.avg("ok").alias("acc"))
    side = lambda arm, n: subset.filter(F.col("arm") == arm).select("k", F.col("acc").alias(n))
    gap = side(a, "x").join(side(b, "y"), "k").select("k", (F.col("x") - F.col("y")).alias("g"))
    spread = gap.groupBy("k").agg(F.percentile("g", F.lit(0.1)).alias("spread_lo"), F.percentile("g", F.lit(0.9)).alias("spread_hi"), F.avg(F.when(F.col("g") > 0, 1.0).when(F.col("g") == 0, 0.5).otherwise(0.0)).alias("p_subset_a_wins"))
    out = by_k.join(spread, "k").join(F.broadcast(q), how="left", on=F.lit(True))
    return out.withColumns({"lo_simul": F.col("delta") - F.col("q") * F.col("se"), "hi_simul": F.col("delta") + F.col("q") * F.col("se")}).drop("q"), d


def summary(by_k: DataFrame, d: DataFrame, level: float = 0.95) -> DataFrame:
    """The mean difference over k with its bounds, and a two-sided p value from replicates centred on it."""
    tail = (1 - level) / 2
    est = by_k.agg(F.avg("delta").alias("estimate"))
    rep = d.groupBy("rep").agg(F.avg("d").alias("m")).join(F.broadcast(est), how="left", on=F.lit(True))
    beyond = F.when(F.abs(F.col("m") - F.col("estimate")) >= F.abs("estimate") - 1e-12, 1.0).otherwise(0.0)
    return rep.agg(F.first("estimate").alias("estimate"), F.percentile("m", F.lit(tail)).alias("lo"), F.percentile("m", F.lit(1 - tail)).alias("hi"), F.stddev_samp("m").alias("se"), F.avg(beyond).alias("p"), F.count("*").alias("n_boot"))
