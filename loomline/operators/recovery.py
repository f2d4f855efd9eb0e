"""How well features recover known dials: tracking, semantic matches, attribution, leakage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import kernels

#: Least cosine of a match, least correlation that counts as tracking.
THETA, TAU = 0.406, 0.4


def matched(cosines: DataFrame, by: list[str]) -> DataFrame:
    """Dials matched to features at the largest total cosine, per group: ``by, g, f, cos``.

    ``cosines``: ``by, f, g, cos``, a small matrix per group (a panel's features by some dozens of dials), solved in
    one task each.
    """
    kinds = ", ".join(f"{c} {cosines.schema[c].dataType.simpleString()}" for c in by)

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="g", columns="f", values="cos").sort_index().sort_index(axis=1)
        pairs = kernels.assignment(-m.to_numpy())
        head = {c: [pdf[c].iloc[0]] * len(pairs) for c in by}
        return pd.DataFrame({**head, "g": [m.index[i] for i, _ in pairs], "f": [m.columns[j] for _, j in pairs], "cos": [float(m.iloc[i, j]) for i, j in pairs]})

    return cosines.groupBy(*by).applyInPandas(match, f"{kinds}, g string, f string, cos double")


def rejected_quantile(cosines: DataFrame, by: list[str], q: float = 0.95) -> DataFrame:
    """The quantile of the cosines that no group's matching uses, pooled over groups: ``theta, n``."""
    rest = cosines.join(matched(cosines, by).select(*by, "g", "f"), [*by, "g", "f"], "left_anti")
    return rest.agg(F.percentile("cos", F.lit(q)).alias("theta"), F.count("*").alias("n"))


def scorecard(r: DataFrame, matches: DataFrame, taus: list[float], theta: float = THETA) -> DataFrame:
    """One row per threshold of ``taus``: ``tau, k, n_tracked, sf, sm, sr, af, lk``.

    ``r``: ``f, g, r`` for every feature and dial; ``matches``: ``g, f, cos``. ``sf`` is the share of dials that some
    feature follows beyond tau, ``sm`` their mean best correlation, ``sr`` the share whose match has a cosine of theta
    and follows them beyond tau, ``af`` the share of features that follow one dial that holds over half of their
    squared correlations, ``lk`` the mean correlation of these with dials that they are not the best follower of, by
    dial and then over dials (null where there is none).
    """
    taus_of = F.explode(F.array(*map(F.lit, taus))).alias("tau")
    a = r.select("f", "g", F.abs("r").alias("a"))
    dial = a.groupBy("g").agg(F.max("a").alias("top"), F.min_by("f", F.struct((-F.col("a")).alias("a"), "f")).alias("tracker"))
    feature = a.groupBy("f").agg(F.max("a").alias("top"), F.sum(F.col("a") * F.col("a")).alias("ss"))
    alone = F.coalesce((F.col("top") > F.col("tau")) & (F.col("top") * F.col("top") / F.when(F.col("ss") > 0, F.col("ss")) > 0.5), F.lit(False))
    share = lambda c: F.avg(c.cast("double"))
    met = dial.join(matches.select("g", F.col("f").alias("m_f"), "cos"), "g", "left").join(a.select("g", F.col("f").alias("m_f"), F.col("a").alias("m_a")), ["g", "m_f"], "left")
    by_dial = met.select("*", taus_of)
    hit = F.coalesce((F.col("cos") >= theta) & (F.col("m_a") > F.col("tau")), F.lit(False))
    one = by_dial.groupBy("tau").agg(F.count_if(F.col("top") > F.col("tau")).alias("n_tracked"), share(F.col("top") > F.col("tau")).alias("sf"), F.avg("top").alias("sm"), share(hit).alias("sr"))
    attr = feature.select("*", taus_of).withColumn("alone", alone)
    two = attr.groupBy("tau").agg(F.count("*").alias("k"), share(F.col("alone")).alias("af"))
    off = a.join(dial.select("g", "tracker"), "g").filter("f <> tracker").join(attr.filter("alone").select("f", "tau"), "f")
    three = off.groupBy("tau", "g").agg(F.avg("a").alias("lk")).groupBy("tau").agg(F.avg("lk").alias("lk"))
    return one.join(two, "tau").join(three, "tau", "left").select("tau", "k", "n_tracked", "sf", "sm", "sr", "af", "lk")


def permutation_floor(features: DataFrame, dials: DataFrame, reps: int, seed: str = "perm") -> DataFrame:
    """What correlations of shuffled dials reach: mean and 95th percentile of each dial's best, over all replicates.

    ``features``: ``i, f, x``; ``dials``: ``i, g, y`` with item numbers from 0. A replicate orders items by a hash; an
    item meets the dials of the item at its place. Ranks within a replicate come from one sort per replicate.
    """
    from ..functions.numeric import guarded_corr, md5_number

    ids = dials.select("i").distinct().select("i", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    h = md5_number(F.concat_ws(":", F.lit(seed), F.col("rep").cast("string"), F.col("i").cast("string")))
    place = ids.withColumn("to", F.row_number().over(W.partitionBy("rep").orderBy(h, "i")) - 1)
    shuffled = dials.join(place, "i").select("rep", F.col("to").cast("long").alias("i"), "g", "y")
    r = features.join(shuffled, "i").groupBy("rep", "f", "g").agg(guarded_corr(F.col("x"), F.col("y")).alias("r"))
    top = r.groupBy("rep", "g").agg(F.max(F.abs("r")).alias("top"))
    return top.agg(F.avg("top").alias("mean_top"), F.percentile("top", F.lit(0.95)).alias("p95_top"), F.count("*").alias("n"))

