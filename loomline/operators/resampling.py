"""Replicates that rebuild everything from what they drew: rubric, tensor, scores and recovery, all replicates in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import guarded_corr
from .rationale import place


def drawn_pairs(pairs: DataFrame, draws: DataFrame, least: int = 20) -> DataFrame:
    """``rep, n_items`` and the columns of ``pairs`` (``pair_index, first, other``) of which a replicate drew both ends.

    ``draws`` has ``rep, item`` (distinct). Replicates that drew fewer than ``least`` items are skipped.
    """
    size = draws.groupBy("rep").agg(F.count("*").alias("n_items")).filter(F.col("n_items") >= least)
    end = lambda name: draws.select("rep", F.col("item").alias(name))
    return pairs.join(end("first"), "first").join(end("other"), ["rep", "other"]).join(size, "rep").select("rep", "n_items", *pairs.columns)


def own_rubrics(cites: DataFrame, pairs: DataFrame, members: DataFrame, least: int, n_pairs: int) -> DataFrame:
    """``rep, pair_index, criterion, winner_slot``: citations under the rubric that each replicate makes of its pairs.

    ``cites`` has ``pair_index, phrase_norm, winner_slot`` and ``pairs`` is ``drawn_pairs``. A phrase is kept if the
    replicate cites it at least ``least`` times, scaled by its share of all ``n_pairs`` pairs (once at least); kept
    phrases get the criterion of ``members`` (the last placement wins), others are criteria of their own.
    """
    size = pairs.groupBy("rep").agg(F.count("*").alias("size"))
    mine = cites.join(pairs.select("rep", "pair_index"), "pair_index")
    counted = mine.groupBy("rep", "phrase_norm").agg(F.count("*").alias("n")).join(size, "rep")
    kept = counted.filter(F.col("n") >= F.greatest(F.lit(1), F.ceil(least * F.col("size") / n_pairs)))
    named = kept.join(place(kept, members, "last", "self"), "phrase_norm").select("rep", "phrase_norm", "criterion")
    return mine.join(named, ["rep", "phrase_norm"]).select("rep", "pair_index", "criterion", "winner_slot")


def net_wins(rubric: DataFrame, pairs: DataFrame) -> DataFrame:
    """``rep, criterion, item, s``: the mean verdict on an item over its pairs that cite the criterion one way or the other."""
    x = F.signum(F.sum(F.when(F.col("winner_slot") == "A", 1).when(F.col("winner_slot") == "B", -1).otherwise(0)))
    tensor = rubric.groupBy("rep", "pair_index", "criterion").agg(x.alias("x")).filter("x <> 0")
    met = tensor.join(pairs.select("rep", "pair_index", "first", "other"), ["rep", "pair_index"])
    ends = F.explode(F.array(F.struct(F.col("first").alias("item"), F.col("x").alias("v")), F.struct(F.col("other").alias("item"), (-F.col("x")).alias("v")))).alias("e")
    return met.select("rep", "criterion", ends).groupBy("rep", "criterion", "e.item").agg(F.avg("e.v").alias("s"))


def recovery(scores: DataFrame, dials: DataFrame, tau: float) -> DataFrame:
    """``rep, n_criteria, n_dials, n_recovered, share, mean_top``: how well a replicate's scores follow known dials.

    ``scores`` has ``rep, criterion, item, s`` and ``dials`` ``item, g, y``. A dial is recovered if the largest
    correlation in size of any criterion with it is above ``tau``.
    """
    r = scores.join(dials, "item").groupBy("rep", "criterion", "g").agg(guarded_corr(F.col("s"), F.col("y")).alias("r"))
    top = r.groupBy("rep", "g").agg(F.max(F.abs("r")).alias("top"))
    n = r.groupBy("rep").agg(F.countDistinct("criterion").alias("n_criteria"))
    out = top.groupBy("rep").agg(F.count("*").alias("n_dials"), F.count_if(F.col("top") > tau).alias("n_recovered"), F.avg("top").alias("mean_top"))
    return out.join(n, "rep").select("rep", "n_criteria", "n_dials", "n_recovered", (F.col("n_recovered") / F.col("n_dials")).alias("share"), "mean_top")


def bands(stats: DataFrame, names: list[str], level: float = 0.95) -> DataFrame:
    """Mean and percentile bounds of each statistic over replicates: ``name, n, mean, lo, hi``; nulls and NaN are left out."""
    tail = (1 - level) / 2
    long = stats.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in names])).alias("e")).select("e.*")
    p = lambda q: F.percentile("v", F.lit(q))
    return long.filter("v is not null and not isnan(v)").groupBy("name").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), p(tail).alias("lo"), p(1 - tail).alias("hi"))
