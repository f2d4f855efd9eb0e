"""Panels of scores: anchors fitted among themselves, then tests scored against the anchors' frozen scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import written
from .choice import fit_bradley_terry, frozen_score
from .order import numbered


def score_tests(tests: DataFrame, anchors: DataFrame, by: list[str], ridge: float = 1e-3, steps: int = 30) -> DataFrame:
    """``*by, feature, item, score, n`` of test items that have a comparison.

    ``tests`` are comparisons ``*by, pair_index, feature, item, anchor, sign, w`` (sign 1: the item was shown first; w 1:
    the side shown first won); ``anchors`` are scores ``*by, feature, item, score, beta``. Both meet in a left join by
    anchor and feature. Against an anchor without a score nothing can be said, so an item's score is then null.
    """
    known = anchors.select(*by, "feature", F.col("item").alias("anchor"), F.col("score").alias("s"), "beta")
    met = tests.join(known, [*by, "feature", "anchor"], "left")
    q = F.struct(F.col("sign").cast("double").alias("sign"), (F.col("beta") - F.col("sign") * F.col("s")).alias("c"), F.col("w").cast("double").alias("w"))
    one = met.groupBy(*by, "feature", "item").agg(F.array_sort(F.collect_list(F.struct("pair_index", q.alias("q")))).alias("l"), F.count("*").alias("n"), F.count("s").alias("n_known"))
    score = frozen_score(F.transform("l", lambda x: x["q"]), ridge, steps)
    return one.select(*by, "feature", "item", F.when(F.col("n") == F.col("n_known"), score).alias("score"), "n")


def fit_panel(judgments: DataFrame, items: DataFrame, by: list[str], ridge: float = 1e-3) -> DataFrame:
    """``*by, feature, item, split, score, beta``: a panel of all items and features for every ``by``.

    ``judgments`` has ``*by, pair_index, feature, first, other, w`` (w 1: the side shown first won) and ``items`` has
    ``item, split`` (train or test). Comparisons among training items fit their scores and a position term a feature
    (Bradley-Terry, one small system a feature); those of a test item with a training item score the test item against
    them. Comparisons of two test items are not used. A test item without comparisons in a feature has a null score; so
    has a training item.
    """
    side = lambda name: items.select(F.col("item").alias(name), F.col("split").alias(f"{name}_split"))
    j = judgments.join(side("first"), "first").join(side("other"), "other")
    among = j.filter("first_split = 'train' and other_split = 'train'")
    anchors = written(fit_bradley_terry(among.select(*by, "feature", F.col("first").alias("a"), F.col("other").alias("b"), "w"), [*by, "feature"], ridge), "panel-anchors")
    front = F.col("first_split") == "test"
    tests = j.filter("first_split <> other_split").select(
        *by, "pair_index", "feature", F.when(front, F.col("first")).otherwise(F.col("other")).alias("item"),
        F.when(front, F.col("other")).otherwise(F.col("first")).alias("anchor"), F.when(front, 1.0).otherwise(-1.0).alias("sign"), "w",
    )
    found = anchors.select(*by, "feature", "item", "score").unionByName(score_tests(tests, anchors, by, ridge).drop("n"))
    terms = anchors.select(*by, "feature", "beta").distinct()
    grid = terms.join(F.broadcast(items.select("item", "split")) if not by else items.select("item", "split"))  # every item and feature
    return grid.join(found, [*by, "feature", "item"], "left").select(*by, "feature", "item", "split", "score", "beta")


def halves(judgments: DataFrame, items: DataFrame, by: list[str], seed: int = 0) -> DataFrame:
    """``judgments`` with a column ``half`` (0 or 1).

    All features of a comparison go together. Comparisons of two training items are halved as a whole, those of a test
    item within the item; of an odd number the second half has one more.
    """
    side = lambda name: items.select(F.col("item").alias(name), F.col("split").alias(f"{name}_split"))
    pairs = judgments.select(*by, "pair_index", "first", "other").distinct().join(side("first"), "first").join(side("other"), "other")
    draw = F.xxhash64(F.lit(seed), *by, "pair_index")
    among = pairs.filter("first_split = 'train' and other_split = 'train'").select(*by, "pair_index", draw.alias("draw"))
    placed = numbered(among, [*by, "draw", "pair_index"], "i")
    size = placed.groupBy(*by).agg(F.min("i").alias("from"), F.count("*").alias("n")) if by else placed.agg(F.min("i").alias("from"), F.count("*").alias("n"))
    placed = placed.join(F.broadcast(size)) if not by else placed.join(size, by)
    half = lambda i, n: F.when(i < F.floor(n / 2), 0).otherwise(1).alias("half")
    anchors = placed.select(*by, "pair_index", half(F.col("i") - F.col("from"), F.col("n")))
    item = F.when(F.col("first_split") == "test", F.col("first")).otherwise(F.col("other"))
    tests = pairs.filter("first_split <> other_split").select(*by, "pair_index", item.alias("item"), draw.alias("draw"))
    own = W.partitionBy(*by, "item")  # an item's comparisons, a few dozen by design
    tests = tests.withColumns({"i": F.row_number().over(own.orderBy("draw", "pair_index")) - 1, "n": F.count("*").over(own)}).select(*by, "pair_index", half(F.col("i"), F.col("n")))
    return judgments.join(anchors.unionByName(tests), [*by, "pair_index"])


def half_reliability(panels: DataFrame, by: list[str]) -> DataFrame:
    """``*by, feature, n, r, stepped_up`` from panels with a column ``half``: how test scores of both halves agree."""
    both = panels.filter("split = 'test' and score is not null")
    a, b = (both.filter(F.col("half") == h).select(*by, "feature", "item", F.col("score").alias(f"s{h}")) for h in (0, 1))
    both_sd = F.stddev_pop("s0") * F.stddev_pop("s1")
    r = a.join(b, [*by, "feature", "item"]).groupBy(*by, "feature").agg(F.count("*").alias("n"), (F.covar_pop("s0", "s1") / F.when(both_sd != 0, both_sd)).alias("r"))
    return r.withColumn("stepped_up", 2 * F.col("r") / (1 + F.col("r")))
