"""Statistics of paired data as aggregates and small expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import guarded_corr, md5_number
from ..sources.shared import written
from .order import average_ranks, numbered
from .skew import hot_safe_join


def sign_test(n_win: Column, n_loss: Column) -> Column:
    """Exact two-sided p value of wins against losses at one half, by a running sum of log terms."""
    n, k = (n_win + n_loss).cast("double"), F.least(n_win, n_loss).cast("int")
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.lit(0.0).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        return F.struct((acc["term"] + F.log(n - i) - F.log(i + 1.0)).alias("term"), (acc["total"] + F.exp(acc["term"])).alias("total"))

    # the step at i adds the term of i and moves on; n - i is positive for every i up to k <= n / 2
    tail = F.aggregate(F.sequence(F.lit(0), k), start, step, lambda acc: acc["total"])
    return F.when(n == 0, 1.0).when(n_win == n_loss, 1.0).otherwise(F.least(F.lit(1.0), 2.0 * tail))


def step_up(p: str, by: tuple[str, ...] = ()) -> Column:
    """Benjamini-Hochberg q value of ``p`` over the rows of a small panel (one row per test)."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(p))
    m = F.count("*").over(W.partitionBy(*by))
    return F.struct(rank.alias("rank"), m.alias("m"))


def with_q(tests: DataFrame, p: str = "p") -> DataFrame:
    r = tests.withColumn("__r", step_up(p))
    raw = F.col(p) * F.col("__r.m") / F.col("__r.rank")
    low = F.min(raw).over(W.partitionBy().orderBy(F.desc("__r.rank")).rowsBetween(W.unboundedPreceding, 0))
    return r.withColumn("q", F.least(F.lit(1.0), F.greatest(F.lit(0.0), low))).drop("__r")


def win_rates(diffs: DataFrame) -> DataFrame:
    """Per ``feature`` of ``feature, d``: win rate with ties split, Wald interval, exact sign test and its q value."""
    d = diffs.filter(F.col("d").isNotNull() & ~F.isnan(F.col("d").cast("double")))
    c = d.groupBy("feature").agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("n_win"), F.count_if(F.col("d") < 0).alias("n_loss"))
    c = c.withColumn("n_tie", F.col("n") - F.col("n_win") - F.col("n_loss")).withColumn("win_rate", (F.col("n_win") + 0.5 * F.col("n_tie")) / F.col("n"))
    se = F.sqrt(F.col("win_rate") * (1 - F.col("win_rate")) / F.col("n"))
    c = c.withColumns({"lo": F.col("win_rate") - 1.96 * se, "hi": F.col("win_rate") + 1.96 * se, "p": sign_test(F.col("n_win"), F.col("n_loss"))})
    return with_q(c)


def sign_deck(units: DataFrame, key: str, by: tuple[str, ...] = (), seed: str = "42") -> DataFrame:
    """A balanced +1/-1 sign per unit within ``by``, in the order of a seeded hash; an odd one out gets -1."""
    h = md5_number(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    if not by:
        placed = numbered(units.withColumn("__h", h), ["__h", key], "__rank")
        return placed.withColumn("sign", F.when(F.col("__rank") < units.count() // 2, 1).otherwise(-1)).drop("__h", "__rank")
    w = W.partitionBy(*by)
    rank, n = F.row_number().over(w.orderBy(h, key)), F.count("*").over(w)
    return units.withColumn("sign", F.when(rank <= F.floor(n / 2), 1).otherwise(-1))


def correlations(left: DataFrame, right: DataFrame, item: str = "item") -> DataFrame:
    """Pearson correlations of long tables ``item, f, x`` and ``item, g, y``: ``f, g, r``; 0 where a side is constant."""
    return left.join(right, item).groupBy("f", "g").agg(guarded_corr(F.col("x"), F.col("y")).alias("r"))


def ranked(long: DataFrame, name: str, value: str) -> DataFrame:
    """Values replaced by their average ranks within each ``name``: Pearson on these is Spearman."""
    at = written(average_ranks(long, [name], value), "ranked")
    return hot_safe_join(long, at, [name, value], "n", long.count(), "inner").drop(value).withColumnRenamed("rank", value)


def effective_rank(r: DataFrame) -> DataFrame:
    """Participation ratio of a correlation matrix ``f, g, r`` without an eigensolver: (trace)^2 over the sum of squares."""
    return r.agg((F.pow(F.countDistinct("f").cast("double"), F.lit(2.0)) / F.sum(F.col("r") * F.col("r"))).alias("effective_rank"))


def replicate_index(df: DataFrame, n: int, reps: int, seed: str = "0") -> DataFrame:
    """``rep, pos, i``: resamples with replacement of 0 to n - 1 by a hash, the same for every arm that joins them."""
    ids = df.sparkSession.range(n * reps).select(F.expr(f"id div {n}").alias("rep"), (F.col("id") % n).alias("pos"))
    return ids.withColumn("i", md5_number(F.concat_ws(":", F.lit(seed), F.col("rep").cast("string"), F.col("pos").cast("string"))) % n)


def mcnemar(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """Counts of rows that only ``a`` or only ``b`` gets right, and the exact p value."""
    ra, rb = F.col(a) == F.col(y), F.col(b) == F.col(y)
    c = df.agg(F.count_if(ra & ~rb).alias("only_a"), F.count_if(rb & ~ra).alias("only_b"), F.avg(ra.cast("double")).alias("acc_a"), F.avg(rb.cast("double")).alias("acc_b"))
    return c.withColumn("p", sign_test(F.col("only_a"), F.col("only_b")))
