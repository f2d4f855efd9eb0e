"""Score panels from several cells: which cell a criterion comes from, joins by item, and paired tests over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .stats import sign_test

#: Coefficients of a rational approximation of the normal quantile (relative error below 1e-15).
CENTRE = ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3), (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3))
MIDDLE = ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4), (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9))


def _ratio(x: str, of: tuple[tuple[float, ...], tuple[float, ...]]) -> str:
    up, down = (reduce(lambda acc, c: f"({acc} * {x} + {c!r}::double)", reversed(cs[:-1]), f"{cs[-1]!r}::double") for cs in of)
    return f"({up} / {down})"


def normal_upper(p: str) -> str:
    """SQL (of Spark and others) for the point that a standard normal exceeds with chance ``p``, for p from 1e-11 to 1 - 1e-11."""
    q = f"(0.5::double - ({p}))"
    tail = f"sqrt(-ln(least(({p}), 1.0::double - ({p}))))"
    outer = f"sign({q}) * {_ratio(f'({tail} - 1.6::double)', MIDDLE)}"
    return f"CASE WHEN abs({q}) <= 0.425::double THEN {q} * {_ratio(f'(0.180625::double - {q} * {q})', CENTRE)} ELSE {outer} END"


def pooled_panel(cells: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """One score per item and criterion from cells in order: ``item, criterion, v, cell``.

    ``cells``: ``cell`` (0 first), ``item, criterion, v``. The first cell has the panel's items; a later one adds the
    criteria that ``dropped`` (``cell, criterion``) names for it or, without such names, those no earlier cell has.
    """
    seen = cells.select("cell", "criterion").distinct()
    first = seen.groupBy("criterion").agg(F.min("cell").alias("cell"))
    if dropped is not None:
        named = dropped.join(seen, ["cell", "criterion"], "left_semi")
        own = seen.filter("cell = 0").join(named.select("criterion"), "criterion", "left_anti")
        free = first.join(dropped.select("cell").distinct(), "cell", "left_anti").join(named.select("criterion"), "criterion", "left_anti").filter("cell > 0")
        first = own.select("criterion", "cell").unionByName(named.select("criterion", "cell")).unionByName(free.select("criterion", "cell")).groupBy("criterion").agg(F.min("cell").alias("cell"))
    items = cells.filter("cell = 0").select("item").distinct()
    return cells.join(F.broadcast(first), ["criterion", "cell"]).join(items, "item", "left_semi").select("item", "criterion", "v", "cell")


def same_graph(cells: DataFrame) -> DataFrame:
    """``cells`` (with ``graph``), or an error if they number the items of more than one graph: such ids name different things."""
    graphs = [r.graph for r in cells.select("graph").distinct().limit(3).collect()]
    if len(graphs) > 1:
        raise ValueError(f"cells of different item graphs cannot be joined by item: {sorted(map(str, graphs))}")
    return cells


def length_reference(pairs: DataFrame, win: str, lose: str) -> DataFrame:
    """How often the longer side wins, ties split: ``n, rate``."""
    d = F.col(win) - F.col(lose)
    return pairs.agg(F.count(d).alias("n"), F.avg(F.when(d > 0, 1.0).when(d == 0, 0.5).when(d < 0, 0.0)).alias("rate"))


def chance_band(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Half-width around one half within which a win rate is no evidence: ``k_star, m, n, margin``.

    ``tests``: a panel's ``p`` and ``n``. ``k_star`` is the largest k whose k-th p value is at most ``alpha * k / m``; the
    margin is the displacement that meets that level, or that of one test in m where nothing is rejected.
    """
    r = tests.select("p", "n", F.row_number().over(W.orderBy("p")).alias("k"), F.count("*").over(W.partitionBy()).alias("m"))
    b = r.agg(F.max(F.when(F.col("p") <= alpha * F.col("k") / F.col("m"), F.col("k"))).alias("k_star"), F.max("m").alias("m"), F.max("n").alias("n"))
    level = f"({alpha}D * coalesce(k_star, 1) / (2.0D * m))"
    return b.withColumn("margin", F.expr(normal_upper(level)) * F.sqrt(0.25 / F.col("n")))


def against_band(tests: DataFrame, margin: Column, alpha: float = 0.05) -> DataFrame:
    """Criteria whose place outside or inside the band contradicts their own q value; none if the band is safe."""
    return tests.filter((F.abs(F.col("win_rate") - 0.5) > margin) != (F.col("q") < alpha))


def plain_win_rates(diffs: DataFrame) -> DataFrame:
    """Win rates of ``feature, d`` with ties counted as losses, in rate and test alike: ``feature, n, win_rate, p``."""
    c = diffs.groupBy("feature").agg(F.count("d").alias("n"), F.count_if(F.col("d") > 0).alias("n_win"))
    return c.select("feature", "n", (F.col("n_win") / F.col("n")).alias("win_rate"), sign_test(F.col("n_win"), F.col("n") - F.col("n_win")).alias("p"))


def probe(answers: DataFrame) -> DataFrame:
    """Accuracies of two framings by outcome and split, with a total: ``label, split, n, p1, p2, lift_pp``.

    ``answers``: ``unit, framing`` (p1 or p2), ``ok`` (0, 1 or null), ``label, split``.
    """
    wide = answers.groupBy("unit", "label", "split").pivot("framing", ["p1", "p2"]).agg(F.max("ok"))
    acc = [F.count("*").alias("n"), F.avg("p1").alias("p1"), F.avg("p2").alias("p2"), (100 * F.avg(F.col("p2") - F.col("p1"))).alias("lift_pp")]
    return wide.rollup("label", "split").agg(*acc)


def discordant(answers: DataFrame) -> DataFrame:
    """Units that only one framing gets right, and the exact p value: ``b`` (p2 only), ``c`` (p1 only), ``p``."""
    wide = answers.groupBy("unit").pivot("framing", ["p1", "p2"]).agg(F.max("ok"))
    c = wide.agg(F.count_if((F.col("p2") == 1) & (F.col("p1") == 0)).alias("b"), F.count_if((F.col("p2") == 0) & (F.col("p1") == 1)).alias("c"))
    return c.withColumn("p", sign_test(F.col("b"), F.col("c")))
