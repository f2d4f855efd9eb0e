"""Comparison graphs: balanced pairs, degrees, Laplacian entries, budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import md5_number
from ..sources.shared import written
from .components import connected_components
from .order import numbered


def circle_pairs(spark: SparkSession, n: int, rounds: int, first_round: int = 0) -> DataFrame:
    """``pair_index, round, a, b`` of perfect matchings over node numbers 0 to n - 1 by the circle method.

    Every node has degree ``rounds``; no pair repeats, none is a loop, and from two rounds on all nodes are connected.
    Pairs come from arithmetic on their number alone, so nothing is joined or shuffled.
    """
    if n % 2 or n < 2 or rounds > n - 1:
        raise ValueError("an even number of nodes and fewer rounds than nodes are needed")
    half, m = n // 2, n - 1
    r, k = F.expr(f"id div {half}") + first_round, F.col("id") % half
    a = (r + k) % m
    b = F.when(k == 0, F.lit(m)).otherwise((r - k + m) % m)
    return spark.range(half * rounds).select(F.col("id").alias("pair_index"), r.cast("int").alias("round"), a.cast("long").alias("a"), b.cast("long").alias("b"))


def numbered_pairs(df: DataFrame, number: str, n: int) -> DataFrame:
    """``df`` with ``a, b``, the pair of nodes below ``n`` that ``number`` stands for: (0, 1), (0, 2), ... (n - 2, n - 1)."""
    k = F.col(number)
    a = F.floor((2 * n - 1 - F.sqrt(F.lit(float((2 * n - 1) ** 2)) - 8 * k)) / 2).cast("long")
    return df.withColumn("a", a).withColumn("b", (k - F.expr(f"a * (2 * {n} - a - 1) div 2") + F.col("a") + 1).cast("long"))


def shown_first(a: Column, b: Column) -> Column:
    """True if the first of two ids takes slot A: parity of a hash of both."""
    return md5_number(F.concat_ws(":", a.cast("string"), b.cast("string"))) % 2 == 0


def degrees(pairs: DataFrame, a: str = "a", b: str = "b", by: tuple[str, ...] = ()) -> DataFrame:
    ends = pairs.select(*by, F.explode(F.array(a, b)).alias("node"))
    return ends.groupBy(*by, "node").agg(F.count("*").alias("degree"))


def laplacian(edges: DataFrame, a: str = "a", b: str = "b", weight: str = "w", by: tuple[str, ...] = ()) -> DataFrame:
    """Entries ``i, j, value`` of the weighted Laplacian; four signed rows per edge, added up where they meet."""
    w = F.col(weight)
    four = F.array(*[F.struct(F.col(i).alias("i"), F.col(j).alias("j"), v.alias("value")) for i, j, v in ((a, a, w), (b, b, w), (a, b, -w), (b, a, -w))])
    return edges.select(*by, F.explode(four).alias("e")).select(*by, "e.*").groupBy(*by, "i", "j").agg(F.sum("value").alias("value"))


def budget_report(pairs: DataFrame, n: int, budgets: list[int], gap: str) -> DataFrame:
    """Diagnostics of the first so many pairs for each budget: degrees, components, mean gap."""
    inside = [pairs.filter(F.col("pair_index") < b).withColumn("budget", F.lit(b)) for b in budgets]
    out = []
    for b, part in zip(budgets, inside, strict=True):
        d = degrees(part).agg(F.min("degree").alias("least"), F.max("degree").alias("most"), F.count("*").alias("touched"))
        roots = connected_components(part.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        c = roots.agg(F.countDistinct("component").alias("joined"))
        g = part.agg(F.count("*").alias("n_pairs"), F.avg(gap).alias("mean_gap"))
        row = d.crossJoin(c).crossJoin(g)  # three single rows
        out.append(
            row.select(
                F.lit(b).cast("long").alias("budget"),
                "n_pairs",
                F.when(F.col("touched") < n, 0).otherwise(F.col("least")).cast("long").alias("degree_min"),
                F.col("most").alias("degree_max"),
                (2.0 * F.col("n_pairs") / n).alias("degree_mean"),
                (F.col("joined") + n - F.col("touched")).alias("components"),
                "mean_gap",
            )
        )
    return reduce(DataFrame.unionByName, out)


def faults(pairs: DataFrame) -> DataFrame:
    """Loops and repeated pairs: ``lo, hi, n`` of each."""
    both = pairs.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    return both.groupBy("lo", "hi").agg(F.count("*").alias("n")).filter("n > 1 or lo = hi")


def without(pairs: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Pairs that are not among the ``forbidden`` edges, in either direction."""
    f = forbidden.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    keyed = pairs.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
    return keyed.join(f, ["lo", "hi"], "left_anti").drop("lo", "hi")


def _edge(x, y) -> Column:
    return F.array_sort(F.array(x, y))


def _partners(bad: DataFrame, now: DataFrame, seed: str, step: int, proposals: int) -> DataFrame:
    """Some pairs c-d (``other``) of the same round for each pair a-b of ``bad``, by hash."""
    per_round = now.groupBy("round").agg(F.min("pair_index").alias("from"), F.count("*").alias("n"))
    t = bad.join(F.broadcast(per_round), "round").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(proposals - 1))))
    h = md5_number(F.concat_ws(":", F.lit(seed), F.lit(str(step)), F.col("pair_index").cast("string"), F.col("t").cast("string")))
    t = t.select("pair_index", "a", "b", "t", (F.col("from") + h % F.col("n")).alias("other"))
    met = t.join(now.select(F.col("pair_index").alias("other"), F.col("a").alias("c"), F.col("b").alias("d")), "other").filter("pair_index <> other")
    return met.withColumns({"e1": _edge("a", "c"), "e2": _edge("b", "d"), "id": F.xxhash64("pair_index", "t")})


def _swapped(now: DataFrame, proposals: DataFrame, closed: DataFrame) -> tuple[DataFrame, int]:
    """``now`` after swaps: pairs a-b and c-d of a round become a-c and b-d. And how many swaps there were.

    ``proposals`` have ``id, pair_index, other, a, b, c, d, e1, e2``. Those whose new edges are ``closed`` or there
    already fall away; of the others each pair and each new edge takes part in one at most, the one with the least id
    at all four.
    """
    taken = closed.select("e").unionByName(now.select(_edge("a", "b").alias("e")))
    for e in ("e1", "e2"):
        proposals = proposals.join(taken.withColumnRenamed("e", e), e, "left_anti")
    met = written(proposals.filter("a <> c and b <> d and e1 <> e2"), "proposals")
    ends = met.select("id", F.explode(F.array(F.array("pair_index"), F.array("other"), "e1", "e2")).alias("at"))
    first = ends.groupBy("at").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    won = ends.join(first, ["at", "id"]).groupBy("id").agg(F.count("*").alias("n")).filter("n = 4").select("id")
    won = written(met.join(won, "id"), "swaps")
    new = won.select("pair_index", "a", F.col("c").alias("b")).unionByName(won.select(F.col("other").alias("pair_index"), F.col("b").alias("a"), F.col("d").alias("b")))
    new = new.withColumnsRenamed({"a": "x", "b": "y"})
    out = now.join(new, "pair_index", "left").select("pair_index", "round", F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    return written(out, "swapped"), won.count()


def avoiding(pairs: DataFrame, forbidden: DataFrame, seed: str = "swap", proposals: int = 8, max_steps: int = 60) -> DataFrame:
    """``pairs`` (``pair_index, round, a, b``: perfect matchings) without ``forbidden`` edges, all degrees as they were.

    A forbidden pair a-b swaps partners with another pair c-d of its round to a-c and b-d. In a step every such pair
    proposes some pairs by hash at once (see ``_swapped``). Only forbidden pairs and their proposals are joined with the
    graph, and steps go on until none is left.
    """
    barred = written(forbidden.select(_edge("a", "b").alias("e")).distinct(), "barred")
    now = written(pairs.select("pair_index", "round", "a", "b"), "swapped")
    for step in range(max_steps):
        bad = written(now.withColumn("e", _edge("a", "b")).join(barred, "e", "left_semi").drop("e"), "bad")
        if not bad.limit(1).count():
            return now
        met = _partners(bad, now, seed, step, proposals).join(bad.select(F.col("pair_index").alias("other")), "other", "left_anti")
        now, _ = _swapped(now, met, barred)
    raise RuntimeError(f"forbidden edges are left after {max_steps} steps")


def preferring(pairs: DataFrame, preferred: DataFrame, idle: int = 3, max_steps: int = 60) -> DataFrame:
    """``pairs`` (perfect matchings by round) with as many ``preferred`` edges (``a, b``) in them as swaps can bring in.

    A preferred edge x-y that is not there yet picks a round by hash, where x is paired with p and y with q; the pairs
    become x-y and p-q, unless one of them was a preferred edge itself. Steps end when all are in or ``idle`` of them in
    turn brought none.
    """
    wanted = written(preferred.filter("a <> b").select(_edge("a", "b").alias("e")).distinct(), "preferred")
    now = written(pairs.select("pair_index", "round", "a", "b"), "swapped")
    rounds = now.agg(F.max("round")).first()[0]
    without_luck = 0
    for step in range(max_steps):
        there = now.withColumn("e", _edge("a", "b"))
        free = there.join(wanted, "e", "left_anti").drop("e")
        missing = written(wanted.join(there.select("e"), "e", "left_anti"), "missing")
        if without_luck == idle or not missing.limit(1).count():
            break
        at = F.pmod(F.xxhash64(F.lit(step), "e"), F.lit(rounds + 1)).cast("int").alias("round")
        ends = free.select("round", "pair_index", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("p")), F.struct(F.col("b").alias("x"), F.col("a").alias("p")))).alias("s")).select("round", "pair_index", "s.*")
        ask = missing.select("e", at, F.get("e", F.lit(0)).alias("x"), F.get("e", F.lit(1)).alias("y"))
        met = ask.join(ends, ["round", "x"]).withColumnsRenamed({"pair_index": "i", "p": "px"})
        met = met.join(ends.withColumnsRenamed({"x": "y", "pair_index": "other", "p": "py"}), ["round", "y"]).filter("i <> other")
        met = met.select(F.xxhash64("e", F.lit(step)).alias("id"), F.col("i").alias("pair_index"), "other", F.col("x").alias("a"), F.col("px").alias("b"), F.col("y").alias("c"), F.col("py").alias("d"))
        now, n = _swapped(now, met.withColumns({"e1": _edge("a", "c"), "e2": _edge("b", "d")}), wanted.filter("false"))
        without_luck = 0 if n else without_luck + 1
    return now


def across_bands(pairs: DataFrame, bands: DataFrame, bias: float, preferred: DataFrame | None = None, seed: str = "band", proposals: int = 8, idle: int = 3, max_steps: int = 60) -> DataFrame:
    """``pairs`` (perfect matchings by round) of which a share ``bias`` of those within a band is led across bands.

    ``bands`` has ``node, band``. A pair within a band whose hash is below ``bias`` swaps partners with a pair of its
    round so that both new pairs are across bands, or one is where the other pair was within a band too. Pairs of
    ``preferred`` edges stay. Steps end when none is left to lead or ``idle`` of them in turn led none across, as where
    one band holds more than half of the nodes.
    """
    of = lambda name: bands.select(F.col("node").alias(name), F.col("band").alias(f"band_{name}"))
    kept = (preferred if preferred is not None else pairs.filter("false")).select(_edge("a", "b").alias("e")).distinct()
    now = written(pairs.select("pair_index", "round", "a", "b"), "swapped")
    without_luck = 0
    for step in range(max_steps):
        placed = now.join(of("a"), "a").join(of("b"), "b").withColumn("e", _edge("a", "b")).join(kept, "e", "left_anti").drop("e")
        chosen = md5_number(F.concat_ws(":", F.lit(seed), F.col("pair_index").cast("string"))) < bias * 2.0**32
        bad = written(placed.filter(F.col("band_a").eqNullSafe(F.col("band_b")) & chosen).select("pair_index", "round", "a", "b"), "within")
        if without_luck == idle or not bad.limit(1).count():
            break
        met = _partners(bad, now, seed, step, proposals).join(placed.select(F.col("pair_index").alias("other")), "other", "left_semi")
        for c in "abcd":
            met = met.join(of(c), c)
        differ = lambda x, y: (~F.col(f"band_{x}").eqNullSafe(F.col(f"band_{y}"))).cast("int")
        met = met.filter(differ("a", "c") + differ("b", "d") > differ("c", "d"))
        now, n = _swapped(now, met, kept)
        without_luck = 0 if n else without_luck + 1
    return now


def nested_pairs(items: DataFrame, rounds: int, bias: float = 0.0, preferred: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """Nested rounds of perfect matchings: ``pair_index, round, a, b, shown_first, band_a, band_b, score_gap``.

    ``items`` has ``node, band`` (a number) and an even number of rows. A random order of the nodes is matched by the
    circle method; then preferred edges are brought in and pairs led across bands. The first so many rounds are a
    regular graph of that degree; no pair repeats. ``shown_first`` is the node in slot A, by a second seed.
    """
    placed = written(numbered(items.select("node", "band", F.xxhash64(F.lit(seed), "node").alias("h")), ["h", "node"], "i"), "placed")
    circle = circle_pairs(items.sparkSession, placed.count(), rounds)
    at = lambda name: placed.select(F.col("i").alias(name), F.col("node").alias(f"{name}_node"))
    now = circle.join(at("a"), "a").join(at("b"), "b").select("pair_index", "round", F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    if preferred is not None:
        now = preferring(now, preferred)
    if bias > 0:
        now = across_bands(now, items.select("node", "band"), bias, preferred, seed=str(seed))
    side = lambda name: items.select(F.col("node").alias(name), F.col("band").alias(f"band_{name}"))
    front = F.pmod(F.xxhash64(F.lit(seed + 1), "pair_index"), F.lit(2)) == 0
    out = now.join(side("a"), "a").join(side("b"), "b")
    return out.select("pair_index", "round", "a", "b", F.when(front, F.col("a")).otherwise(F.col("b")).alias("shown_first"), "band_a", "band_b", F.abs(F.col("band_a") - F.col("band_b")).alias("score_gap"))


def same_group_edges(items: DataFrame, group: str, item: str) -> DataFrame:
    """The edge between the two items of each group of exactly two."""
    g = items.groupBy(group).agg(F.count("*").alias("n"), F.min(item).alias("a"), F.max(item).alias("b"))
    return g.filter("n = 2").select(group, "a", "b")
