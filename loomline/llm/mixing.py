"""Mixing sources to target weights by fitting each source's budget with a subset sum over document lengths.

Every source gets whole epochs of all its documents and a rest below one epoch. For the rest, documents are counted
by exact length; an equal share of each length and the longest that still fit are a start, and a bounded knapsack over
reachable sums adds documents and gives others back until the budget is met. The documents of a length are then chosen
by a seeded hash, so reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.marks import marked
from ..operators.order import numbered
from ..operators.skew import hot_safe_join
from ..sources.shared import keyed, written

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of one source and length are dealt by hash to so many slots; only one slot of a length needs ranking.
SLOTS = 1024
#: Up to so many sources are broadcast.
FEW_SOURCES = 100_000
#: The knapsack starts with so many lengths and widens; a table of sums never has more than MOST_SUMS entries.
LENGTHS, MOST_SUMS = 8, 1 << 26
#: Where sums are too long for a table: sums of either half of the documents that may move, and how often others are tried.
HALF, TRIES = 1 << 20, 64


def source_key(source: Column) -> Column:
    """A name for each source, null among them."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def best_subset(items: list[tuple[int, int]], most: int) -> dict[int, int]:
    """Of ``items`` (length, number) a choice whose sum of lengths is the largest up to ``most``: a bounded knapsack.

    Bit s of ``reach`` is set if some choice of the items so far sums to s; ``first`` notes the step that did it.
    """
    mask, reach, steps = (1 << (most + 1)) - 1, 1, []
    first = np.full(most + 1, -1, np.int32)
    for n, free in items:
        power = 1
        while free > 0:
            k = min(power, free)
            new = (reach << (n * k)) & mask & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(most // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits)] = len(steps)
                steps.append((n, k))
                reach |= new
            free, power = free - k, power * 2
        if reach >> most & 1:
            break
    at, out = reach.bit_length() - 1, {}
    while at:
        n, k = steps[first[at]]
        out[n] = out.get(n, 0) + k
        at -= n * k
    return out


def half_sums(lengths: list[int], free: dict[int, int]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """All sums of up to ``free`` documents of the first of ``lengths``, as many as HALF allows, and what was used.

    The place of a sum tells its choice: digits in the bases of the numbers used.
    """
    sums, used = np.zeros(1, np.int64), []
    for n in lengths:
        k = min(free[n], HALF // len(sums) - 1)
        if k < 1:
            break
        sums = (sums[None, :] + n * np.arange(k + 1, dtype=np.int64)[:, None]).ravel()
        used.append((n, k))
    return sums, used


def choice_at(place: int, used: list[tuple[int, int]]) -> dict[int, int]:
    out = {}
    for n, k in used:
        place, out[n] = divmod(place, k + 1)
    return out


def met_in_the_middle(left: dict[int, int], taken: dict[int, int], rest: int) -> int:
    """Change ``taken`` so that the sum grows by up to ``rest``, as far as found; what is then left of ``rest``.

    The documents that may move fall in two halves with at most HALF sums each; of every sum of one half the best
    partner in the other is found by bisection. If both halves hold all documents the result is the best there is.
    Otherwise other documents are tried, in seeded order: with a million sums a half there are about 10^12 to choose
    from, so a budget that many documents can meet is met.
    """
    r, lengths = np.random.default_rng(5), sorted(left)
    for _ in range(TRIES):
        order = [lengths[i] for i in r.permutation(len(lengths))]
        a, used_a = half_sums(order, left)
        b, used_b = half_sums(order[len(used_a) :], left)
        moving = dict(used_a) | dict(used_b)
        # of a length with more documents than may move, those that stay are taken first
        stay = {n: max(0, taken[n] - k) for n, k in moving.items()}
        most = rest + sum(n * (taken[n] - stay[n]) for n in moving)
        by = np.argsort(b, kind="stable")
        at = np.searchsorted(b[by], most - a, side="right") - 1
        total = np.where(at >= 0, a + b[by][np.maximum(at, 0)], -1)
        best = int(np.argmax(total))
        if most - total[best] < rest:
            chosen = choice_at(best, used_a) | choice_at(int(by[at[best]]), used_b)
            for n in moving:
                taken[n] = stay[n] + chosen[n]
            rest = int(most - total[best])
        if not rest or all(moving.get(n) == c for n, c in left.items()):
            break
    return rest


def fit_budget(counts: dict[int, int], budget: int, most_sums: int = MOST_SUMS) -> dict[int, int]:
    """How many documents of each length to take so that the sum of lengths is the largest up to ``budget``.

    ``counts`` maps a length to its number of documents; lengths below 1 are never needed. An equal share of each
    length and the longest that still fit are a start. Then a bounded knapsack over the rest may add documents and give
    some back: at most q of a length for m of the lengths, with m and q doubled until the budget itself is reached or
    all documents were free to move. Where a table of sums would have more than ``most_sums`` entries, as with texts of
    millions of words, sums of two halves of the documents meet in the middle instead. So the sum is the best there is,
    unless the budget cannot be reached, a table would be too large, and there are more documents than the halves hold
    (about 40 of different lengths); then it is the best found.
    """
    left = {n: c for n, c in sorted(counts.items()) if n > 0 and c > 0}
    total = sum(n * c for n, c in left.items())
    if budget <= 0 or not left:
        return {}
    if budget >= total:
        return left
    unit = math.gcd(*left)
    left, budget, total = {n // unit: c for n, c in left.items()}, budget // unit, total // unit
    taken = {n: c * budget // total for n, c in left.items()}
    rest = budget - sum(n * k for n, k in taken.items())
    for n in reversed(left):
        k = min(left[n] - taken[n], rest // n)
        taken[n] += k
        rest -= n * k
    m, q = LENGTHS, 1
    while rest:
        chosen = list(left)[:m]
        back = {n: min(taken[n], q) for n in chosen}
        most = rest + sum(n * k for n, k in back.items())
        if most >= most_sums:
            met_in_the_middle(left, taken, rest)
            break
        items = [(n, back[n] + min(left[n] - taken[n], q)) for n in reversed(chosen)]
        better = best_subset(items, most)
        for n in chosen:
            taken[n] += better.get(n, 0) - back[n]
        rest = most - sum(n * k for n, k in better.items())
        if m >= len(left) and q >= max(left.values()):
            break
        m, q = 2 * m, 2 * q
    return {n * unit: k for n, k in taken.items() if k}


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``sizes`` (``source, source_size`` and more, a row per source) with a column ``target``.

    Sources by code point, null last, take ``weights`` in turn and share ``share`` of all sizes; a target stops at
    ``most`` times its source's size and the excess goes to the others by weight. Only sums reach the driver.
    """
    nth = F.col("place") % len(weights)
    s = numbered(sizes.withColumn("unknown", F.col("source").isNull()), ["unknown", "source"], "place")
    s = written(s.drop("unknown").withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (nth + 1).cast("int"))), "mix-sources").drop("place")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    budget, level = share * total, 0.0
    full = F.col("source_size") * most
    while True:
        over = full <= F.col("weight") * level
        fixed, free = s.agg(F.sum(F.when(over, full)), F.sum(F.when(~over, F.col("weight")))).first()
        if not free:
            break
        new = (budget - (fixed or 0.0)) / free
        if new <= level:
            break
        level = new
    return s.withColumn("target", F.least(full, F.col("weight") * level).cast("double")).drop("weight")


def _plan(rows: DataFrame, weights: tuple[float, ...], share: float, most: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (``doc_id, row_key, source, size``) with ``skey`` and ``more`` (one copy beyond whole epochs: 0 or 1);
    and per ``skey`` its ``source, source_size, target, epochs``."""
    # rows without an id would share one hash: their place in the table tells them apart
    light = rows.withColumn("pick", F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.col("row_key"))))
    light = light.withColumns({"slot": F.pmod("pick", F.lit(SLOTS)), "skey": source_key(F.col("source"))})
    slots = written(light.groupBy("skey", "size", "slot").agg(F.count("*").alias("n")), "mix-slots")
    lengths = slots.groupBy("skey", "size").agg(F.sum("n").alias("n"))
    sizes = lengths.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    source = F.when(F.col("skey") != "n", F.expr("substring(skey, 2)"))
    aims = targets(sizes.select("skey", source.alias("source"), "source_size"), weights, share, most)
    aims = written(aims.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") + 1e-9), F.lit(most))).otherwise(0).cast("long")), "mix-aims")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        budget = int(round(pdf["target"].iloc[0] - pdf["epochs"].iloc[0] * pdf["source_size"].iloc[0]))
        chosen = fit_budget(dict(zip(pdf["size"].tolist(), pdf["n"].tolist(), strict=True)), budget)
        return pd.DataFrame({"skey": pdf["skey"], "size": pdf["size"], "extra": [chosen.get(n, 0) for n in pdf["size"].tolist()]})

    # one row per source and length: bounded by the longest text, not by the number of documents
    extra = lengths.join(aims, "skey").groupBy("skey").applyInPandas(fit, "skey string, size long, extra long")
    extra = written(extra, "mix-lengths")
    run = W.partitionBy("skey", "size").orderBy("slot")
    need = slots.join(extra, ["skey", "size"]).withColumn("before", F.sum("n").over(run) - F.col("n"))
    need = need.select("skey", "size", "slot", "n", F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.col("before"))).alias("need"))
    need = written(need, "mix-need")
    total = light.count()
    dealt = hot_safe_join(light, need.withColumn("part", F.col("need").between(1, F.col("n") - 1)), ["skey", "size", "slot"], "n", total)
    plain = dealt.filter("not part").withColumn("more", (F.col("need") > 0).cast("long"))
    rank = F.row_number().over(W.partitionBy("skey", "size", "slot").orderBy("pick", "doc_id", "row_key"))
    ranked = dealt.filter("part").withColumn("more", (rank <= F.col("need")).cast("long"))
    return plain.unionByName(ranked).select("doc_id", "row_key", "skey", "size", "more"), aims


def _light(rows: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return written(rows.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.col("__row").alias("row_key")), "mix-light")


def _with_aims(rows: DataFrame, aims: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(aims) if aims.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES else aims, "skey")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: int = 3, seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, row_key, source, size, source_size, target, taken``.

    ``size`` is the number of words (null text: 0), ``taken`` the words that the mix takes of the document: 0 or a
    multiple of its size, ``most`` times at most. Each source's sum of ``taken`` is the largest up to its rounded
    target (see ``fit_budget``). A null source is a source of its own. Documents of one length tie: those with the
    smallest seeded hash of their id (of their place in the table, without an id), then id, then row are taken. Rows that repeat are chosen one by one. Other
    columns are not read. An empty table gives an empty result; texts without words take and are given nothing.
    """
    out, aims = _plan(_light(keyed(docs, "__row"), id_col, text_col, source_col), weights, share, most, seed)
    return _with_aims(out, aims).select("doc_id", "row_key", "source", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + F.col("more"))).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: int = 3, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with its columns and ``size``, ``taken`` and ``repeats`` (taken / size).

    Columns of ``docs`` with one of these three names give way to them. Texts are not shuffled.
    """
    key = "__row"
    while key.lower() in map(str.lower, docs.columns):
        key += "_"
    # the table's columns go in a struct, where none of them meets a name of this function
    rows = keyed(docs, key).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{key}`").alias("__row"))
    own = lambda c: F.col("doc").getField(c)
    light = written(rows.select(own(id_col).alias("doc_id"), own(source_col).alias("source"), word_count(own(text_col)).alias("size"), F.col("__row").alias("row_key")), "mix-light")
    out, aims = _plan(light, weights, share, most, seed)
    chosen = out.filter("more > 0").select(F.col("row_key").alias("__row"))
    met = _with_aims(marked(rows, "__row", chosen, "more").withColumn("skey", source_key(own(source_col))), aims.select("skey", "epochs"))
    met = met.withColumns({"repeats": F.col("epochs") + F.col("more").cast("long"), "size": word_count(own(text_col))})
    met = met.withColumn("taken", F.col("size") * F.col("repeats")).filter("taken > 0")
    return met.select(*[own(c).alias(c) for c in docs.columns if c.lower() not in ("size", "taken", "repeats")], "size", "taken", "repeats")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source")
