"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees are grown on statistics of a bounded sample of labelled documents, every path from a root becomes a
conjunctive rule, a lasso logistic regression keeps a few rules with weights, and those are compiled into one Spark
column expression over the statistics, which are column expressions over the text themselves.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let

#: The fit uses at most so many labelled rows, those with the smallest hash of their id.
FIT_ROWS = 20_000
THRESHOLD = 0.3
WORD = r"[^\x20\x09-\x0D]+"


NAMES = (
    "log_words", "chars_per_word", "capitals_per_word", "symbols_per_word", "pipes_per_word", "bangs_per_word",
    "digits_per_word", "stops_per_word", "commas_per_word", "distinct_words", "distinct_lines", "words_per_line",
)


def statistics(text: Column) -> Column:
    """Statistics of a whole text as an array in the order of NAMES; null counts as empty, ratios of an empty text are 0.

    Counts are bound once per row (``let``), so that neither ratios nor rules scan the text again.
    """
    t = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    less = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    split = lambda c: let(F.split(t, c), lambda x: F.array(F.size(x), F.size(F.array_distinct(x))))
    counts = [count(WORD), F.length(t), count(r"\p{Lu}{2,}"), count(r"[#$%&*<>=+~^@\\_{}\[\]]+"), less("|"), count("!+"), count("[0-9]+"), less(".?;:"), less(",")]
    raw = F.concat(F.array(*[c.cast("int") for c in counts]), split(" "), split("\n"))

    def ratios(c: Column) -> Column:
        words = F.greatest(c[0].cast("double"), F.lit(1.0))
        per = [F.greatest(c[1].cast("double"), F.lit(1.0)) / words, *[c[i] / words for i in range(2, 9)]]
        return F.array(F.log1p(c[0].cast("double")), *per, c[10] / words, c[12].cast("double") / c[11], words / c[11])

    return let(raw, ratios)


@dataclass(frozen=True)
class Rule:
    """A conjunction: every (feature, ``<=`` or ``>``, cut) must hold."""

    tests: tuple[tuple[int, str, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, op, cut in self.tests:
            out &= x[:, f] <= cut if op == "<=" else x[:, f] > cut
        return out


@dataclass
class Ensemble:
    names: tuple[str, ...]
    bias: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def column(self, text: Column) -> Column:
        """The score, from 0 to 1, of a text, in one expression."""
        return let(statistics(text), self.over)

    def over(self, stats: Column) -> Column:
        """The score over an array of the statistics."""
        z = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            every = F.lit(True)
            for f, op, cut in rule.tests:
                c = stats[f]
                every = every & (c <= F.lit(cut) if op == "<=" else c > F.lit(cut))
            z = z + F.when(every, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            z += w * rule.holds(x)
        return 1 / (1 + np.exp(-z))


def grow(x: np.ndarray, codes: np.ndarray, cuts: list[np.ndarray], r: np.ndarray, h: np.ndarray, depth: int, least: int) -> tuple[list[tuple], np.ndarray]:
    """One regression tree on gradients ``r`` and curvatures ``h``: the paths of all its nodes but the root, and its fit."""
    paths: list[tuple] = []
    out = np.zeros(len(r))

    def node(rows: np.ndarray, path: tuple) -> None:
        if path:
            paths.append(path)
        out[rows] = r[rows].sum() / (h[rows].sum() + 1.0)
        if len(path) == depth or len(rows) < 2 * least:
            return
        best = (1e-6, None, None)
        for f in range(x.shape[1]):
            k = len(cuts[f]) + 1
            c = codes[rows, f]
            n = np.cumsum(np.bincount(c, minlength=k))[:-1]
            g, q = np.cumsum(np.bincount(c, r[rows], k))[:-1], np.cumsum(np.bincount(c, h[rows], k))[:-1]
            G, Q = r[rows].sum(), h[rows].sum()
            gain = g**2 / (q + 1) + (G - g) ** 2 / (Q - q + 1) - G**2 / (Q + 1)
            gain[(n < least) | (len(rows) - n < least)] = -1
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), f, int(gain.argmax()))
        if best[1] is None:
            return
        f, j = best[1], best[2]
        left = codes[rows, f] <= j
        node(rows[left], (*path, (f, "<=", float(cuts[f][j]))))
        node(rows[~left], (*path, (f, ">", float(cuts[f][j]))))

    node(np.arange(len(r)), ())
    return paths, out


def simplified(path: tuple) -> tuple:
    """The tightest tests of a path, in a fixed order."""
    best: dict[tuple[int, str], float] = {}
    for f, op, cut in path:
        old = best.get((f, op))
        best[f, op] = cut if old is None else min(old, cut) if op == "<=" else max(old, cut)
    return tuple(sorted((f, op, cut) for (f, op), cut in best.items()))


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty, by accelerated proximal steps; the bias is free."""
    n, k = a.shape
    mean = a.mean(axis=0)
    c = a - mean
    v = np.ones(k)
    for _ in range(20):
        v = c.T @ (c @ v)
        v /= np.linalg.norm(v) + 1e-30
    step = 1 / (0.25 * (v @ (c.T @ (c @ v))) / n + 0.25)
    w, z, b, zb, t = np.zeros(k), np.zeros(k), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)), 0.0, 1.0
    zb = b
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(c @ z + zb)))
        g = c.T @ (p - y) / n
        new = z - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nb = zb - step * (p - y).mean()
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    return float(b - mean @ w), w


def fit(names: tuple[str, ...], x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, penalty: float = 1e-3) -> Ensemble:
    """The ensemble of ``x`` (rows by statistics) and labels ``y``; without both labels, a constant of the share."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Ensemble(names, math.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    z = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    rules: dict[tuple, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        paths, out = grow(x, codes, cuts, y - p, p * (1 - p), depth, max(5, len(y) // 1000))
        z += rate * out
        rules |= dict.fromkeys(map(simplified, paths))
    found = [Rule(t) for t in rules]
    a = np.stack([r.holds(x) for r in found], axis=1).astype(np.float32) if found else np.zeros((len(y), 0), np.float32)
    bias, w = lasso(a, y.astype(np.float64), penalty)
    kept = [i for i in range(len(found)) if abs(w[i]) > 1e-6]
    return Ensemble(names, bias, [found[i] for i in kept], [float(w[i]) for i in kept])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Ensemble:
    """Fit on the texts of ``docs`` that ``labels`` (``doc_id, quality``) marks and are not held out, at most ``fit_rows``."""
    usable = labels.select("doc_id", F.col("quality").cast("double").alias("y")).filter("doc_id is not null and y is not null").filter(~held_out(F.col("doc_id")))
    first = [F.xxhash64("doc_id"), "doc_id", "y"]
    few = usable.orderBy(*first).limit(fit_rows)
    # where an id repeats, each of its rows meets each of its labels; the bound holds for the pairs
    sample = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("doc_id", "y", F.xxhash64("text").alias("h"), statistics(F.col("text")).alias("x"))
    rows = sample.orderBy(*first, "h").limit(fit_rows).select("doc_id", "y", "x").toArrow()
    x = np.array(rows["x"].to_pylist(), np.float64).reshape(-1, len(NAMES))
    order = np.lexsort((*x.T, rows["y"].to_numpy(), rows["doc_id"].to_numpy()))
    return fit(NAMES, x[order], rows["y"].to_numpy()[order])


def quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id, held_out, score, predicted``.

    Learns from ``labels`` of rows that are not held out, at most ``fit_rows`` of them. Null and empty texts are
    scored by their statistics. A null id is not held out and has no label. Repeated rows stay; labels that repeat
    count each time. Without labels the score is 0.5; an empty table gives an empty result. Other columns, labels
    among them, are no inputs of the score.
    """
    out = docs.select("doc_id", train(docs, labels, fit_rows).column(F.col("text")).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` without the rows that ``quality`` predicts 0, with all its columns; one pass without a shuffle."""
    return docs.filter(train(docs, labels, fit_rows).column(F.col("text")) >= THRESHOLD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
