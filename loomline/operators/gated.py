"""Gated fits as Spark jobs: a row per run and criterion, joined by what the criteria of a run share.

A pair cites a criterion with odds log 2cosh(d) + gamma, and then favours the side shown first with odds d + beta, where
d is the difference of the two items' scores. Given the position term beta the criteria of a run do not touch, so every
criterion is first fitted by itself (scores and gate, a system of n + 1) at the beta of its rate of wins. A run's
criteria then move on together from their mean beta (``Run``), in steps that lower the value of all. The variance of an
estimate needs, of the other criteria, one number a pair: these are added up by pair in a shuffle between two passes
over the criteria. A criterion's curvature is factored by the levels of its graph of pairs (``levels``).

With a position term of its own each criterion is a fit of its own (n + 2).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written
from .choice import likelihood_ratio_p
from .kernels import condition, laplacian, log_sigmoid, newton, sigmoid
from .levels import Bordered, Levels

Z95 = 1.959963984540054
#: By how much a score moves in a step at most.
MOST = 2.0
#: Largest slope of a criterion's fit from which its run moves on.
ROUGH = 1e-2


class Criterion:
    """One criterion's comparisons: its likelihood, slope and curvature in scores s, gate g and, if ``own``, position b."""

    def __init__(self, a: np.ndarray, b: np.ndarray, x: np.ndarray, ridge: float, own: bool, like: Criterion | None = None):
        self.items, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        self.a, self.b, self.n = at[: len(a)], at[len(a) :], len(self.items)
        self.ridge, self.own, self.far = ridge, own, 0  # far: in so many steps more the curvature itself is not tried
        self.cited, self.first = (x != 0).astype(float), (x == 1).astype(float)
        same = like is not None and np.array_equal(self.a, like.a) and np.array_equal(self.b, like.b)
        self.levels = like.levels if same else Levels(self.a, self.b, self.n)

    def gates(self, p: np.ndarray, beta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = p[self.a] - p[self.b]
        return d, np.abs(d) + np.log1p(np.exp(-2 * np.abs(d))) + p[self.n], d + (p[self.n + 1] if self.own else beta)

    def value(self, p: np.ndarray, beta: float) -> float:
        _, zc, zd = self.gates(p, beta)
        told = np.where(self.cited > 0, log_sigmoid(zc), log_sigmoid(-zc)) + self.first * log_sigmoid(zd) + (self.cited - self.first) * log_sigmoid(-zd)
        return float(0.5 * self.ridge * (p[: self.n] @ p[: self.n]) - told.sum())

    def parts(self, p: np.ndarray, beta: float) -> dict[str, np.ndarray]:
        """By pair: slopes of the log likelihood in d, gate and position, and expected weights."""
        d, zc, zd = self.gates(p, beta)
        pc, pd_, t = sigmoid(zc), sigmoid(zd), np.tanh(d)
        gate, place = self.cited - pc, self.first - self.cited * pd_
        wc, wd = pc * (1 - pc), self.cited * pd_ * (1 - pd_)
        bend = gate * (1 - t * t)  # what the gate takes from the curvature; the round part leaves each pair's at 0 or above
        return {"d": gate * t + place, "gate": gate, "place": place, "dd": wc * t * t + wd, "dg": wc * t, "gg": wc, "db": wd, "bend": bend, "round": np.minimum(bend, 0.0 if self.own else wd)}

    def spread(self, w: np.ndarray) -> np.ndarray:
        """A weight a pair put on its first item and taken from its second."""
        return np.bincount(self.a, w, self.n) - np.bincount(self.b, w, self.n)

    def slope(self, p: np.ndarray, beta: float) -> np.ndarray:
        q = self.parts(p, beta)
        return np.concatenate([self.ridge * p[: self.n] - self.spread(q["d"]), [-q["gate"].sum()], [-q["place"].sum()] if self.own else []])

    def curve(self, p: np.ndarray, beta: float, bent: bool = False) -> np.ndarray:
        """Expected curvature, or with ``bent`` the curvature itself, as a dense matrix (for few items)."""
        q = self.parts(p, beta)
        h = np.zeros((len(p), len(p)))
        h[: self.n, : self.n] = laplacian(self.a, self.b, q["dd"] - q["bend"] if bent else q["dd"], self.n)
        h[np.arange(self.n), np.arange(self.n)] += self.ridge
        h[: self.n, self.n] = h[self.n, : self.n] = self.spread(q["dg"])
        h[self.n, self.n] = q["gg"].sum() + 1e-9
        if self.own:
            h[: self.n, -1] = h[-1, : self.n] = self.spread(q["db"])
            h[-1, -1] = q["db"].sum() + 1e-9
        return h

    def border(self, q: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Columns of gate and own position beside the scores' curvature, and their corner."""
        names = ["dg", "db"] if self.own else ["dg"]
        return np.column_stack([self.spread(q[c]) for c in names]), np.diag([q[c].sum() + 1e-9 for c in (["gg", "db"] if self.own else ["gg"])])

    def system(self, p: np.ndarray, beta: float) -> Bordered:
        """What solves with the expected curvature."""
        q = self.parts(p, beta)
        return Bordered(self.levels.factor(q["dd"], self.ridge), *self.border(q))

    def start(self) -> np.ndarray:
        """Scores of signed wins: at all equal scores the gate's slopes vanish."""
        share = np.clip(self.cited.mean(), 1e-6, 1 - 1e-6)
        won = 0.1 * np.tanh(self.spread(2 * self.first - self.cited))
        return np.concatenate([won, [math.log(share / (1 - share)) - math.log(2)], [self.ahead()] if self.own else []])

    def ahead(self) -> float:
        """The odds of the side shown first at equal scores."""
        share = np.clip(self.first.sum() / max(1.0, self.cited.sum()), 1e-6, 1 - 1e-6)
        return math.log(share / (1 - share))

    def fit(self, p: np.ndarray | None, beta: float, tol: float, tries: int = 8) -> tuple[np.ndarray, int]:
        p, total = self.start() if p is None else p, 0
        for i in range(tries):
            p, steps = newton(p, lambda x: self.value(x, beta), lambda x: self.slope(x, beta), lambda x: self.bowl(x, beta), tol, most=MOST)
            total += steps
            off = self.downhill(p, beta, i)
            if off is None:
                break
            p = p + off
        return p, total

    def downhill(self, p: np.ndarray, beta: float, seed: int) -> np.ndarray | None:
        """A small way off a saddle along what bends down there; None at a minimum."""
        q = self.parts(p, beta)
        factor = self.levels.factor(q["dd"] - q["bend"], self.ridge, 1e-3)
        if not factor.bent:
            return None
        way = np.zeros(len(p))
        way[: self.n] = factor.solve(factor.solve(np.random.default_rng(seed).normal(size=self.n)))
        way *= 0.1 / np.abs(way).max()
        return min(way, -way, key=lambda x: self.value(p + x, beta))

    def bowl(self, p: np.ndarray, beta: float) -> Callable[[np.ndarray], np.ndarray]:
        return lambda right: self.along(p, beta, right[:, None])[:, 0]

    def along(self, p: np.ndarray, beta: float, columns: np.ndarray) -> np.ndarray:
        """Solves with the curvature; the first column's is a step. Where the curvature is not positive definite, the
        blocks at fault are bent upwards; if the step is then far, with what is left of the curvature pair by pair. After
        a step farther still, that comes first in the next ones."""
        q = self.parts(p, beta)
        border = self.border(q)
        if not self.far:
            factor = self.levels.factor(q["dd"] - q["bend"], self.ridge, 0.05)
            try:
                out = Bordered(factor, *border, True).solve(columns)
                if not factor.bent or np.abs(out[:, 0]).max() <= MOST:
                    return out
            except np.linalg.LinAlgError:
                pass
        out = Bordered(self.levels.factor(q["dd"] - q["round"], self.ridge, 1e-6), *border).solve(columns)
        self.far = (self.far or 4) - 1 if np.abs(out[:, 0]).max() > 5 * MOST else 0
        return out

    def beside(self, p: np.ndarray, beta: float, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of the curvature, as ``along`` takes it: solves of ``right`` and of beta's column, what they take from beta's
        slope and leave of its curvature, and the whole of that."""
        q = self.parts(p, beta)
        side, whole = np.append(self.spread(q["db"]), 0.0), float(q["db"].sum())
        out = self.along(p, beta, np.column_stack([right, side]))
        return out, np.array([0.0, whole]) + np.array([1.0, -1.0]) * (side @ out), whole

    def moved(self, columns: np.ndarray, q: dict[str, np.ndarray]) -> np.ndarray:
        """Every pair's slope vector times ``columns`` (scores, gate and own position in rows)."""
        out = q["d"][:, None] * (columns[self.a] - columns[self.b]) + q["gate"][:, None] * columns[self.n]
        return out + q["place"][:, None] * columns[self.n + 1] if self.own else out


class Run:
    """The criteria of a run with the position term for all: unknowns are those of each criterion, then beta.

    Curvatures of two criteria touch in beta only, so a step factors one criterion at a time.
    """

    def __init__(self, criteria: list[Criterion]):
        self.criteria, self.ends = criteria, np.cumsum([c.n + 1 for c in criteria])

    def split(self, x: np.ndarray) -> tuple[list[np.ndarray], float]:
        return np.split(x[:-1], self.ends[:-1]), float(x[-1])

    def value(self, x: np.ndarray) -> float:
        ps, beta = self.split(x)
        return sum(c.value(p, beta) for c, p in zip(self.criteria, ps, strict=True))

    def slope(self, x: np.ndarray) -> np.ndarray:
        ps, beta = self.split(x)
        place = sum(c.parts(p, beta)["place"].sum() for c, p in zip(self.criteria, ps, strict=True))
        return np.concatenate([*[c.slope(p, beta) for c, p in zip(self.criteria, ps, strict=True)], [-place]])

    def bowl(self, x: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        """Solves with the curvature; where that is not positive definite, with what is bent upwards."""
        ps, beta = self.split(x)

        def solve(right: np.ndarray) -> np.ndarray:
            sides, last = self.split(right)
            found, left, whole = [], 0.0, 0.0
            for c, p, r in zip(self.criteria, ps, sides, strict=True):
                columns, rest, of = c.beside(p, beta, r)
                found.append(columns)
                last, left, whole = last - rest[0], left + rest[1], whole + of
            step = last / max(left, 0.05 * whole, 1e-9)
            return np.concatenate([*[y[:, 0] - y[:, 1] * step for y in found], [step]])

        return solve

    def fit(self, x: np.ndarray, tol: float, tries: int = 8) -> tuple[np.ndarray, int]:
        total = 0
        for i in range(tries):
            x, steps = newton(x, self.value, self.slope, self.bowl, tol, most=MOST)
            total += steps
            ps, beta = self.split(x)
            offs = [c.downhill(p, beta, i) for c, p in zip(self.criteria, ps, strict=True)]
            if all(off is None for off in offs):
                break
            x = x + np.concatenate([*[np.zeros(len(p)) if off is None else off for p, off in zip(ps, offs, strict=True)], [0.0]])
        return x, total


def _tasks(spark: SparkSession) -> int:
    """Several a core: fits take unlike times."""
    return max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _blocks(cells: DataFrame, by: list[str]) -> DataFrame:
    """Dense cells as a row per run and criterion with the pairs in order."""
    rows = cells.repartition(_tasks(cells.sparkSession), *by, "k").groupBy(*by, "k").agg(F.array_sort(F.collect_list(F.struct("t", "a", "b", "x"))).alias("c"))
    return rows.select(*by, "k", *[F.col(f"c.{c}").alias(c) for c in ("t", "a", "b", "x")])


def _by_row(df: DataFrame, f: Callable[[dict], dict], keep: list[str], new: str) -> DataFrame:
    """Columns ``keep`` of ``df`` and those that ``f`` gives of a row (``new``: names and types; a column may stay)."""
    names = [*keep, *[c.split()[0] for c in new.split(", ")]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(len(frame)):
                row = {**frame.iloc[i]}
                row |= f(row)
                yield pd.DataFrame([{c: row[c] for c in names}])

    return df.mapInPandas(run, f"{_kinds(df, keep)}, {new}")


def _kinds(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


ARRAYS = ["t", "a", "b", "x"]
FITTED = "p array<double>, beta double, nll double, grad double, steps int, own boolean"


def _together(now: DataFrame, by: list[str], ridge: float, tol: float) -> DataFrame:
    """Fits of single criteria (``*by, k, t, a, b, x, p, beta, steps``) moved on to the least of all of a run and one beta."""
    names = [*ARRAYS, "p", "beta", "steps"]
    runs = now.repartition(_tasks(now.sparkSession), *by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", *names))).alias("c"))
    runs = runs.select(*by, *[F.col(f"c.{c}").alias(c) for c in ("k", *names)])
    keep = [*by, "k", *ARRAYS]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(len(frame)):
                row, criteria = {**frame.iloc[i]}, []
                for a, b, x in zip(row["a"], row["b"], row["x"], strict=True):
                    criteria.append(Criterion(a, b, x, ridge, False, criteria[0] if criteria else None))
                model = Run(criteria)
                cited = [c.cited.sum() + 1e-9 for c in criteria]
                x, steps = model.fit(np.concatenate([*row["p"], [np.average(row["beta"], weights=cited)]]), tol / 100)
                ps, beta = model.split(x)
                grad = np.abs(model.slope(x))
                if not grad.max() < 100 * tol:
                    raise RuntimeError(f"the fit of {[row[c] for c in by]} did not settle: slope {grad.max()}")
                for j, (c, p) in enumerate(zip(criteria, ps, strict=True)):
                    told = {"p": p, "beta": beta, "nll": c.value(p, beta), "grad": float(np.abs(c.slope(p, beta)).max()), "steps": steps + int(row["steps"][j]), "own": False}
                    own = {**{c: row[c] for c in by}, **{c: row[c][j] for c in ("k", *ARRAYS)}}
                    yield pd.DataFrame([{**own, **told}])

    return runs.mapInPandas(run, f"{_kinds(now, keep)}, {FITTED}")


def fit(cells: DataFrame, by: list[str], ridge: float = 1e-3, own: bool = False, beta: float | None = None, start: DataFrame | None = None, tol: float = 1e-6) -> DataFrame:
    """Fits of dense cells ``*by, t, a, b, k, x``: every run (``by``), pair ``t`` of items a and b, and criterion k.

    Returns a row per run and criterion: the cells as arrays in the order of t, ``p`` (scores of the run's items in
    their order, then the gate, then with ``own`` the criterion's own position term), ``beta``, ``nll`` with its
    penalty, ``grad`` (largest slope), ``steps``. ``beta`` pins the position term; fits with ``own`` begin at those of
    ``start``, a fit of the same cells with one position term. Else each criterion is fitted roughly at the beta of its
    rate of wins, and then a run is a task.
    """
    blocks = _blocks(cells, by)
    keep = [*by, "k", *ARRAYS]
    shared = not own and beta is None

    def one(row: dict) -> dict:
        c = Criterion(row["a"], row["b"], row["x"], ridge, own)
        at = c.ahead() if shared else float(beta or 0.0)
        p, steps = c.fit(None if row["p"] is None else np.array(row["p"]), at, ROUGH if shared else tol / 100)
        return {"p": p, "beta": float(p[-1]) if own else at, "nll": c.value(p, at), "grad": float(np.abs(c.slope(p, at)).max()), "steps": steps, "own": own}

    if own and start is not None:
        at = start.select(*by, "k", F.concat("p", F.array("beta")).alias("p"))
        return written(_by_row(blocks.join(at, [*by, "k"]), one, keep, FITTED), "gated-fit")
    fresh = _by_row(blocks.withColumn("p", F.lit(None).cast("array<double>")), one, keep, FITTED)
    return written(_together(written(fresh, "gated-start"), by, ridge, tol) if shared else fresh, "gated-fit")


def scores(fitted: DataFrame, by: list[str]) -> DataFrame:
    """``*by, k, item, s, gamma, beta``: the scores of every item under each run and criterion, with mean 0."""
    items = F.array_sort(F.array_union("a", "b"))
    n = F.size(items)
    s = F.slice("p", F.lit(1), n)
    mean = F.aggregate(s, F.lit(0.0), lambda m, x: m + x) / n
    one = fitted.select(*by, "k", "beta", F.element_at("p", n + 1).alias("gamma"), mean.alias("mean"), F.arrays_zip(items.alias("item"), s.alias("s")).alias("e"))
    rows = one.select(*by, "k", "beta", "gamma", "mean", F.explode("e").alias("e"))  # beside explode, n and mean would be worked out for every item
    return rows.select(*by, "k", F.col("e.item").alias("item"), (F.col("e.s") - F.col("mean")).alias("s"), "gamma", "beta")


INFERENCE = (
    "n_items int, gamma double, beta double, se_gamma double, se_beta double, se_beta_direction double, spread double, noise double, se_spread double, "
    "spread_denoised double, se_spread_denoised double, kappa double, rho double, nll double, grad double, steps int"
)


def inference(fitted: DataFrame, by: list[str], ridge: float = 1e-3) -> DataFrame:
    """A row per run and criterion with standard errors and reliability.

    Variances are sandwiches: the inverse expected curvature around the sum over pairs of squared slopes. ``noise`` is
    the mean variance of a criterion's scores and ``rho`` the share of their spread that is not noise (NaN without
    spread); ``kappa`` is the largest over the second smallest eigenvalue of the scores' weighted graph (infinite if
    that is not connected). ``se_spread`` follows by the delta method; ``se_spread_denoised`` takes the noise for given
    and is a lower bound. ``se_beta_direction`` comes from the position term's own curvature alone.
    """
    own = fitted.select("own").limit(1).collect()
    own = bool(own and own[0].own)
    dealt = lambda rows: rows.repartition(_tasks(rows.sparkSession), *by, "k")  # noqa: E731  small tables are else read and joined in a few tasks

    def system(row: dict) -> tuple:
        c = Criterion(row["a"], row["b"], row["x"], ridge, own)
        p = np.array(row["p"])
        return c, p, c.parts(p, row["beta"]), c.system(p, row["beta"])

    rows = fitted.withColumns({"v": F.lit(None).cast("array<double>"), "sigma": F.lit(1.0)})
    if not own:  # by pair, what the position term takes from all criteria of a run
        def border(row: dict) -> dict:
            c, _, q, found = system(row)
            side = np.append(c.spread(q["db"]), 0.0)
            g = found.solve(side)
            return {"v": c.moved(g[:, None], q)[:, 0] - q["place"], "sigma": float(q["db"].sum() - side @ g)}

        told = written(_by_row(dealt(fitted), border, [*by, "k"], "v array<double>, sigma double"), "gated-border")
        v = told.select(*by, F.posexplode("v").alias("i", "v")).groupBy(*by, "i").agg(F.sum("v").alias("v"))
        v = v.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("v"))
        rows = fitted.join(v, by).join(told.groupBy(*by).agg(F.sum("sigma").alias("sigma")), by)

    def judge(row: dict) -> dict:
        c, p, q, found = system(row)
        s = p[: c.n] - p[: c.n].mean()
        right = np.zeros((len(p), 1 + len(p) - c.n))
        right[: c.n, 0], right[c.n :, 1:] = s / c.n, np.eye(len(p) - c.n)
        w = c.moved(found.solve(right), q)
        direction, more, ends = q["db"].sum(), None, None
        if own:
            se_beta = math.sqrt(float(w[:, -1] @ w[:, -1]))
        else:
            v = np.array(row["v"])
            g = found.solve(np.append(c.spread(q["db"]), 0.0))
            w += np.outer(v, g @ right) / row["sigma"]
            se_beta = math.sqrt(float(v @ v)) / row["sigma"]
            more, ends = v, g[: c.n] / row["sigma"]
        back = lambda columns: np.column_stack([c.spread(q["d"] * x) for x in columns.T])
        noise = float(found.variances(q["d"] ** 2, lambda columns: c.moved(columns, q), back, more, ends).mean())
        var = (w * w).sum(axis=0)
        spread, tilt = float((s * s).mean()), math.sqrt(float(var[0]))
        rest = math.sqrt(max(0.0, spread - noise))
        return {
            "n_items": c.n, "gamma": p[c.n], "beta": row["beta"], "se_gamma": math.sqrt(float(var[1])), "se_beta": se_beta, "se_beta_direction": 1 / math.sqrt(max(direction, 1e-12)),
            "spread": math.sqrt(spread), "noise": noise, "se_spread": tilt / math.sqrt(spread) if spread > 0 else math.inf, "spread_denoised": rest, "se_spread_denoised": tilt / rest if rest > 0 else math.inf,
            "kappa": condition(c.a, c.b, q["dd"], c.n, c.levels), "rho": (spread - noise) / spread if spread > 0 else math.nan,
        }

    return _by_row(dealt(rows), judge, [*by, "k"], INFERENCE)


def position_test(shared: DataFrame, own: DataFrame, by: list[str]) -> DataFrame:
    """``*by, criteria, lr, df, p``: does a position term a criterion fit better than one for all? Two fits of the same cells."""
    total = lambda d, name: d.groupBy(*by).agg(F.count("*").alias("criteria"), F.sum("nll").alias(name))
    both = total(shared, "together").join(total(own, "apart").drop("criteria"), by)
    tail = F.udf(lambda lr, df: likelihood_ratio_p(max(lr, 0.0), df) if df else 1.0, "double")  # a row per run
    out = both.select(*by, "criteria", (2 * (F.col("together") - F.col("apart"))).alias("lr"), (F.col("criteria") - 1).cast("int").alias("df"))
    return out.withColumn("p", tail("lr", "df"))


def wald(estimate: str, se: str, level: float = 0.95) -> list:
    """Columns ``<estimate>_lo, <estimate>_hi``."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(0.5 + level / 2)
    return [(F.col(estimate) + sign * z * F.col(se)).alias(f"{estimate}_{name}") for sign, name in ((-1, "lo"), (1, "hi"))]


def forecasts(cells: DataFrame, by: list[str], ridge: float = 1e-3) -> DataFrame:
    """Forecasts of held-out cells: ``*by, held, t, k, x, p_cite, p_dir, ref_cite, ref_dir``.

    Dense cells ``*by, t, a, b, k, x, fold``. Every fold's fit learns from the other folds and is joined to the fold by
    item and criterion; the references are the rates of citations and of wins of the side shown first, by criterion,
    in the same training folds. An item without a training pair has score 0, the ridge's mean.
    """
    from .choice import gated_terms

    keys = [*by, "held"]
    folds = cells.select("fold").distinct().withColumnRenamed("fold", "held")
    train = cells.join(F.broadcast(folds), F.col("fold") != F.col("held")).drop("fold")
    fitted = fit(train, keys, ridge)
    cited = F.col("x") != 0
    rates = train.groupBy(*keys, "k").agg(F.avg(cited.cast("double")).alias("ref_cite"), (F.count_if(F.col("x") == 1) / F.greatest(F.lit(1), F.count_if(cited))).alias("ref_dir"))
    known = written(scores(fitted, keys), "gated-scores")
    terms = known.select(*keys, "k", "gamma", "beta").distinct()
    side = lambda item, name: known.select(*keys, "k", F.col("item").alias(item), F.col("s").alias(name))
    test = cells.withColumnRenamed("fold", "held").join(side("a", "sa"), [*keys, "k", "a"], "left").join(side("b", "sb"), [*keys, "k", "b"], "left")
    test = test.join(terms, [*keys, "k"]).join(rates, [*keys, "k"])
    gap = F.coalesce("sa", F.lit(0.0)) - F.coalesce("sb", F.lit(0.0))
    gates = gated_terms(gap, F.col("gamma"), F.col("beta"), F.col("x"))
    return test.select(*keys, "t", "k", "x", gates["p_cite"].alias("p_cite"), gates["p_dir"].alias("p_dir"), "ref_cite", "ref_dir")


def gate_cells(told: DataFrame, keep: list[str]) -> DataFrame:
    """Forecasts as calibration cells ``*keep, gate, p, y, pr``: every citation, and the direction of cited cells."""
    y = lambda c: c.cast("double")
    cite = F.struct(F.lit("citation").alias("gate"), F.col("p_cite").alias("p"), y(F.col("x") != 0).alias("y"), F.col("ref_cite").alias("pr"))
    direction = F.struct(F.lit("direction").alias("gate"), F.col("p_dir").alias("p"), y(F.col("x") == 1).alias("y"), F.col("ref_dir").alias("pr"))
    return told.select(*keep, F.explode(F.when(F.col("x") != 0, F.array(cite, direction)).otherwise(F.array(cite))).alias("e")).select(*keep, "e.*")
