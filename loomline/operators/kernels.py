"""Small numerical kernels in numpy. Each works on one fit; Spark runs many fits side by side."""

from __future__ import annotations

import math

import numpy as np

from .levels import Bordered, Levels, parts
from .levels import connection as connection_by_steps

#: Up to so many items eigenvalues come from a dense matrix.
DENSE = 64


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def log_sigmoid(z: np.ndarray) -> np.ndarray:
    return np.minimum(z, 0) - np.log1p(np.exp(-np.abs(z)))


def newton(x: np.ndarray, value, slope, curve, tol: float, steps: int = 200, most: float = math.inf) -> tuple[np.ndarray, int]:
    """Minimise by damped Newton steps; halve a step until the value falls.

    ``curve`` gives a positive definite matrix, or a function that solves with it. In a step no unknown moves by more
    than ``most``, so that a few far from their place do not shorten the steps of all.
    """
    f = value(x)
    for i in range(steps):
        g = slope(x)
        if np.abs(g).max() < tol:
            return x, i
        h = curve(x)
        step = h(g) if callable(h) else np.linalg.solve(h, g)
        if (far := np.abs(step).max()) > most:
            near = np.clip(step, -most, most)
            step = near if g @ near > 0 else step * (most / far)
        if 0 <= g @ step <= 1e-12 * max(1.0, abs(f)) and np.abs(slope(x - step)).max() < np.abs(g).max():
            x = x - step  # the value's rounding hides what is left to fall
            f = min(f, value(x))
            continue
        t = 1.0
        while t > 1e-10:
            new = x - t * step
            fn = value(new)
            if fn <= f - 1e-4 * t * (g @ step) or (fn <= f and t < 1e-6):
                break
            t /= 2
        else:
            return x, i
        x, f = new, fn
    return x, steps


def laplacian(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """The weighted Laplacian of the graph with an edge a pair."""
    m = -np.bincount(a * n + b, w, n * n).reshape(n, n)
    m += m.T
    m[np.arange(n), np.arange(n)] = 0.0
    m[np.arange(n), np.arange(n)] = -m.sum(axis=1)
    return m


def connection(m: np.ndarray) -> float:
    """Largest over second smallest eigenvalue of a Laplacian; infinite if its graph is not connected."""
    if len(m) < 2:
        return math.inf
    ev = np.linalg.eigvalsh(m)
    return float(ev[-1] / ev[1]) if ev[1] > 1e-12 * max(1.0, ev[-1]) else math.inf


def condition(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, levels: Levels | None = None) -> float:
    if n <= DENSE:
        return connection(laplacian(a, b, w, n))
    return connection_by_steps(levels or Levels(a, b, n), a, b, w)


class Holistic:
    """Winner by the sum of all criteria, mentions by each criterion on the winner's side.

    The curvature joins the scores of two items that meet, K by K numbers a pair; gates and the position term border it.
    ``solver`` factors it by the levels of the graph of pairs.
    """

    def __init__(self, pairs: np.ndarray, w: np.ndarray, r: np.ndarray, n: int, ridge: float = 1e-3, gates: bool = True):
        self.a, self.b, self.w, self.r, self.n, self.ridge, self.gates = pairs[:, 0], pairs[:, 1], w.astype(float), r.astype(float), n, ridge, gates
        self.K, self.eta = r.shape[1], 2.0 * w - 1
        self.size = n * self.K + (self.K if gates else 0) + 1
        self.levels: Levels | None = None

    def split(self, p: np.ndarray):
        n, k = self.n, self.K
        return p[: n * k].reshape(n, k), p[n * k : n * k + k] if self.gates else np.zeros(k), p[-1]

    def logits(self, p: np.ndarray):
        s, g, b = self.split(p)
        d = s[self.a] - s[self.b]
        return d.sum(axis=1) + b, self.eta[:, None] * d + g

    def value(self, p: np.ndarray) -> float:
        z, zm = self.logits(p)
        s = p[: self.n * self.K]
        ll = np.where(self.w > 0, log_sigmoid(z), log_sigmoid(-z)).sum() + np.where(self.r > 0, log_sigmoid(zm), log_sigmoid(-zm)).sum()
        return float(0.5 * self.ridge * (s @ s) - ll)

    def spread(self, w: np.ndarray) -> np.ndarray:
        """Weights a pair (in rows, one or several columns) put on the first item and taken from the second."""
        w = w if w.ndim == 2 else w[:, None]
        return np.stack([np.bincount(self.a, c, self.n) - np.bincount(self.b, c, self.n) for c in w.T], axis=1)

    def misses(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z, zm = self.logits(p)
        return sigmoid(z) - self.w, sigmoid(zm) - self.r

    def slope(self, p: np.ndarray) -> np.ndarray:
        u, v = self.misses(p)
        g = self.ridge * p[: self.n * self.K].reshape(self.n, self.K) + self.spread(u[:, None] + self.eta[:, None] * v)
        return np.concatenate([g.ravel(), v.sum(axis=0) if self.gates else [], [u.sum()]])

    def weights(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z, zm = self.logits(p)
        return sigmoid(z) * sigmoid(-z), sigmoid(zm) * sigmoid(-zm)

    def system(self, p: np.ndarray, jitter: float = 1e-9) -> Bordered:
        (wz, wm), k = self.weights(p), self.K
        if self.levels is None:
            self.levels = Levels(self.a, self.b, self.n, k)
        factor = self.levels.factor(wm[:, :, None] * np.eye(k) + wz[:, None, None], max(self.ridge, jitter))
        gate, place = self.spread(self.eta[:, None] * wm), np.repeat(self.spread(wz), k, axis=0)
        gates = [(gate[:, :, None] * np.eye(k)).reshape(-1, k)] if self.gates else []
        return Bordered(factor, np.column_stack([*gates, place]), np.diag(np.concatenate([wm.sum(axis=0) if self.gates else [], [wz.sum()]]) + jitter))

    def solver(self, p: np.ndarray, jitter: float = 1e-9):
        """A function that solves curvature times columns = right sides (``size`` rows)."""
        return self.system(p, jitter).solve

    def fit(self, tol: float = 1e-7, start: np.ndarray | None = None) -> tuple[np.ndarray, int]:
        p, steps = newton(np.zeros(self.size) if start is None else start, self.value, self.slope, self.solver, tol)
        p = p.copy()
        s = p[: self.n * self.K].reshape(self.n, self.K)
        s -= s.mean(axis=0)
        return p, steps

    def moved(self, p: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Every pair's slope vector times ``columns`` (``size`` rows)."""
        (u, v), n, k = self.misses(p), self.n, self.K
        out = np.outer(u, columns[-1])
        for j in range(k):
            c = columns[j : n * k : k]
            out += (u + self.eta * v[:, j])[:, None] * (c[self.a] - c[self.b])
            if self.gates:
                out += v[:, j][:, None] * columns[n * k + j]
        return out

    def inference(self, p: np.ndarray) -> dict[str, np.ndarray]:
        """By criterion: sandwich errors of gate and spread, noise, kappa and rho (-inf without spread); errors of the position term."""
        n, k, system, (wz, wm), (u, v) = self.n, self.K, self.system(p), self.weights(p), self.misses(p)
        s, c = self.split(p)[0], u[:, None] + self.eta[:, None] * v
        back = lambda columns: np.column_stack([self.spread(c * x[:, None]).ravel() for x in columns.T])
        noise = system.variances(c[:, :, None] * c[:, None, :], lambda columns: self.moved(p, columns), back).reshape(n, k).mean(axis=0)
        tilts = ((s - s.mean(axis=0))[:, :, None] / n * np.eye(k)).reshape(n * k, k)
        rest = self.size - n * k
        right = np.zeros((self.size, k + rest))
        right[: n * k, :k], right[n * k :, k:] = tilts, np.eye(rest)
        var = (self.moved(p, system.solve(right)) ** 2).sum(axis=0)
        spread = s.var(axis=0)
        out = {"spread": np.sqrt(spread), "noise": noise, "se_gamma": np.sqrt(var[k : 2 * k]) if self.gates else np.full(k, math.nan), "se_beta": np.full(k, math.sqrt(var[-1]))}
        with np.errstate(divide="ignore", invalid="ignore"):
            out["se_spread"] = np.where(spread > 0, np.sqrt(var[:k] / spread), math.inf)
            out["rho"] = np.where(spread > 0, (spread - noise) / spread, -np.inf)
        out["spread_denoised"] = np.sqrt(np.maximum(0.0, spread - noise))
        graph = Levels(self.a, self.b, n)
        out["kappa"] = np.array([condition(self.a, self.b, wm[:, j], n, graph) for j in range(k)])
        out["kappa_winner"] = np.full(k, condition(self.a, self.b, wz, n, graph))
        return out

    def signs(self, p: np.ndarray) -> np.ndarray:
        """Correlation of every criterion's scores with how often an item won while it was mentioned."""
        won = np.zeros((self.n, self.K))
        np.add.at(won, np.where(self.w > 0, self.a, self.b), self.r)
        x, y = self.split(p)[0] - self.split(p)[0].mean(axis=0), won - won.mean(axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            return (x * y).sum(axis=0) / np.sqrt((x * x).sum(axis=0) * (y * y).sum(axis=0))


def bradley_terry(pairs: np.ndarray, w: np.ndarray, n: int, ridge: float = 1e-3, tol: float = 1e-8) -> tuple[np.ndarray, float]:
    """Scores with mean 0 and the position term of one feature's comparisons."""
    a, b, y = pairs[:, 0], pairs[:, 1], w.astype(float)
    spread = lambda v: np.bincount(a, v, n) - np.bincount(b, v, n)
    odds = lambda x: x[a] - x[b] + x[n]
    value = lambda x: float(0.5 * ridge * (x[:n] @ x[:n]) - np.where(y > 0, log_sigmoid(odds(x)), log_sigmoid(-odds(x))).sum())

    def slope(x: np.ndarray) -> np.ndarray:
        miss = sigmoid(odds(x)) - y
        return np.append(spread(miss) + ridge * x[:n], miss.sum())

    runs = parts(a, b, n)

    def curve(x: np.ndarray):
        v = sigmoid(odds(x)) * sigmoid(-odds(x))
        side = spread(v)

        def solve(right: np.ndarray) -> np.ndarray:
            both = np.column_stack([side, right[:n]])
            for nodes, edges, levels in runs:  # a run's factor goes before the next is made
                both[nodes] = levels.factor(v[edges], ridge).solve(both[nodes])
            z, s = both.T
            beta = (right[n] - side @ s) / (v.sum() + 1e-9 - side @ z)
            return np.append(s - z * beta, beta)

        return solve

    x, _ = newton(np.zeros(n + 1), value, slope, curve, tol)
    return x[:n] - x[:n].mean(), float(x[n])


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost matching of a rectangular matrix by shortest augmenting paths; pairs (row, column)."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, prev, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            cur = c[match[j0] - 1] - u[match[j0]] - v[1:]
            better = ~used[1:] & (cur < low[1:])
            low[1:][better], prev[1:][better] = cur[better], j0
            j1 = int(np.argmin(np.where(used[1:], np.inf, low[1:]))) + 1
            delta = low[j1]
            u[match[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[prev[j0]]
            j0 = prev[j0]
    out = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) for a, b in out) if flip else sorted(out)


def average_linkage(similarity: np.ndarray, cutoff: float) -> np.ndarray:
    """Cluster numbers by average linkage: clusters merge while their mean similarity is at least ``cutoff``."""
    n = len(similarity)
    s, size, of = similarity.astype(float).copy(), np.ones(n), np.arange(n)
    np.fill_diagonal(s, -np.inf)
    while n > 1:
        i, j = np.unravel_index(int(np.argmax(s)), s.shape)
        if s[i, j] < cutoff:
            break
        i, j = min(i, j), max(i, j)
        row = (size[i] * s[i] + size[j] * s[j]) / (size[i] + size[j])
        s[i], s[:, i] = row, row
        s[i, i] = -np.inf
        s[j], s[:, j] = -np.inf, -np.inf
        size[i] += size[j]
        of[of == j] = i
    _, first = np.unique(of, return_index=True)
    order = {int(of[k]): r for r, k in enumerate(sorted(first))}
    return np.array([order[int(k)] for k in of])


def average_linkage_of(vectors: np.ndarray, cutoff: float, block: int = 512) -> np.ndarray:
    """``average_linkage`` of the vectors' products, from sums of clusters: no matrix of all pairs is made.

    The mean similarity of two clusters is the product of their sums over their sizes. Every cluster keeps its nearest;
    a merger brings none nearer to others, so only clusters whose nearest was merged look again.
    """
    n = len(vectors)
    total, size, of, alive = vectors.astype(float).copy(), np.ones(n), np.arange(n), np.ones(n, bool)
    near, best = np.zeros(n, np.int64), np.full(n, -np.inf)

    def look(rows: np.ndarray) -> None:
        for i in range(0, len(rows), block):
            at = rows[i : i + block]
            s = (total[at] @ total.T) / (size[at][:, None] * size)
            s[:, ~alive] = -np.inf
            s[np.arange(len(at)), at] = -np.inf
            near[at] = s.argmax(axis=1)
            best[at] = s[np.arange(len(at)), near[at]]

    if n > 1:
        look(np.arange(n))
    for _ in range(n - 1):
        i = int(np.argmax(best))
        if best[i] < cutoff:
            break
        i, j = min(i, int(near[i])), max(i, int(near[i]))
        total[i] += total[j]
        size[i] += size[j]
        alive[j], best[j] = False, -np.inf
        of[of == j] = i
        look(np.flatnonzero(alive & ((near == i) | (near == j) | (np.arange(n) == i))))
    _, first = np.unique(of, return_index=True)
    order = {int(of[k]): r for r, k in enumerate(sorted(first))}
    return np.array([order[int(k)] for k in of], int)


def participation_ratio(r: np.ndarray) -> float:
    """(sum of eigenvalues)^2 / sum of their squares, negative ones clipped to 0."""
    ev = np.maximum(np.linalg.eigvalsh(r), 0)
    return float(ev.sum() ** 2 / (ev**2).sum())


def entropy_rank(r: np.ndarray) -> float:
    ev = np.maximum(np.linalg.eigvalsh(r), 0)
    p = ev[ev > 0] / ev.sum()
    return float(np.exp(-(p * np.log(p)).sum()))


def binomial_two_sided(k: int, n: int) -> float:
    """Exact two-sided p value at one half."""
    if not n:
        return 1.0
    tail = sum(math.comb(n, i) for i in range(min(k, n - k) + 1))
    return min(1.0, 2 * tail / 2**n) if 2 * k != n else 1.0


def normal_upper(p: float) -> float:
    from statistics import NormalDist

    return -NormalDist().inv_cdf(p)


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact binomial interval by bisection of the tails."""
    alpha = (1 - level) / 2

    def upper_tail(p: float, j: int) -> float:
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(j, n + 1))

    def solve(f) -> float:
        lo, hi = 1e-12, 1 - 1e-12
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid) else (lo, mid)
        return (lo + hi) / 2

    low = 0.0 if k == 0 else solve(lambda p: upper_tail(p, k) < alpha)
    high = 1.0 if k == n else solve(lambda p: 1 - upper_tail(p, k + 1) > alpha)
    return low, high
