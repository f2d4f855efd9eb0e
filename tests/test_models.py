import itertools
import math

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from loomline.operators import calibration, choice, gated, graph, kernels, panel_fit, rationale, stats
from loomline.operators.order import numbered
from loomline.plans import QUERIES
from loomline.plans import model_queries as M


def problem(n=8, k=3, t=120, seed=0):
    r = np.random.default_rng(seed)
    pairs = np.array([r.choice(n, 2, replace=False) for _ in range(t)])
    s, g = r.normal(0, 1, (n, k)), r.normal(0, 0.5, k)
    d = s[pairs[:, 0]] - s[pairs[:, 1]]
    cited = r.random((t, k)) < kernels.sigmoid(np.abs(d) + np.log1p(np.exp(-2 * np.abs(d))) + g)
    x = np.where(cited, np.where(r.random((t, k)) < kernels.sigmoid(d + 0.2), 1, -1), 0)
    w = (r.random(t) < kernels.sigmoid(d.sum(axis=1))).astype(int)
    m = (r.random((t, k)) < kernels.sigmoid((2 * w - 1)[:, None] * d + g)).astype(int)
    return pairs, x, w, m, n


def dense(model, p):
    """The model's curvature by differences of its slope."""
    e = 1e-6
    return np.stack([(model.slope(p + np.eye(len(p))[i] * e) - model.slope(p - np.eye(len(p))[i] * e)) / (2 * e) for i in range(len(p))])


@pytest.mark.parametrize("gates", [True, False])
def test_holistic_slopes_and_blocks_match_differences(gates):
    pairs, _, w, m, n = problem()
    model = kernels.Holistic(pairs, w, m, n, gates=gates)
    p = np.random.default_rng(5).normal(0, 0.5, model.size)
    g, e = model.slope(p), 1e-6
    for i in range(model.size):
        step = np.eye(model.size)[i] * e
        assert abs((model.value(p + step) - model.value(p - step)) / (2 * e) - g[i]) < 1e-4
    solve = model.solver(p)
    assert np.allclose(solve(dense(model, p)), np.eye(model.size), atol=1e-4)
    right = np.random.default_rng(6).normal(0, 1, (model.size, 4))
    assert np.allclose(solve(right)[:, 2], solve(right[:, 2]))
    best, _ = model.fit()
    assert np.abs(model.slope(best)).max() < 1e-3 and model.value(best) <= model.value(p)


def scores_by_pair(model, p):
    """Every pair's slope of the negative log likelihood, by differences."""
    out, ridge = [], model.ridge
    for t in range(len(model.a)):
        one = kernels.Holistic(np.array([[model.a[t], model.b[t]]]), model.w[t : t + 1], model.r[t : t + 1], model.n, 0.0, model.gates)
        out.append(one.slope(p))
    assert np.allclose(np.sum(out, axis=0) + np.concatenate([ridge * p[: model.n * model.K], np.zeros(model.size - model.n * model.K)]), model.slope(p))
    return np.array(out)


@pytest.mark.parametrize("gates", [True, False])
def test_holistic_sandwich_by_blocks_equals_the_dense_one(gates):
    pairs, _, w, m, n = problem(seed=4)
    model = kernels.Holistic(pairs, w, m, n, gates=gates)
    p, _ = model.fit()
    solve = model.solver(p)
    inverse = solve(np.eye(model.size))
    u = scores_by_pair(model, p) @ inverse
    cov, got, k = u.T @ u, model.inference(p), model.K
    s = p[: n * k].reshape(n, k)
    assert np.allclose(got["noise"], np.diag(cov)[: n * k].reshape(n, k).mean(axis=0), rtol=1e-8)
    assert np.allclose(got["se_beta"], np.sqrt(cov[-1, -1]), rtol=1e-8)
    if gates:
        assert np.allclose(got["se_gamma"], np.sqrt(np.diag(cov)[n * k : n * k + k]), rtol=1e-8)
    for j in range(k):
        at = np.arange(n) * k + j
        slant = s[:, j] / (n * s[:, j].std())
        assert abs(got["se_spread"][j] - math.sqrt(slant @ cov[np.ix_(at, at)] @ slant)) < 1e-8
    assert (got["kappa"] > 1).all() and (got["rho"] < 1).all() and np.isfinite(model.signs(p)).all()


def test_frozen_gates_reduce_to_the_model_without():
    pairs, _, w, m, n = problem(seed=2)
    a = kernels.Holistic(pairs, w, m, n, gates=False)
    p, _ = a.fit()
    b = kernels.Holistic(pairs, w, m, n)
    q = np.concatenate([p[:-1], np.zeros(3), p[-1:]])
    assert abs(a.value(p) - b.value(q)) < 1e-9


def test_sandwich_shrinks_with_more_pairs():
    size = []
    for t in (300, 1200):
        pairs, _, w, m, n = problem(t=t, seed=3)
        model = kernels.Holistic(pairs, w, m, n)
        size.append(model.inference(model.fit()[0])["noise"].mean())
    assert size[1] < 0.5 * size[0]


def test_condition_is_infinite_without_connection():
    assert kernels.condition(np.array([0, 2]), np.array([1, 3]), np.ones(2), 4) == math.inf
    assert abs(kernels.condition(np.array([0, 1, 2]), np.array([1, 2, 0]), np.ones(3), 3) - 1) < 1e-9


def test_assignment_linkage_and_tails_match_brute_force():
    r = np.random.default_rng(1)
    for shape in ((3, 5), (5, 3), (4, 4)):
        c = r.random(shape)
        got = sum(c[i, j] for i, j in kernels.assignment(c))
        small, big = min(shape), max(shape)
        best = min(sum((c[i, p[i]] if shape[0] <= shape[1] else c[p[i], i]) for i in range(small)) for p in itertools.permutations(range(big), small))
        assert abs(got - best) < 1e-12
    s = np.array([[1, 0.9, 0.1], [0.9, 1, 0.2], [0.1, 0.2, 1]])
    assert kernels.average_linkage(s, 0.5).tolist() == [0, 0, 1] and kernels.average_linkage(s, 0.1).tolist() == [0, 0, 0]
    assert abs(kernels.binomial_two_sided(2, 10) - 2 * (1 + 10 + 45) / 1024) < 1e-12 and kernels.binomial_two_sided(5, 10) == 1.0
    lo, hi = kernels.clopper_pearson(8, 10)
    assert abs(lo - 0.4439) < 1e-3 and abs(hi - 0.9748) < 1e-3
    assert abs(choice.likelihood_ratio_p(3.841458820694124, 1) - 0.05) < 1e-9 and abs(choice.likelihood_ratio_p(30, 20) - 0.0698537) < 1e-6
    assert abs(kernels.participation_ratio(np.eye(4)) - 4) < 1e-12 and abs(kernels.entropy_rank(np.eye(4)) - 4) < 1e-9


def test_frozen_newton_matches_the_kernel(spark):
    r = np.random.default_rng(4)
    q = [(float(a), float(b), float(c)) for a, b, c in zip(r.choice([-1, 1], 30), r.normal(0, 1, 30), r.integers(0, 2, 30), strict=True)]
    df = spark.createDataFrame([(q,)], "l array<struct<sign:double,c:double,w:double>>")
    x = df.select(choice.frozen_score(F.col("l"), steps=30)).first()[0]
    assert abs(sum(a * (kernels.sigmoid(np.array(a * x + b)) - w) for a, b, w in q) + 1e-3 * x) < 1e-9


def gated_cells(spark, runs):
    rows = [(run, t, int(a), int(b), k, int(x[t, k])) for run, (pairs, x, *_) in runs.items() for t, (a, b) in enumerate(pairs) for k in range(x.shape[1])]
    return spark.createDataFrame(rows, "run string, t long, a long, b long, k int, x int")


class DenseGated:
    """The whole model of one run, criterion by criterion in one vector (scores of items, gates, position)."""

    def __init__(self, pairs, x, ridge=1e-3):
        self.parts = [gated.Criterion(pairs[:, 0], pairs[:, 1], x[:, k], ridge, False) for k in range(x.shape[1])]
        self.n, self.K, self.ridge = self.parts[0].n, x.shape[1], ridge

    def of(self, p):
        return [np.append(p[k * self.n : (k + 1) * self.n], p[self.n * self.K + k]) for k in range(self.K)], p[-1]

    def value(self, p):
        own, beta = self.of(p)
        return sum(c.value(q, beta) for c, q in zip(self.parts, own, strict=True))

    def join(self, own, last):
        return np.concatenate([*[q[: self.n] for q in own], [q[self.n] for q in own], [last]])

    def slope(self, p):
        own, beta = self.of(p)
        return self.join([c.slope(q, beta) for c, q in zip(self.parts, own, strict=True)], -sum(c.parts(q, beta)["place"].sum() for c, q in zip(self.parts, own, strict=True)))

    def sandwich(self, p):
        (own, beta), n, k = self.of(p), self.n, self.K
        size, t = n * k + k + 1, len(self.parts[0].a)
        h, u = np.zeros((size, size)), np.zeros((t, size))
        for j, (c, q) in enumerate(zip(self.parts, own, strict=True)):
            at, w = np.append(np.arange(n) + j * n, n * k + j), c.parts(q, beta)
            h[np.ix_(at, at)] = c.curve(q, beta)
            side = np.append(c.spread(w["db"]), 0.0)
            h[at, -1], h[-1, at] = side, side
            h[-1, -1] += w["db"].sum()
            u[np.arange(t), j * n + c.a] += w["d"]
            u[np.arange(t), j * n + c.b] -= w["d"]
            u[:, n * k + j], u[:, -1] = w["gate"], u[:, -1] + w["place"]
        v = u @ np.linalg.inv(h)
        return v.T @ v


def test_gated_fits_and_sandwiches_equal_the_dense_model(spark):
    runs = {"u": problem(seed=7), "v": problem(seed=8, t=200)}
    cells = gated_cells(spark, runs)
    fitted = gated.fit(cells, ["run"])
    got = {(r.run, r.k): r for r in fitted.collect()}
    told = {(r.run, r.k): r for r in gated.inference(fitted, ["run"]).collect()}
    assert len(got) == 6 and all(r.grad < 1e-6 for r in got.values())
    for run, (pairs, x, *_) in runs.items():
        m = DenseGated(pairs, x)
        p = m.join([np.array(got[run, k].p) for k in range(3)], got[run, 0].beta)
        g = m.slope(p)
        assert np.abs(g).max() < 1e-5
        for i in range(0, len(p), 5):
            step = np.eye(len(p))[i] * 1e-5
            assert abs((m.value(p + step) - m.value(p - step)) / 2e-5 - g[i]) < 1e-5
        r = np.random.default_rng(1)
        assert all(m.value(p + r.normal(0, 1e-3, len(p))) >= m.value(p) for _ in range(20))
        cov, n = m.sandwich(p), m.n
        for k in range(3):
            own = told[run, k]
            s = p[k * n : (k + 1) * n]
            s = s - s.mean()
            slant = s / (n * s.std())
            assert abs(own.noise / np.diag(cov)[k * n : (k + 1) * n].mean() - 1) < 1e-8
            assert abs(own.se_gamma / math.sqrt(cov[n * 3 + k, n * 3 + k]) - 1) < 1e-8 and abs(own.se_beta / math.sqrt(cov[-1, -1]) - 1) < 1e-8
            assert abs(own.se_spread / math.sqrt(slant @ cov[k * n : (k + 1) * n, k * n : (k + 1) * n] @ slant) - 1) < 1e-7
            assert abs(own.spread - s.std()) < 1e-9 and own.kappa > 1 and own.rho < 1 and own.se_spread_denoised >= own.se_spread
    s = gated.scores(fitted, ["run"]).groupBy("run", "k").agg(F.sum("s").alias("s"), F.count("*").alias("n")).collect()
    assert all(abs(r.s) < 1e-9 and r.n == 8 for r in s)


def test_own_position_terms(spark):
    runs = {"u": problem(seed=9, t=200)}
    cells = gated_cells(spark, runs)
    shared = gated.fit(cells, ["run"])
    beta = shared.first().beta
    pinned = {r.k: r for r in gated.fit(cells, ["run"], beta=beta).collect()}
    own = gated.fit(cells, ["run"], own=True, start=shared)
    for r in shared.collect():  # with the position term given, the criteria do not touch
        assert np.allclose(r.p, pinned[r.k].p, atol=1e-4) and abs(r.nll - pinned[r.k].nll) < 1e-8
    pairs, x, *_ = runs["u"]
    for r in own.collect():
        c = gated.Criterion(pairs[:, 0], pairs[:, 1], x[:, r.k], 1e-3, True)
        p = np.array(r.p)
        assert np.abs(c.slope(p, 0.0)).max() < 1e-6 and r.beta == p[-1]
        num = [(c.value(p + d, 0.0) - c.value(p - d, 0.0)) / 2e-5 for d in np.eye(len(p)) * 1e-5]
        assert np.allclose(num, c.slope(p, 0.0), atol=1e-5)
        u = np.zeros((len(pairs), len(p)))
        w = c.parts(p, 0.0)
        u[np.arange(len(pairs)), c.a] += w["d"]
        u[np.arange(len(pairs)), c.b] -= w["d"]
        u[:, c.n], u[:, c.n + 1] = w["gate"], w["place"]
        v = u @ np.linalg.inv(c.curve(p, 0.0))
        told = gated.inference(own.filter(F.col("k") == r.k), ["run"]).first()
        assert abs(told.se_beta / np.linalg.norm(v[:, -1]) - 1) < 1e-8 and abs(told.noise / (v[:, : c.n] ** 2).sum(axis=0).mean() - 1) < 1e-8
    test = gated.position_test(shared, own, ["run"]).first()
    assert test.lr >= 0 and test.df == 2 and abs(test.p - choice.likelihood_ratio_p(test.lr, 2)) < 1e-12


def test_gated_forecasts_are_those_of_the_other_folds(spark):
    pairs, x, *_ = problem(seed=11, t=150)
    cells = gated_cells(spark, {"u": (pairs, x)}).withColumn("fold", (F.col("t") % 3).cast("int"))
    told = gated.forecasts(cells, ["run"]).collect()
    assert len(told) == 450
    for held in range(3):
        train = np.arange(150) % 3 != held
        alone = {r.k: r for r in gated.fit(gated_cells(spark, {"u": (pairs[train], x[train])}), ["run"]).collect()}
        for r in told:
            if r.held == held and r.t < 12:
                p = np.array(alone[r.k].p)
                d = p[pairs[r.t, 0]] - p[pairs[r.t, 1]]
                assert abs(r.p_dir - kernels.sigmoid(d + alone[r.k].beta)) < 1e-4 and r.x == x[r.t, r.k]
                assert abs(r.ref_cite - (x[train][:, r.k] != 0).mean()) < 1e-12 and abs(r.ref_dir - (x[train][:, r.k] == 1).sum() / (x[train][:, r.k] != 0).sum()) < 1e-12
    gates = gated.gate_cells(gated.forecasts(cells, ["run"]), ["t"]).groupBy("gate").count().collect()
    assert {r.gate: r["count"] for r in gates} == {"citation": 450, "direction": int((x != 0).sum())}


def test_scores_are_listed_without_work_on_all_items_for_each(spark):
    n = 500
    row = [("u", 0, list(range(n)), [*range(1, n), 0], [float(i) for i in range(n)] + [0.5], 0.1)]
    fitted = spark.createDataFrame(row, "run string, k int, a array<bigint>, b array<bigint>, p array<double>, beta double")
    out = gated.scores(fitted.repartition(2), ["run"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_union" not in plan.partition("Generate")[0]  # what stands above explode is worked out for every item
    assert {r.item: round(r.s, 9) for r in out.collect()} == {i: i - (n - 1) / 2 for i in range(n)}


def test_holistic_fits_run_side_by_side(spark):
    rows = []
    for run in ("u", "v"):
        pairs, x, w, m, n = problem(seed=7)
        rows += [(run, t, int(a), int(b), int(w[t]), k, int(x[t, k]), int(m[t, k])) for t, (a, b) in enumerate(pairs) for k in range(3)]
    df = spark.createDataFrame(rows, "run string, t long, a long, b long, w int, k int, x int, r int")
    h = choice.fit_holistic(df.select("run", "t", "a", "b", "w", "k", "r")).collect()
    assert len(h) == 6 and all(r.restart_gap < 1e-4 and r.kappa_winner > 1 and r.sign > 0 for r in h) and len({(r.k, round(r.gamma, 9)) for r in h}) == 3
    told = choice.holistic_forecasts(df.select("run", "t", "a", "b", "w", "k", "r", (F.col("t") % 4).cast("int").alias("fold"))).collect()
    assert len(told) == 720
    out = np.arange(120) % 4 == 1
    model = kernels.Holistic(pairs[~out], w[~out], m[~out], n)
    z, _ = kernels.Holistic(pairs[out], w[out], m[out], n).logits(model.fit()[0])
    want = dict(zip(np.flatnonzero(out).tolist(), kernels.sigmoid(z).tolist(), strict=True))
    assert all(abs(r.p_win - want[r.t]) < 1e-8 for r in told if r.held == 1)
    s = choice.fit_bradley_terry(df.filter("k = 0").select("run", "a", "b", "w"), ["run"]).groupBy("run").agg(F.sum("score").alias("s")).collect()
    assert all(abs(x.s) < 1e-9 for x in s)


def test_panels_and_halves(spark):
    r = np.random.default_rng(12)
    items = spark.createDataFrame([(i, "test" if i % 5 == 0 else "train") for i in range(31)], "item long, split string")  # item 30 is never compared
    truth = r.normal(0, 1, 30)
    rows = []
    for t in range(500):
        a, b = (int(v) for v in r.choice(30, 2, replace=False))
        for f in ("x", "y"):
            rows.append((t, f, a, b, float(r.random() < kernels.sigmoid(truth[a] - truth[b] + 0.3))))
    j = spark.createDataFrame(rows, "pair_index long, feature string, first long, other long, w double")
    out = panel_fit.fit_panel(j, items, []).collect()
    assert len(out) == 62 and {x.item for x in out if x.score is None} == {30}
    for f in ("x", "y"):
        s = {x.item: x.score for x in out if x.feature == f}
        beta = next(x.beta for x in out if x.feature == f)
        for q in (0, 5, 25):  # the score of a test item is where its slope against the anchors vanishes
            g = 1e-3 * s[q]
            for t, g_, a, b, w in rows:
                if g_ == f and q in (a, b) and (a % 5 == 0) != (b % 5 == 0):
                    g += (kernels.sigmoid(np.array(s[a] - s[b] + beta)) - w) * (1 if a == q else -1)
            assert abs(g) < 1e-6
        known = [i for i in range(30) if i % 5]
        assert np.corrcoef([s[i] for i in known], truth[known])[0, 1] > 0.8
    h = panel_fit.halves(j, items, []).select("pair_index", "half", "first", "other").distinct().collect()
    use = {t for t, _, a, b, _ in rows if a % 5 or b % 5}
    assert len(h) == len(use) == len({x.pair_index for x in h})
    among = [x.half for x in h if x.first % 5 and x.other % 5]
    assert abs(sum(among) * 2 - len(among)) <= 1
    for q in range(0, 30, 5):
        own = [x.half for x in h if q in (x.first, x.other)]
        assert 0 <= sum(own) * 2 - len(own) <= 1
    rel = panel_fit.half_reliability(panel_fit.fit_panel(panel_fit.halves(j, items, []), items, ["half"]), []).collect()
    assert {x.feature for x in rel} == {"x", "y"} and all(x.n == 6 and x.r > 0 and x.stepped_up >= x.r for x in rel)


def test_an_unknown_anchor_gives_no_score(spark):
    tests = spark.createDataFrame([(1, "f", 0, 1, 1.0, 1.0), (2, "f", 5, 9, -1.0, 1.0)], "pair_index long, feature string, item long, anchor long, sign double, w double")
    anchors = spark.createDataFrame([("f", 1, 0.5, 0.1)], "feature string, item long, score double, beta double")
    got = {x.item: x.score for x in panel_fit.score_tests(tests, anchors, []).collect()}
    assert got[5] is None and got[0] > 0.5


def test_resampled_sums_equal_weights_by_hand(spark):
    r = np.random.default_rng(3)
    rows = [("g" if i % 3 else None, i // 4, float(r.random()), float(r.integers(0, 2)), 0.4) for i in range(200)]
    cells = spark.createDataFrame(rows, "g string, unit long, p double, y double, pr double").repartition(5)
    got = calibration.resampled_bins(cells, ["g"], "unit", 30).collect()
    h = {x.unit: x.h for x in cells.select("unit", F.xxhash64("unit").alias("h")).distinct().collect()}
    w = {u: calibration.weights(np.array([x]).view(np.uint64), 30)[0] for u, x in h.items()}
    for x in got:
        mine = [row for row in rows if row[0] == x.g and sum(row[2] >= e * 0.1 for e in range(1, 10)) == x.bin]
        assert x.n == sum(w[row[1]][x.rep] for row in mine) and abs(x.se - sum(w[row[1]][x.rep] * (row[2] - row[3]) ** 2 for row in mine)) < 1e-9
    all_ = np.concatenate([calibration.weights(np.arange(2000, dtype=np.uint64) * np.uint64(77), 200)[:, 1:].ravel()])
    assert abs(all_.mean() - 1) < 0.01 and abs(all_.var() - 1) < 0.02


def test_circle_pairs_are_regular_connected_and_distinct(spark):
    for n, d in ((10, 2), (20, 5), (8, 7)):
        p = graph.circle_pairs(spark, n, d)
        assert graph.faults(p).count() == 0
        assert {x.degree for x in graph.degrees(p).collect()} == {d} and p.count() == n * d // 2
    r = graph.budget_report(graph.circle_pairs(spark, 10, 3).withColumn("gap", F.abs(F.col("a") - F.col("b"))), 10, [5, 15], "gap").orderBy("budget").collect()
    assert [(x.degree_min, x.degree_max, x.components) for x in r] == [(1, 1, 5), (3, 3, 1)]
    with pytest.raises(ValueError):
        graph.circle_pairs(spark, 7, 2)


def test_placements_and_ties(spark):
    p = spark.createDataFrame([("x",), ("y",), ("z",)], "phrase_norm string")
    m = spark.createDataFrame([("x", "one", 0), ("x", "two", 1), ("y", "one", 2)], "phrase_norm string, criterion string, ord int")
    get = lambda rule, rest: {r.phrase_norm: r.criterion for r in rationale.place(p, m, rule, rest).collect()}
    assert get("last", "self") == {"x": "two", "y": "one", "z": "z"}
    assert get("first", "other") == {"x": "one", "y": "one", "z": "Other"}
    assert get("last", "none") == {"x": "two", "y": "one", "z": None}
    c = spark.createDataFrame([(1, "a", "A"), (1, "a", "B"), (2, "a", "A"), (2, "a", "A"), (2, "b", "B"), (3, None, "A")], "pair_index long, criterion string, winner_slot string")
    assert {(r.pair_index, r.criterion, r.x) for r in rationale.verdict_tensor(c).collect()} == {(2, "a", 1), (2, "b", -1)}
    k = rationale.active_criteria(c, 0.0).collect()
    assert {(r.criterion, r.mentions, r.k) for r in k} == {("a", 2, 0), ("b", 1, 1)}


def test_paired_statistics(spark):
    d = spark.createDataFrame([("f", 1.0), ("f", 2.0), ("f", -1.0), ("f", 0.0), ("g", 1.0), ("g", None)], "feature string, d double")
    w = {r.feature: r for r in stats.win_rates(d).collect()}
    assert (w["f"].n, w["f"].n_win, w["f"].n_loss, w["f"].n_tie, w["f"].win_rate) == (4, 2, 1, 1, 0.625) and w["g"].n == 1
    assert abs(w["f"].p - kernels.binomial_two_sided(2, 3)) < 1e-12 and abs(w["g"].q - 1.0) < 1e-12
    n = spark.createDataFrame([(int(i), int(i)) for i in np.random.default_rng(0).permutation(50)], "v long, x long")
    assert [(r.v, r.i) for r in numbered(n, ["v"]).orderBy("v").collect()] == [(i, i) for i in range(50)]
    deck = stats.sign_deck(n.select("v"), "v").groupBy("sign").count().collect()
    assert {(r.sign, r["count"]) for r in deck} == {(1, 25), (-1, 25)}


def test_l1_weights_meet_the_optimality_conditions():
    from loomline.operators import selection

    r = np.random.default_rng(6)
    x = r.normal(0, 1, (120, 6))
    y = (r.random(120) < kernels.sigmoid(x @ np.array([2, -1, 0, 0, 0, 0.0]))).astype(float)
    for c in (0.05, 1.0):
        w = selection.l1_logistic(x, y, c)
        g = -c * (x.T @ (y - kernels.sigmoid(x @ w)))
        assert np.abs(g[w == 0]).max(initial=0) <= 1 + 1e-4 and np.abs(g[w != 0] + np.sign(w[w != 0])).max(initial=0) < 1e-3
    folds = selection.group_folds(np.array(list("aaaabbbccdefgh")), 3)
    assert len({(g, f) for g, f in zip("aaaabbbccdefgh", folds, strict=True)}) == 8 and max(np.bincount(folds)) - min(np.bincount(folds)) <= 1


def test_spans_budgets_subsets_and_designs(spark):
    import pandas as pd

    from loomline.operators import selection

    even = lambda n, k: sorted(set(np.rint(np.linspace(0, n - 1, k)).astype(int).tolist())) if k else []
    sizes = {"train": np.arange(1.0, 71), "test": np.array([3.0, 3.0, 50.0])}
    rows = spark.createDataFrame([(s, i, float(x)) for s, xs in sizes.items() for i, x in enumerate(xs)], "split string, pair_id int, est_tokens double")
    for budget in (0, 5, 107, 1000, 10_000):
        got = selection.pack_to_budget(rows, budget, {"train": 0.5, "test": 0.5}).collect()
        for s, xs in sizes.items():
            best = max((k for k in range(1, len(xs) + 1) if xs[even(len(xs), k)].sum() <= budget / 2), default=0)
            assert sorted(r.pair_id for r in got if r.split == s) == even(len(xs), best), (budget, s)
    assert selection.pack_to_budget(rows.limit(0), 10, {"train": 1.0}).count() == 0
    assert selection.subsets(4, 2, 10) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)] and all(len(set(x)) == 5 for x in selection.subsets(20, 5, 50))
    assert len(selection.subsets(5, 2, 100)) == 10 and len(set(selection.subsets(20, 5, 50))) == 50
    assert abs(selection.subset_curve(np.eye(4))[2] - 3) < 1e-9
    pool = pd.DataFrame({"item": range(30), "band": [i % 5 for i in range(30)], "prompt": [i % 3 for i in range(30)]})
    got = selection.balanced_selection(pool, 10, 1)
    assert sorted(np.bincount([i % 5 for i in got]).tolist()) == [2] * 5 and {i % 3 for i in got} == {0, 1, 2}
    d = selection.near_orthogonal(spark.range(1), 24, [2, 3, 4], 20).first()
    x = np.array(d.design)
    assert x.shape == (24, 3) and all(np.ptp(np.bincount(x[:, j])) == 0 for j in range(3)) and d.worst < 0.3


def bisected(comparisons, ridge=1e-3):
    low, high = -60.0, 60.0
    for _ in range(80):
        x = (low + high) / 2
        slope = ridge * x + sum(q.sign * (1 / (1 + math.exp(-(q.sign * x + q.c))) - q.w) for q in comparisons)
        low, high = (x, high) if slope < 0 else (low, x)
    return low


def test_unclamped_frozen_scores_are_the_minimum(spark):
    want = {(x.item, x.criterion): bisected(x.l) for x in M.frozen_comparisons(spark, DATA).collect()}
    got = {(x.item, x.criterion): x.score for x in QUERIES["q_frozen_score_newton"](spark, DATA).collect()}
    assert want.keys() == got.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-3
    assert len({round(x, 3) for x in got.values() if abs(x) > 6}) > 2


def test_bands_leave_out_what_is_missing(spark):
    from loomline.operators import resampling

    s = spark.createDataFrame([(float(i), float("nan") if i == 3 else 1.0, None) for i in range(101)], "a double, b double, c double")
    got = {r.name: r for r in resampling.bands(s, ["a", "b", "c"]).collect()}
    assert got["a"].n == 101 and np.allclose([got["a"].mean, got["a"].lo, got["a"].hi], [50.0, 2.5, 97.5]) and got["b"].n == 100 and "c" not in got


def test_replicates_with_few_items_are_skipped(spark):
    from loomline.operators import resampling

    pairs = spark.createDataFrame([(i, i, (i + 1) % 30) for i in range(30)], "pair_index long, first long, other long")
    draws = spark.createDataFrame([(0, i) for i in range(19)] + [(1, i) for i in range(20)], "rep long, item long")
    out = resampling.drawn_pairs(pairs, draws).collect()
    assert {(r.rep, r.n_items) for r in out} == {(1, 20)} and len(out) == 19
