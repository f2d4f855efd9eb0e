"""Solves by the levels of a graph against dense matrices, and fits of runs that a dense matrix is too slow for."""

import math
import time
import tracemalloc

import numpy as np
import pytest

from loomline.operators import kernels
from loomline.operators.levels import Bordered, Levels, parts


def circle(n, rounds):
    r, h = np.divmod(np.arange(rounds * (n // 2)), n // 2)
    return (r + h) % (n - 1), np.where(h == 0, n - 1, (r - h) % (n - 1))


def dense(a, b, w, n, diagonal):
    k = w.shape[1]
    m = diagonal * np.eye(n * k)
    for x, y, c in zip(a, b, w, strict=True):
        i, j = x * k + np.arange(k), y * k + np.arange(k)
        if x != y:
            m[np.ix_(i, i)] += c
            m[np.ix_(j, j)] += c
            m[np.ix_(i, j)] -= c
            m[np.ix_(j, i)] -= c
    return m


@pytest.mark.parametrize(("n", "rounds", "k", "kept"), [(60, 6, 1, 1.0), (60, 3, 3, 0.4), (50, 1, 2, 0.5), (200, 4, 1, 0.9), (3, 1, 2, 1.0)])
def test_levels_solve_as_dense_matrices(n, rounds, k, kept):
    draw = np.random.default_rng(n + k)
    a, b = circle(n, rounds)
    keep = draw.random(len(a)) <= kept
    a, b = np.append(a[keep], [0, 1, 1]), np.append(b[keep], [2, 2, 1])  # repeats and a loop too
    c = draw.random((len(a), k))
    w = c[:, :, None] * c[:, None, :] + np.eye(k) * draw.random((len(a), 1, 1))
    factor, h = Levels(a, b, n, k).factor(w, 0.1), dense(a, b, w, n, 0.1)
    right = draw.normal(size=(n * k, 3))
    assert np.allclose(factor.solve(right), np.linalg.solve(h, right))
    inverse = np.linalg.inv(h)
    assert np.allclose(factor.sandwich(w), np.diag(inverse @ dense(a, b, w, n, 0.0) @ inverse))
    side, corner = draw.normal(size=(n * k, 2)), 50.0 * np.eye(2) * n
    whole = np.block([[h, side], [side.T, corner]])
    assert np.allclose(Bordered(factor, side, corner, True).solve(np.eye(n * k + 2)), np.linalg.inv(whole))
    with pytest.raises(np.linalg.LinAlgError):
        Bordered(factor, side, -corner, True)


def test_condition_by_steps_is_that_of_the_dense_matrix():
    draw = np.random.default_rng(3)
    for n, rounds in ((100, 2), (300, 6)):
        a, b = circle(n, rounds)
        w = draw.random(len(a))
        assert math.isclose(kernels.condition(a, b, w, n), kernels.connection(kernels.laplacian(a, b, w, n)), rel_tol=1e-7)
        cut = (a < n // 2) == (b < n // 2)
        assert kernels.condition(a[cut], b[cut], w[cut], n) == kernels.connection(kernels.laplacian(a[cut], b[cut], w[cut], n))


def simulated(n, rounds=6, seed=1):
    draw = np.random.default_rng(seed)
    a, b = circle(n, rounds)
    d = (s := draw.normal(size=n))[a] - s[b]
    cited = draw.random(len(a)) < kernels.sigmoid(np.abs(d) + np.log1p(np.exp(-2 * np.abs(d))) - 0.3)
    first = draw.random(len(a)) < kernels.sigmoid(d + 0.2)
    return a, b, d, cited, first


def test_a_long_run_takes_seconds_and_no_square_of_its_items():
    a, b, _, cited, first = simulated(20000)  # dense: 3.2 GB and hours
    began = time.process_time()
    s, beta = kernels.bradley_terry(np.column_stack([a, b])[cited], first[cited].astype(int), 20000)
    miss = kernels.sigmoid(s[a] - s[b] + beta)[cited] - first[cited]
    slope = np.bincount(a[cited], miss, 20000) - np.bincount(b[cited], miss, 20000) + 1e-3 * s
    assert np.abs(slope).max() < 1e-4 and abs(miss.sum()) < 1e-6
    assert time.process_time() - began < 60


def test_condition_of_many_weights_near_zero_takes_seconds():
    n = 12000
    a, b = circle(n, 6)
    w = 10.0 ** -np.random.default_rng(5).uniform(0, 24, len(a))
    began = time.process_time()
    assert kernels.condition(a, b, w, n) == math.inf
    assert time.process_time() - began < 10


def test_a_gated_fit_of_many_items_takes_few_steps_to_a_minimum():
    from loomline.operators.gated import Criterion

    a, b, _, cited, first = simulated(6000)
    c = Criterion(a, b, np.where(cited, np.where(first, 1, -1), 0), 1e-3, False)
    p, steps = c.fit(None, 0.2, 1e-8)
    assert np.abs(c.slope(p, 0.2)).max() < 1e-6 and steps < 80
    q = c.parts(p, 0.2)
    Bordered(c.levels.factor(q["dd"] - q["bend"], 1e-3), *c.border(q), True)  # positive definite: no saddle


def test_criteria_of_a_run_settle_together_with_their_position_term():
    from loomline.operators.gated import Criterion, Run

    draw, n = np.random.default_rng(4), 840
    a, b = circle(n, 6)
    a, b = (x[kept] for kept in [draw.random(len(a)) < 0.8] for x in (a, b))
    criteria, ps = [], []
    for _ in range(4):
        d = (s := draw.normal(size=n) * 4)[a] - s[b]
        x = np.where(np.abs(d) > 3, np.where((d > 0) == (draw.random(len(a)) < 0.9), 1, -1), 0)
        criteria.append(Criterion(a, b, x, 1e-3, False, criteria[0] if criteria else None))
        ps.append(criteria[-1].fit(None, criteria[-1].ahead(), 1e-2)[0])
    assert all(c.levels is criteria[0].levels for c in criteria)
    run, start = Run(criteria), np.concatenate([*ps, [0.0]])
    x, _ = run.fit(start, 1e-8)
    assert np.abs(run.slope(x)).max() < 1e-6 and run.value(x) <= run.value(start)  # scores and position term at once
    r = np.random.default_rng(1)
    assert all(run.value(x + r.normal(0, 1e-3, len(x))) >= run.value(x) for _ in range(10))
    none = Run([Criterion(a, b, np.zeros(len(a), int), 1e-3, False)])
    assert np.isfinite(none.fit(np.append(none.criteria[0].start(), 0.0), 1e-8)[0]).all()  # nothing cited


def test_linkage_of_vectors_is_that_of_their_matrix_without_it():
    import tracemalloc

    for seed in range(6):
        v = np.random.default_rng(seed).normal(size=(150, 6))
        v /= np.linalg.norm(v, axis=1)[:, None]
        for cutoff in (-2.0, 0.0, 0.3, 0.8):
            assert kernels.average_linkage_of(v, cutoff).tolist() == kernels.average_linkage(v @ v.T, cutoff).tolist()
    v = np.random.default_rng(9).normal(size=(3000, 6))
    tracemalloc.start()
    kernels.average_linkage_of(v, 5.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3000 * 3000 * 8


def test_anchors_of_a_panel_and_of_its_halves_take_no_square_of_their_items():
    n = 3000
    a, b, _, cited, first = simulated(n, 4)
    for keep in (cited & (a % 5 > 0) & (b % 5 > 0), cited & (a % 5 > 0) & (b % 5 > 0) & (np.arange(len(a)) % 2 == 0)):
        tracemalloc.start()
        kernels.bradley_terry(np.column_stack([a, b])[keep], first[keep].astype(int), n)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 8 * n * n / 3  # a third of one dense matrix


def test_a_fit_holds_the_factor_of_one_run_of_components_at_a_time():
    n, copies = 500, 60
    a, b, _, cited, first = simulated(n, 4)
    pairs, w = np.column_stack([a, b])[cited], first[cited].astype(int)
    s, beta = kernels.bradley_terry(pairs, w, n)
    many = np.concatenate([pairs + n * i for i in range(copies)])
    tracemalloc.start()
    got, same = kernels.bradley_terry(many, np.tile(w, copies), n * copies)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.abs(got.reshape(copies, n) - s).max() < 1e-7 and abs(beta - same) < 1e-7
    assert most < 700 * n * copies  # with the factor of all runs at once 1540 bytes an item


def test_runs_of_components_hold_every_node_and_edge_once():
    a, b = np.array([0, 3, 5, 5, 8, 2]), np.array([3, 9, 6, 5, 2, 7])
    for most in (1, 3, 100):
        runs = parts(a, b, 11, most)
        assert sorted(np.concatenate([x for x, _, _ in runs])) == list(range(11)) and sorted(np.concatenate([x for _, x, _ in runs])) == list(range(6))
        assert all({a[i], b[i]} <= set(nodes) for nodes, edges, _ in runs for i in edges) and len(runs) == {1: 6, 3: 4, 100: 1}[most]
        whole, right, v = np.empty(11), np.arange(11.0), np.arange(1.0, 7.0)
        for nodes, edges, levels in runs:
            whole[nodes] = levels.factor(v[edges], 0.1).solve(right[nodes])
        m = 0.1 * np.eye(11)
        for i, j, x in zip(a, b, v, strict=True):
            if i != j:
                m[[i, j], [i, j]] += x
                m[[i, j], [j, i]] -= x
        assert np.abs(m @ whole - right).max() < 1e-9


def test_newton_ends_where_rounding_of_the_value_hides_its_fall():
    noise = iter(range(10**6))
    x, steps = kernels.newton(np.array([1e-6, -2e-6]), lambda x: 1e8 + float(x @ x) / 2 + 1e-7 * next(noise), np.sinh, lambda x: np.diag(np.cosh(x)), 1e-8)
    assert steps < 4 and np.abs(x).max() < 1e-8
