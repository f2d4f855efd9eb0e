import math

import numpy as np

from loomline.operators import graph, spectrum


def test_ends_equal_the_dense_eigenvalues(spark):
    r = np.random.default_rng(4)
    rows = [("ring", i, (i + 1) % 9, 1.0) for i in range(9)] + [("two", 0, 1, 1.0), ("two", 2, 3, 2.0)]
    rows += [("some", int(a), int(b), float(r.random() + 0.1)) for a, b in (sorted(r.choice(14, 2, replace=False)) for _ in range(40))]
    got = {x.graph: x for x in spectrum.laplacian_ends(spark.createDataFrame(rows, "graph string, a long, b long, w double")).collect()}
    for g in ("ring", "two", "some"):
        own = [x[1:] for x in rows if x[0] == g]
        m = np.zeros((14, 14))
        for a, b, w in own:
            m[[a, b], [a, b]] += w
            m[[a, b], [b, a]] -= w
        used = sorted({x for a, b, _ in own for x in (a, b)})
        ev = np.linalg.eigvalsh(m[np.ix_(used, used)])
        x = got[g]
        assert x.n_nodes == len(used) and abs(x.lambda_2 - max(ev[1], 0)) < 1e-6 and abs(x.lambda_max - ev[-1]) < 1e-6
        assert x.kappa == math.inf if g == "two" else abs(x.kappa - ev[-1] / ev[1]) < 1e-4


def test_budgets_of_nested_pairs(spark):
    items = spark.createDataFrame([(i, 0) for i in range(16)], "node long, band int")
    p = graph.nested_pairs(items, 3).collect()
    rows = [(b, x.a, x.b, 1.0) for b in (16, 24) for x in p if x.pair_index < b]
    got = {x.graph: x.lambda_2 for x in spectrum.laplacian_ends(spark.createDataFrame(rows, "graph int, a long, b long, w double")).collect()}
    for b in got:
        m = np.zeros((16, 16))
        for g, i, j, _ in rows:
            if g == b:
                m[[i, j], [i, j]] += 1
                m[[i, j], [j, i]] -= 1
        assert abs(got[b] - max(0.0, np.linalg.eigvalsh(m)[1])) < 1e-6
    assert spectrum.laplacian_ends(spark.createDataFrame([], "graph int, a long, b long, w double")).count() == 0


def test_nested_graphs_share_the_rows_of_nodes_and_edges(spark, monkeypatch):
    rows, kept, count = [(g, i, (i + 1) % 7, 1.0 + g) for g in range(10) for i in range(6 + g % 2)], {}, spectrum.written
    monkeypatch.setattr(spectrum, "written", lambda df, tag: kept.setdefault(tag, count(df, tag)))
    got = {x.graph: x for x in spectrum.laplacian_ends(spark.createDataFrame(rows, "graph int, a long, b long, w double")).collect()}
    assert kept["spectrum-edges"].count() == 2 * 2 * 7 and kept["spectrum-start"].count() == 2 * 7  # two parts of 8 and 2 graphs
    for g in range(10):
        angle = 2 * math.pi / 7 if g % 2 else math.pi / 7  # a ring, a path
        assert abs(got[g].lambda_2 - (1 + g) * (2 - 2 * math.cos(angle))) < 1e-6 and got[g].n_nodes == 7
