import random

from pyspark.sql import functions as F

from loomline.operators import graph


def regular(pairs, n, rounds):
    rows = pairs.collect()
    edges = {tuple(sorted((r.a, r.b))) for r in rows}
    assert len(edges) == len(rows) == n // 2 * rounds and all(a != b for a, b in edges)
    for k in range(rounds):
        assert len({x for r in rows if r.round == k for x in (r.a, r.b)}) == n
    assert sorted(r.pair_index for r in rows) == list(range(len(rows)))
    return rows, edges


def test_rounds_with_bands_and_preferred_edges(spark):
    r, n, rounds = random.Random(3), 60, 4
    bands = {i * 3 + 1: i % 4 for i in range(n)}  # node names have gaps
    items = spark.createDataFrame(list(bands.items()), "node long, band int")
    nodes = sorted(bands)
    wish = [(nodes[i], nodes[i + 1]) for i in range(0, 40, 2)] + [(nodes[1], nodes[2]), (nodes[5], nodes[5])]
    preferred = spark.createDataFrame(wish, "a long, b long")
    plain, _ = regular(graph.nested_pairs(items, rounds), n, rounds)
    within = sum(x.band_a == x.band_b for x in plain) / len(plain)
    full, edges = regular(graph.nested_pairs(items, rounds, 1.0, preferred), n, rounds)
    assert all(tuple(sorted(e)) in edges for e in wish if e[0] != e[1])
    free = [x for x in full if tuple(sorted((x.a, x.b))) not in {tuple(sorted(e)) for e in wish}]
    assert sum(x.band_a == x.band_b for x in free) <= 0.03 * len(free) and within > 0.12
    half, _ = regular(graph.nested_pairs(items, rounds, 0.5), n, rounds)
    assert 0 < sum(x.band_a == x.band_b for x in half) / len(half) < within
    assert all(x.score_gap == abs(x.band_a - x.band_b) and x.shown_first in (x.a, x.b) and bands[x.a] == x.band_a for x in full)
    assert 0.3 < sum(x.shown_first == x.a for x in full) / len(full) < 0.7
    again = graph.nested_pairs(items.repartition(3), rounds, 1.0, preferred)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, full))


def test_a_band_that_is_too_large_ends(spark):
    items = spark.createDataFrame([(i, 0 if i < 30 else 1) for i in range(36)], "node long, band int")
    rows, _ = regular(graph.nested_pairs(items, 2, 1.0), 36, 2)
    assert sum(x.band_a != x.band_b for x in rows) >= 8  # six nodes of the other band, two rounds


def test_preferred_edges_of_one_node_beyond_its_degree(spark):
    items = spark.createDataFrame([(i, 0) for i in range(20)], "node long, band int")
    preferred = spark.createDataFrame([(0, i) for i in range(1, 20)], "a long, b long")
    rows, edges = regular(graph.nested_pairs(items, 3, 0.0, preferred), 20, 3)
    assert sum(0 in e for e in edges) == 3


def test_avoiding_still_keeps_degrees(spark):
    p = graph.circle_pairs(spark, 30, 4)
    bad = p.filter("pair_index % 3 = 0").select("a", "b")
    rows, edges = regular(graph.avoiding(p, bad), 30, 4)
    assert not edges & {tuple(sorted((x.a, x.b))) for x in bad.collect()}
    assert graph.faults(graph.avoiding(p, bad)).count() == 0 and p.filter(F.col("a") == F.col("b")).count() == 0
