import random

import numpy as np
import pyarrow as pa
import pytest

from loomline.operators import components
from loomline.operators.components import connected_components, contracted, labels
from loomline.operators.skew import hot_safe_join


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_match_union_find(spark):
    r = random.Random(3)
    cases = [
        [(i, i + 1) for i in range(40)],
        [(0, i) for i in range(1, 60)] + [(100, 101), (101, 100), (5, 5)],
        [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(None, 3), (4, None)],
    ]
    for edges in cases:
        for contract in (True, False):
            got = connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(7), contract=contract).collect()
            assert {x.node: x.component for x in got} == brute(edges)
            assert len(got) == len(brute(edges))


def test_labels_and_contraction_match_union_find():
    r = random.Random(4)
    for n in (1, 5, 60, 400):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(n)] + [(i, i + 1) for i in range(0, n, 3)]
        want = brute(edges)
        low = labels(*map(np.array, zip(*edges, strict=True)), n + 1)
        assert all(want.get(a, a) == b for a, b in enumerate(low.tolist()))
        for kind in (int, "n{:04}".format):
            star = contracted(pa.array([kind(a) for a, _ in edges]), pa.array([kind(b) for _, b in edges]))
            assert {(x["u"], x["v"]) for x in star.to_pylist()} == {(kind(a), kind(b)) for a, b in want.items() if a != b}


@pytest.mark.parametrize("buffer", [1, 400, 1 << 25])
def test_contraction_in_small_buffers_keeps_components(buffer, monkeypatch):
    r = random.Random(5)
    monkeypatch.setattr(components, "BUFFER", buffer)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(400)]
    batches = [pa.RecordBatch.from_arrays([pa.array([max(e) for e in part]), pa.array([min(e) for e in part])], ["u", "v"]) for part in (edges[:150], edges[150:160], [], edges[160:]) if part]
    got = [(x["u"], x["v"]) for b in components._contract(iter(batches)) for x in b.to_pylist()]
    assert brute(got) == brute(edges) and len(got) <= len(edges)


def test_components_of_nothing_and_of_strings(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    for contract in (True, False):
        got = connected_components(spark.createDataFrame([("b", "a"), ("c", "b")], "src string, dst string"), contract=contract).collect()
        assert {x.node: x.component for x in got} == {"a": "a", "b": "a", "c": "a"}


def test_hot_safe_join_equals_a_join(spark):
    left = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(300)] + [(999, None)], "i long, k long")
    right = left.filter("k is not null").groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k * 10 as v").filter("k <> 9")
    for how in ("left", "inner"):
        want = sorted(map(tuple, left.join(right.drop("n"), "k", how).select("i", "v").collect()), key=str)
        got = sorted(map(tuple, hot_safe_join(left, right, ["k"], "n", 10, how).select("i", "v").collect()), key=str)
        assert got == want
