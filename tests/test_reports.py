import json
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from loomline.operators import calibration, graph, matched_k, order, panels, recovery, requests


def test_normal_quantiles(spark):
    ps = [1e-9, 1e-4, 0.01, 0.05, 0.2, 0.5, 0.77, 0.999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    for r in df.select("p", F.expr(panels.normal_upper("p")).alias("z")).collect():
        assert abs(r.z + NormalDist().inv_cdf(r.p)) < 1e-9


def test_cells_of_different_graphs_do_not_join(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "graph string, item int")
    with pytest.raises(ValueError):
        panels.same_graph(df)
    assert panels.same_graph(df.filter("graph = 'a'")).count() == 1


def test_ledger_ids_are_unique(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "id string, value int")
    with pytest.raises(ValueError, match="x"):
        requests.ledger(df)
    assert requests.ledger(df.filter("value > 1")).count() == 2


def test_backoff_tries_again_on_named_errors_only():
    waits, calls = [], []

    def call(fail, text):
        calls.append(1)
        if len(calls) <= fail:
            raise RuntimeError(text)
        return "done"

    assert requests.with_backoff(call, 3, "Rate limit hit", sleep=waits.append) == "done" and waits == [3.0, 6.0, 12.0]
    calls.clear()
    with pytest.raises(RuntimeError):
        requests.with_backoff(call, 1, "bad request", sleep=waits.append)
    calls.clear()
    with pytest.raises(RuntimeError):
        requests.with_backoff(call, 9, "timeout", sleep=waits.append)
    assert len(calls) == 5


def test_schemas_are_ordered_and_open():
    s = {"name": "n", "schema": {"type": "object", "properties": {"b": {"type": "string", "maxLength": 3}, "a": {"type": "array", "items": {"type": "object", "properties": {"z": {}, "y": {}}, "additionalProperties": False}}}, "additionalProperties": False}}
    out = requests.ordered_schema(s)
    assert out["propertyOrdering"] == ["b", "a"] and out["properties"]["a"]["items"]["propertyOrdering"] == ["z", "y"]
    assert "additionalProperties" not in json.dumps(out) and out["properties"]["b"] == {"type": "string", "maxLength": 3}


def leaves(x):
    if isinstance(x, dict | list):
        return [y for v in (x.values() if isinstance(x, dict) else x) for y in leaves(v)]
    return [x]


def test_bodies_are_json_and_leave_out_what_is_not_given(spark):
    df = spark.createDataFrame([("gpt-4", 'say "hi"\n\u00e9'), ("new", None)], "m string, t string")
    schema = {"name": "v", "schema": {"type": "object", "properties": {}}}
    for kind in ("chat", "responses", "messages", "generate", "tool_chat"):
        for full in (False, True):
            more = {"seed": 1, "schema": schema, "effort": "low", "thinking": "off"} if full else {}
            for r in df.select("m", "t", requests.body(kind, F.col("m"), F.lit("s"), F.col("t"), 5, **more).alias("b")).collect():
                b = json.loads(r.b)
                assert b["model"] == r.m and (r.t or "") in leaves(b) and None not in leaves(b)
                if kind == "chat":
                    assert ("max_tokens" in b) == (r.m == "gpt-4") and ("seed" in b) == (full and r.m == "gpt-4")
                if kind == "messages":
                    assert ("tool_choice" in b) == full
    with pytest.raises(ValueError):
        requests.body("other", F.col("m"), F.col("m"), F.col("t"), 5)


def test_average_ranks_over_ranges(spark):
    rows = [(f, float(x)) for f in "ab" for x in [1, 1, 2, 5, 5, 5, 7] + [9] * 100 + list(range(10, 60))]
    got = {(r.f, r.x): r["rank"] for r in order.average_ranks(spark.createDataFrame(rows, "f string, x double").repartition(5), ["f"], "x").collect()}
    for f in "ab":
        xs = sorted(x for g, x in rows if g == f)
        for x in set(xs):
            at = [i + 1 for i, y in enumerate(xs) if y == x]
            assert got[f, x] == sum(at) / len(at)


def test_forbidden_edges_are_swapped_away(spark):
    p = graph.circle_pairs(spark, 40, 6)
    barred = spark.createDataFrame([(r.b, r.a) for r in p.filter("pair_index % 5 = 0").collect()] + [(0, 0)], "a long, b long")
    got = [(r["round"], r.a, r.b) for r in graph.avoiding(p, barred).collect()]
    edges = {frozenset(e[1:]) for e in got}
    assert len(edges) == len(got) == 120 and not edges & {frozenset((r.a, r.b)) for r in barred.collect()}
    for k in range(6):
        assert sorted(x for r, a, b in got if r == k for x in (a, b)) == list(range(40))


def test_calibration_of_masked_cells_is_that_of_the_cells_left(spark):
    rows = [(t, k, ((t * 7 + k) % 20 + 0.5) / 20.5, float((t + k) % 2), 0.5, int(t % 4 > 0)) for t in range(60) for k in range(2)]
    c = spark.createDataFrame(rows, "t int, k int, p double, y double, pr double, m int")
    point = calibration.calibration_intervals(c.filter("m = 1"), ["k"], "t", 5).collect()
    for r in point:
        mine = [x for x in rows if x[1] == r.k and x[5]]
        assert r.n == len(mine) and abs(r.brier - sum((x[2] - x[3]) ** 2 for x in mine) / len(mine)) < 1e-12
        assert abs(r.bss_chance - (1 - r.brier / 0.25)) < 1e-12 and r.ece_lo <= r.ece_hi


def test_scorecard_of_features_that_are_the_dials(spark):
    names = ["a", "b", "c"]
    r = spark.createDataFrame([(f, g, 1.0 if f == g else 0.1) for f in names for g in names], "f string, g string, r double")
    m = spark.createDataFrame([(g, g, 0.9) for g in names], "g string, f string, cos double")
    (one,) = recovery.scorecard(r, m, [0.4]).collect()
    assert (one.k, one.n_tracked, one.sf, one.sr, one.af) == (3, 3, 1.0, 1.0, 1.0) and abs(one.lk - 0.1) < 1e-12
    none = recovery.scorecard(r.withColumn("r", F.lit(0.0)), m, [0.4]).collect()[0]
    assert none.lk is None and none.af == 0


def test_equal_panels_differ_by_nothing(spark):
    rows = [(arm, k, s, p, (p + s + k) % 2) for arm in "ab" for k in (1, 2) for s in range(2) for p in range(30)]
    c = spark.createDataFrame(rows, "arm string, k int, subset long, pair long, ok int")
    panels_ = spark.createDataFrame([(arm, k, True, 2) for arm in "ab" for k in (1, 2)], "arm string, k int, exact boolean, n_subsets long")
    by_k, d = matched_k.curves(c, panels_, "a", "b", 30, 10)
    assert all(abs(r.d) < 1e-12 for r in d.collect()) and {r.delta for r in by_k.collect()} == {0.0}
    assert matched_k.summary(by_k, d).first().p == 1.0
