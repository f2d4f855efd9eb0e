import random

from loomline.llm import mixing


def best_sum(counts, budget):
    sums = {0}
    for n, c in counts.items():
        sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= budget}
    return max(sums)


def test_fit_budget_reaches_the_best_sum():
    r = random.Random(1)
    for case in range(3000):
        top = r.choice((4, 12, 30, 90))
        counts = {r.randrange(0, top): r.randrange(0, 5) for _ in range(r.randrange(1, 6))}
        budget = r.randrange(0, 40 + 4 * top)
        took = mixing.fit_budget(counts, budget)
        assert all(k <= counts[n] for n, k in took.items())
        assert sum(n * k for n, k in took.items()) == best_sum(counts, budget), case
    assert sum(n * k for n, k in mixing.fit_budget({4: 3, 1: 3, 14: 4, 23: 3}, 68).items()) == 68
    assert sum(n * k for n, k in mixing.fit_budget({6: 90_000, 10: 70_000, 4: 5}, 600_001).items()) == 600_000


def test_fit_budget_of_many_lengths_meets_the_budget():
    r = random.Random(4)
    counts = {n: r.randrange(1, 2000) for n in r.sample(range(500, 40_000), 3000)}
    budget = sum(n * c for n, c in counts.items()) // 3 + 17
    took = mixing.fit_budget(counts, budget)
    assert all(0 < k <= counts[n] for n, k in took.items()) and sum(n * k for n, k in took.items()) == budget


def total(took):
    return sum(n * k for n, k in took.items())


def test_fit_budget_of_very_long_texts_meets_the_budget():
    r = random.Random(6)
    assert total(mixing.fit_budget({70_000_000: 1, 80_000_001: 1, 90_000_007: 1}, 150_000_001)) == 150_000_001
    for _ in range(5):
        lengths = r.sample(range(25_000_000, 35_000_000), 12)
        budget = sum(r.sample(lengths, 5))
        assert total(mixing.fit_budget(dict.fromkeys(lengths, 1), budget)) == budget
        lengths = r.sample(range(1_900_000, 2_100_000), 200)
        budget = sum(r.sample(lengths, 57))
        assert total(mixing.fit_budget(dict.fromkeys(lengths, 1), budget)) == budget
        lengths = r.sample(range(10**8, 10**10), 60)
        budget = sum(r.sample(lengths, 30))
        took = mixing.fit_budget(dict.fromkeys(lengths, 3), budget)
        assert total(took) == budget and max(took.values()) <= 3


def test_fit_budget_of_long_texts_equals_brute_force():
    r = random.Random(7)
    for case in range(300):
        top = 10 ** r.randrange(2, 8)
        counts = {r.randrange(1, top): r.randrange(1, 5) for _ in range(r.randrange(1, 6))}
        budget = r.randrange(0, sum(n * c for n, c in counts.items()) + 5)
        took = mixing.fit_budget(counts, budget, most_sums=r.choice((1, 1 << 12, mixing.MOST_SUMS)))
        assert all(k <= counts[n] for n, k in took.items()) and total(took) == best_sum(counts, budget), case


def test_rows_without_ids_do_not_share_a_slot(spark):
    docs = spark.createDataFrame([(None, "a b c", "s")] * 4000 + [(1, "x", "t")], "doc_id long, text string, source string")
    out, _ = mixing._plan(mixing._light(mixing.keyed(docs, "__row"), "doc_id", "text", "source"), (1, 2, 3), 1.0, 3, 17)
    assert out.count() == 4001
    light = mixing._light(mixing.keyed(docs, "__row"), "doc_id", "text", "source")
    pick = mixing.F.xxhash64(mixing.F.lit(17), mixing.F.coalesce(mixing.F.col("doc_id").cast("string"), mixing.F.col("row_key")))
    assert light.groupBy(mixing.F.pmod(pick, mixing.F.lit(mixing.SLOTS))).count().agg({"count": "max"}).first()[0] < 40


def test_mix_is_near_targets_and_repeatable(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.randrange(0, 40)), r.choice(["a", "b", "c", None])) for i in range(800)] + [(900, None, "d"), (None, "x y", "a"), (5, "same row", "b"), (5, "same row", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnRenamed("nothing", "x")
    a = sorted(mixing.mix(docs).drop("row_key").collect(), key=str)
    assert a == sorted(mixing.mix(docs.repartition(3)).drop("row_key").collect(), key=str)
    by = {}
    for x in a:
        assert x.taken % max(1, x.size) == 0 and 0 <= x.taken <= 3 * x.size
        t = by.setdefault(x.source, [0, x.target, x.source_size, 0])
        t[0] += x.taken
        t[3] += x.size
    assert len(a) == len(rows)
    total = sum(t[3] for t in by.values())
    assert abs(sum(t[1] for t in by.values()) - total) < 1e-6 * total
    for took, target, size, sizes in by.values():
        assert size == sizes and target <= 3 * size + 1e-6 and abs(took - target) <= 1


def test_targets_reshare_the_excess(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 500), (None, 90), ("e", 0)], "source string, source_size long")
    got = {x.source: x.target for x in mixing.targets(sizes, (1, 2, 3), 1.0, 3).collect()}
    # weights a 1, b 2, c 3, e 1, null 2; b stops at 30, null at 270, e at 0; the rest goes 1 to 3
    assert got["b"] == 30 and got[None] == 270 and got["e"] == 0
    assert abs(got["a"] - 1300 / 4) < 1e-9 and abs(got["c"] - 1300 * 3 / 4) < 1e-9


def test_mix_of_nothing_and_clashing_names(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0
    docs = spark.createDataFrame([(1, "a b c", "s", 5), (2, None, None, 6)], "doc_id long, text string, source string, size int")
    out = mixing.mixed(docs)
    assert sorted(out.columns) == ["doc_id", "repeats", "size", "source", "taken", "text"]
    assert [(x.doc_id, x.taken, x.repeats) for x in out.collect()] == [(1, 3, 1)]


def test_mixed_keeps_columns_of_any_name(spark):
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 3}", f"KEEP{i}", i, i + 1, i + 2, f"d{i}", i + 3) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, skey string, __epochs int, __row int, more int, doc string, epochs int")
    out = mixing.mixed(docs)
    assert out.columns == [*docs.columns, "size", "taken", "repeats"]
    for x in out.collect():
        assert tuple(x)[:9] == rows[x.doc_id] and x.taken == x["size"] * x.repeats > 0
    plain = mixing.mixed(docs.select("doc_id", "text", "source")).select("doc_id", "taken")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, out.select("doc_id", "taken").collect()))
