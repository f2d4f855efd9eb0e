import math
import random
import re

from loomline.llm import lexical
from loomline.llm.slices import slices

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(items, docs, k):
    columns = [(i, terms(t)) for i, t in docs]
    columns = [(i, t) for i, t in columns if t]
    n_docs, n_terms = len(columns), sum(len(t) for _, t in columns)
    df = {}
    for _, ts in columns:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        found = []
        for i, ts in columns:
            m = 75 + 25 * len(ts) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * ts.count(t) // (1000 * ts.count(t) + 12 * m)) for t in terms(text) if t in df)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def made(seed, n):
    r = random.Random(seed)
    words = ["the", "The", "of", "Élan", "x1", "naïve", "zebra", "quick", "fox", "jump", "日本", "e-mail", "don't", "_a_b_", "ß", "É"]
    return [(i, r.choice([" ", "\n", ", ", "\x00"]).join(r.choice(words[: r.choice((4, 16))]) for _ in range(r.randrange(0, 25)))) for i in range(n)]


def test_search_equals_brute_force(spark):
    docs = made(1, 400) + [(None, "fox fox"), (None, "fox fox"), (7000, None), (7001, ""), (7002, "fox fox"), (3, "fox fox")] + [(8000 + i, "the same zebra") for i in range(40)]
    items = made(2, 12) + [(None, "zebra"), (5, "fox zebra the the"), (5, "fox zebra the the"), (90, None), (91, "nothing known"), (92, "zebra " * 50 + "fox")]
    want = brute(items, docs, 20)
    a = spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", "1 as term", "2 as rank")
    b = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'s' as score", "3 as n").repartition(5)
    for block in (lexical.BLOCK, 10):  # one block of items, then many
        out = lexical.search(a, b, block=block)
        assert out.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(x) for x in out.collect()), key=str) == want


def test_search_in_small_batches_and_string_ids(spark):
    docs = [(f"d{i % 30:02}", t) for i, t in made(4, 300)]
    df = spark.createDataFrame(docs, "doc_id string, text string").repartition(3)
    items = made(5, 6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted((tuple(x) for x in lexical.search(spark.createDataFrame(items, "item_id long, text string"), df, k=5).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for item, text in items:
        scored = sorted(((-s, d) for _, _, d, s in brute([(item, text)], docs, 10**6)))
        want += [(item, k + 1, d, -s) for k, (s, d) in enumerate(scored[:5])]
    assert got == sorted(want, key=str)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "fox")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "fox")], "item_id long, text string")
    assert lexical.search(items, none).count() == 0 and lexical.search(items.filter("false"), some).count() == 0
    assert lexical.search(items, some).count() == 1


def test_slices_keep_words_and_blanks():
    r = random.Random(3)
    for _ in range(500):
        data = b"".join(r.choice([b" ", b"   ", b"ab", b"c" * 20]) for _ in range(r.randrange(0, 40)))
        parts = list(slices(data, r.randrange(1, 30)))
        assert b"".join(parts) == data
        assert all(p.startswith(b" ") and not q.endswith(b" ") for q, p in zip(parts, parts[1:]))
