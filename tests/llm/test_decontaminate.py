import random
import re

import numpy as np
import pyarrow as pa

from loomline.llm import decontaminate
from loomline.llm.fm_index import FMIndex, suffix_ranks


def test_suffix_order_and_search_match_brute_force():
    r = np.random.default_rng(0)
    for sigma, n in ((2, 60), (4, 300), (30, 500)):
        text = r.integers(0, sigma, n)
        text[-1] = 0
        z = np.cumsum(text == 0)
        keyed = [(0, int(z[i])) if c == 0 else (1, int(c)) for i, c in enumerate(text)]
        order = sorted(range(n), key=lambda i: keyed[i:])
        assert np.argsort(suffix_ranks(text)).tolist() == order
        index = FMIndex(text, sigma, 4)
        for k in (1, 2, 3):
            patterns = r.integers(1, sigma, (40, k)) if sigma > 2 else np.ones((1, k), int)
            which, lo, hi = index.ranges(patterns)
            found = {int(i): sorted(index.locate(np.arange(a, b)).tolist()) for i, a, b in zip(which, lo, hi, strict=True)}
            for i, p in enumerate(patterns):
                want = [j for j in range(n - k + 1) if (text[j : j + k] == p).all()]
                assert found.get(i, []) == want


def brute(docs, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for item, t in items:
            v = words(t)
            k = min(window, len(v))
            grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
            for i in range(len(w) - k + 1 if k else 0):
                if tuple(w[i : i + k]) in grams:
                    hit |= set(range(i, i + k))
                    names.add(item)
        out.append((doc_id, len(w), len(hit), sorted(str(x) for x in names if x is not None)))
    return sorted(out, key=str)


def test_contamination_matches_brute_force(spark):
    r = random.Random(4)
    word = lambda: r.choice("abcdefgh")
    items = [(i, " ".join(word() for _ in range(r.choice([2, 5, 13, 20, 30])))) for i in range(12)] + [(50, ""), (51, None), (None, "ü É x9 a"), (3, "b b a")]
    docs = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(r.randrange(0, 25))) for _ in range(3)]
        if i % 3 == 0:
            parts.insert(1, r.choice(items)[1] or "")
        docs.append((i, ",".join(parts).upper() if i % 2 else "\n".join(parts)))
    docs += [(100, None), (101, ""), (None, items[2][1]), (7, docs[7][1]), (102, "Ü É X9 A.")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for block, whole in ((decontaminate.BLOCK_BYTES, False), (decontaminate.BLOCK_BYTES, True), (100, False)):
        got = decontaminate.contamination(d, b, block_bytes=block, whole=whole).collect()
        assert sorted(((x.doc_id, x.n_words, x.n_hit, list(x.item_ids)) for x in got), key=str) == want
        assert all(x.n_hit == sum(s.end - s.start for s in x.spans) for x in got)
    kept = decontaminate.drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert kept.count() == sum(not (w[2] > 0 and 20 * w[2] >= w[1]) for w in want)


def test_contamination_of_nothing(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [x.n_hit for x in decontaminate.contamination(d, b).collect()] == [0]
    assert decontaminate.contamination(d.limit(0), b).count() == 0


def test_shards_end_between_documents(monkeypatch):
    r = random.Random(8)
    rows = [(str(i), " ".join(r.choice("abcd") for _ in range(14))) for i in range(4)]
    docs = [" ".join(r.choice("abcdz") for _ in range(r.randrange(0, 60))) + " " + r.choice(rows)[1] for _ in range(40)]
    p = decontaminate.phrases(rows)

    class Shared:
        value = p

    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(docs)], ["doc_id", "__text"])

    def found():
        out = [b for b in decontaminate._search(Shared, ["doc_id"])(iter([batch.slice(0, 7), batch.slice(7)]))]
        return len(out), [x for b in out for x in b.to_pylist()]

    one, want = found()
    for name in ("SHARD_INDEXED", "SHARD_READ"):
        monkeypatch.setattr(decontaminate, name, 100)
        n, got = found()
        assert n > one == 1 and got == want
