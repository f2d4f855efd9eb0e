import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loomline.llm import language_model
from loomline.llm.elias_fano import EliasFano, NgramTrie


def test_sequences_and_trie_match_brute_force():
    r = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 10**12), (10, 3), (1000, 10), (1000, 10**6), (3000, 2**40)):
        v = np.sort(r.integers(0, top, n))
        e = EliasFano.of(v)
        assert (e.access(np.arange(n)) == v).all()
        x = np.concatenate([r.integers(0, top + 5, 300), v, v + 1])
        assert (e.successor(x) == np.searchsorted(v, x)).all()
    text = r.integers(0, 30, 2000).tolist()
    levels, place = [], {(): 0}
    for k in (1, 2, 3):
        grams = sorted({tuple(text[i : i + k]) for i in range(len(text) - k + 1)}, key=lambda g: (place[g[:-1]], g[-1]))
        levels.append((np.array([place[g[:-1]] for g in grams]), np.array([g[-1] for g in grams]), r.random(len(grams))))
        place = {g: i for i, g in enumerate(grams)}
    trie = NgramTrie.mapped(b"".join(NgramTrie.build(levels).to_bytes()))
    asked = r.integers(0, 32, (3000, 3))
    at = np.zeros(len(asked), np.int64)
    for k in range(3):
        at = trie.child(k, at, asked[:, k])
    assert at.tolist() == [place.get(tuple(g), -1) for g in asked.tolist()]
    assert np.abs(trie.value(2, np.arange(len(place))) - levels[2][2]).max() <= 1 / 256


def brute(rows, train, mass):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]
    c, pair, context = Counter(), Counter(), Counter()
    for i, t in rows:
        if train(i):
            p = "\t"
            for w in words(t):
                c[w] += 1
                pair[p, w] += 1
                context[p] += 1
                p = w
    total = c.total()
    out = []
    for i, t in rows:
        base = score = 0.0
        p = "\t"
        for w in words(t):
            p1 = (c[w] + 1) / (total + len(c) + 1)
            base += math.log10(p1)
            score += math.log10((pair[p, w] + mass * p1) / (context[p] + mass)) if context[p] else math.log10(p1)
            p = w
        out.append((i, not train(i), len(words(t)), sum(c[w] > 0 for w in words(t)), total, base, score))
    return out


def leave_one_out(rows, train):
    """Log likelihood of the training bigrams for each mass, each bigram left out of the counts that predict it."""
    c, pair, context = Counter(), Counter(), Counter()
    for i, t in rows:
        if train(i):
            w = ["\t", *(t or "").lower().split(), "\n"]
            c.update(w[1:])
            pair.update(zip(w, w[1:], strict=False))
            context.update(w[:-1])
    p1 = {w: (n + 1) / (c.total() + len(c) + 1) for w, n in c.items()}
    return np.array([sum(n * math.log((n - 1 + m * p1[w]) / (context[v] - 1 + m)) for (v, w), n in pair.items()) for m in language_model.GRID])


def test_scores_match_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{int(x)}" for x in np.minimum(r.zipf(1.5, 60), 200))) for i in range(120)] + [(200, None), (201, ""), (202, "W1 w2\tNeu\nw1"), (None, "w1 w2"), (3, "w1 w1 w1")]
    docs = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, chunk string").coalesce(1)
    train = lambda i: i is not None and i % 7 != 2
    # in small chunks, a chunk's likelihood goes by its own counts
    for tokens, shards in ((1 << 20, 3), (500, 8)):
        curve, part, size = np.zeros(len(language_model.GRID)), [], 0
        for x in [*rows, None]:
            if x is not None:
                part.append(x)
                size += len((x[1] or "").split()) + 1
            if part and (x is None or size >= tokens):
                curve += leave_one_out(part, train)
                part, size = [], 0
        mass = language_model.GRID[int(np.argmax(curve))]
        got = language_model.language_scores(docs, F.col("doc_id") % 7 != 2, chunk_tokens=tokens, n_shards=shards).collect()
        best = brute(rows, train, mass)
        key = lambda x: (str(x[0]), x[2], x[5])
        for g, w in zip(sorted(got, key=key), sorted(best, key=key), strict=True):
            assert tuple(g)[:5] == w[:5]
            assert abs(g.base_score - w[5]) < 1e-6 and abs(g.score - w[6]) < 0.02 * w[2]


def test_scores_without_rows_or_training(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert language_model.language_scores(docs.limit(0), F.lit(True)).count() == 0
    got = language_model.language_scores(docs, F.lit(False)).collect()
    assert sorted((x.doc_id, x.n_tokens, x.n_known, x.train_tokens, x.base_score) for x in got) == [(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)]
