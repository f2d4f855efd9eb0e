import random
import re
from collections import Counter

import pyarrow as pa

from loomline.llm import collocations
from loomline.llm.slices import slices


def brute(rows, max_words, least, keep, share, scale):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, max_words + 1):
                for i in range(len(w) - size + 1):
                    key = lang, tuple(w[i : i + size])
                    f[key] = f.get(key, 0) + 1
    found = {}
    good = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, p), a in good.items():
        inside = any(g == lang and len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), b in good.items())
        if not inside:
            cuts = [(scale * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
            score, _, x, y = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), x, y))
    return sorted((lang, i + 1, s[2].decode(), -s[1], s[3], s[4], n[lang], -s[0]) for lang, all_ in found.items() for i, s in enumerate(sorted(all_)[:keep]))


def made(seed, n):
    r = random.Random(seed)
    fixed = ["new york", "New York city", "as well as", "in the end of", "ça va bien", "a a a a a", "x\x01y \xff z"]
    plain = ["a", "b", "the", "York", "new", "é", "日本", "q1", "-"]
    return [(r.choice(["en", "en", "fr", None]), "".join(r.choice(fixed if r.random() < 0.4 else plain) + r.choice([" ", " ", " ", "\t", ". ", ",", "\n", "  ", "!?"]) for _ in range(r.randrange(0, 30)))) for _ in range(n)]


def test_collocations_equal_brute_force(spark):
    rows = made(1, 400) + [("en", None), (None, ""), ("en", "a b c"), ("und", "new york city " * 9)]
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("lang", "text", "1 as phrase", "2 as a").repartition(3)
    for least, keep, max_words in ((5, 2000, 4), (12, 7, 4), (5, 2000, 3), (8, 50, 5)):
        want = brute(rows, max_words, least, keep, 80, 2_000_000)
        assert len(want) > 20 or keep < 20
        for prune in (True, False):
            out = collocations.collocations(docs, max_words, least, keep, prune=prune)
            assert sorted(tuple(x) for x in out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == want


def test_slices_and_renumbering_lose_no_phrase(spark, monkeypatch):
    text = " ".join(f"w{i % 700} new york, then" for i in range(3000))
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array([text, text])], ["lang", "text"])
    whole = Counter()
    for piece in "\n".join([text, text]).replace("\n", ",").split(","):
        w = piece.split()
        whole.update(" ".join(w[i : i + 3]) for i in range(len(w) - 2))
    monkeypatch.setattr(collocations, "MOST_NUMBERED", 50)
    monkeypatch.setattr(collocations, "slices", lambda data: slices(data, 500))
    got = Counter()
    for out in collocations._phrases(3, 0, None)(iter([batch])):
        for p, a in zip(out.column(1).to_pylist(), out.column(2).to_pylist(), strict=True):
            got[p] += a
    assert got == whole


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    rows = made(2, 150)
    docs = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(collocations, "MOST_BITS", 64)  # as if there were far too many frequent phrases
    out = collocations.collocations(docs, 4, 5).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(tuple(x) for x in out.collect()) == brute(rows, 4, 5, 2000, 80, 2_000_000)


def test_large_counts_are_exact(spark):
    big = 3 * 10**15
    score = spark.sql(f"select (cast({big}L as decimal(20, 0)) * cast(2000000 as decimal(10, 0))) div (cast({big + 7}L as decimal(20, 0)) + {big}L) as s").first().s
    assert score == 2_000_000 * big // (2 * big + 7)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", None), (None, " ,. ")], "lang string, text string"), least=1).count() == 0


def test_a_task_gives_back_bounded_batches_and_reads_texts_in_runs(monkeypatch):
    texts = [" ".join(f"w{i * j % 37}" for j in range(200)) for i in range(1, 40)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], ["lang", "text"])

    def found():
        out = {}
        sizes = []
        for b in collocations._phrases(3, 0, None)(iter([batch])):
            sizes.append(len(b))
            for phrase, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                out[phrase] = out.get(phrase, 0) + a
        return out, max(sizes)

    whole, _ = found()
    monkeypatch.setattr(collocations, "MOST_ROWS", 100)
    monkeypatch.setattr(collocations, "MOST_BYTES", 2000)
    parts, largest = found()
    assert parts == whole and largest <= 100 and sum(whole.values()) == 39 * 198
