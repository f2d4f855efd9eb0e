import random

import numpy as np

from loomline.llm import paragraphs as P


def shingled(w):
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)}


def brute(rows, similarity=0.8):
    """Classes of lines by their words alone: (id, line, id kept, size of the class)."""
    found = []
    for i, (doc_id, text) in enumerate(rows):
        for p, line in enumerate((text or "").split("\n")):
            w = line.lower().split()
            if w:
                found.append((doc_id is None, doc_id or 0, i, p, shingled(w), doc_id))
    parent = list(range(len(found)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(found)):
        for j in range(i):
            a, b = found[i][4], found[j][4]
            if len(a & b) >= similarity * len(a | b) - 1e-9:
                parent[root(i)] = root(j)
    groups = {}
    for i, f in enumerate(found):
        groups.setdefault(root(i), []).append(f)
    return sorted(((f[5], f[3], min(g, key=lambda x: x[:2])[5], len(g)) for g in groups.values() if len(g) > 1 for f in g), key=str)


def corpus():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdef") for _ in range(5))
    passages = [[word() for _ in range(n)] for n in (30, 60, 61, 90, 40, 7)]
    rows = []
    for i in range(60):
        lines = [" ".join(word() for _ in range(r.randrange(3, 60)))]
        if i % 2:
            w = list(r.choice(passages))
            for _ in range(r.randrange(0, 3)):
                w[r.randrange(len(w))] = word()
            lines.insert(r.randrange(2), (" " if i % 3 else "\t ").join(w).upper() if i % 5 == 0 else "  ".join(w))
        rows.append((i, "\n".join(lines)))
    return rows + [(70, None), (71, ""), (None, rows[1][1]), (5, rows[5][1]), (72, "word " * 30_000), (73, "x" * 3_000_000 + "\n" + rows[1][1])]


def lines_of(got):
    return sorted(((x.doc_id, x.paragraph, x.keep_doc_id, x.class_size) for x in got if x.first_word is None), key=str)


def test_lines_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, name string")
    want = brute(rows)
    assert len({w[3] for w in want}) > 1
    for crowded in (P.CROWDED, 2):
        got = P.repeats(docs, crowded=crowded).collect()
        assert lines_of(got) == want
        mine = [x for x in got if x.first_word is None]
        assert sum(x.kept for x in mine) == len({(x.keep_doc_id, x.keep_paragraph) for x in mine})
    assert P.repeats(docs.limit(0)).count() == 0


def test_short_paragraphs_repeat_too(spark):
    nine = "one two three four five six seven eight nine"
    texts = ["Read more", f"read  MORE\n{nine}", f"{nine} ten\nread", nine[:-5], "a b c d e\nla la la la la la", "\n \nA b c d e\n" + "la " * 9, "a b c d"]
    rows = list(enumerate(texts))
    want = brute(rows)
    assert {(0, 0, 0, 2), (1, 1, 1, 3), (4, 0, 4, 2), (4, 1, 4, 2)} <= set(want)
    assert lines_of(P.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


def test_chains_of_near_copies_stay_whole_in_crowded_buckets(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    w, rows = [word() for _ in range(80)], []
    for i in range(90):  # each is near the one before, the ends are far apart
        w = list(w)
        w[(i * 7) % 80] = word()
        rows.append((i, " ".join(w)))
    want = brute(rows)
    for crowded in (400, 12):
        got = lines_of(P.repeats(spark.createDataFrame(rows, "doc_id long, text string"), crowded=crowded).collect())
        assert got == want and max(x[3] for x in got) > 60


def passages_of(rows, texts, got):
    """What must be found: places of runs of 51 words that occur twice; and found: spans by text."""
    at = {}
    for d, w in enumerate(texts):
        for i in range(len(w) - 50):
            at.setdefault(tuple(w[i : i + 51]), []).append((d, i))
    number = {i: n for n, (i, _) in enumerate(rows)}
    found = {}
    for x in got:
        if x.first_word is not None:
            found.setdefault(number[x.doc_id], []).append((x.first_word, x.first_word + x.n_words))
    return [p for places in at.values() if len({d for d, _ in places}) > 1 for p in places], found


def test_passages_repeat_across_line_breaks(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    shared = [some(n) for n in (51, 51, 55, 80, 140)]
    rows, texts = [], []
    for i in range(40):
        w = some(r.randrange(60))
        for p in r.sample(shared, i % 3):
            w += p + some(r.randrange(1, 60))
        texts.append(w)
        rows.append((i, "".join(x + r.choice([" "] * 9 + ["\n"]) for x in w)))
    rows += [(None, rows[2][1].upper()), (41, None), (42, ""), (43, "word " * 5_000)]
    texts += [texts[2], [], [], ["word"] * 5_000]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = P.repeats(docs).collect()
    want, found = passages_of(rows, texts, got)
    assert len(want) > 500
    for d, i in want:
        assert any(min(b, i + 51) - max(a, i) >= P.PASSAGE for a, b in found[d]), (d, i)
    number = {i: n for n, (i, _) in enumerate(rows)}
    for x in got:
        if x.first_word is None:
            continue
        d, k = texts[number[x.doc_id]], texts[number[x.keep_doc_id]]
        assert d[x.first_word : x.first_word + x.n_words] == k[x.keep_first_word : x.keep_first_word + x.n_words]
        before = len(" ".join([""] + d[: x.first_word]))
        assert x.doc_id is None or rows[number[x.doc_id]][1][:before].count("\n") == x.paragraph
        assert x.kept == ((x.doc_id, x.first_word) == (x.keep_doc_id, x.keep_first_word)) and x.class_size > 1
    assert not any(x.doc_id == x.keep_doc_id == 43 and 0 < abs(x.first_word - x.keep_first_word) < P.PASSAGE for x in got if x.first_word is not None)


def test_edited_passages_inside_longer_lines_are_found(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    rows = []
    for i in range(0, 120, 2):
        p = some(90)
        q = list(p)
        q[r.randrange(90)] = word()  # an exact repeat of 90 words is not left
        rows += [(i, " ".join(some(40) + p + some(40))), (i + 1, " ".join(some(25) + q + some(60)))]
    rows += [(1000 + i, " ".join(some(200))) for i in range(60)]
    got = {x.doc_id for x in P.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(i in got for i in range(120)) >= 0.97 * 120
    assert not [i for i in got if i >= 1000]


def test_bands_keep_links_at_the_threshold():
    r = np.random.default_rng(6)
    for recall, seed in ((P.LINE_RECALL, 1), (P.BLOCK_RECALL, 2)):
        mh = P.MinHash(P.SIMILARITY, recall, seed)
        assert 1 - (1 - P.SIMILARITY**mh.rows) ** mh.bands >= recall
        met = []
        for _ in range(3000):
            s = r.integers(0, 1 << 63, 50, dtype=np.uint64)
            one, two = (mh.keys(lambda a, b, x=x: np.array([(x * a + b).min()])) for x in (s[:45], np.concatenate([s[:40], s[45:]])))
            met.append(bool((one == two).any()))
        assert np.mean(met) >= recall - 0.01
    bands, rows = P.bands_of(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and 1 - (1 - 0.4**rows) ** bands <= P.LOOSE


def test_words_are_cut_as_python_cuts_them():
    for text in ("", " a  b\tC\r\nd\x0be\x0cf ", "Ä ä B", "x" * (P.SLICE + 5) + " y " + "z" * (3 * P.SLICE), ("ab " * P.SLICE)):
        data = text.encode()
        h, start = P.word_hashes(np.frombuffer(data, np.uint8))
        w = data.lower().split()
        assert len(h) == len(w) and len(set(zip(h.tolist(), w))) == len(set(w)) == len(set(h.tolist()))
        assert all(data[a : a + len(x)].lower() == x for a, x in list(zip(start.tolist(), w))[:1000])
