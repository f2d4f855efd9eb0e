import hashlib
import random
import re

import xxhash

from loomline.llm import exact_dedup, simhash

ROWS = [
    (1, "a  b", "x"), (2, "ab", "y"), (3, "", None), (4, None, "z"), (5, " \t\n", "q"), (6, "Ab", None), (None, "a b ", "n"), (2, "ab", "y"),
    (7, "x" * 70_000 + " end", "long"), (8, "x" * 70_000 + " end", "long"), (9, "x" * 70_000 + " other", "long"), (10, "a b", "nbsp"),
]
SCHEMA = "doc_id long, text string, n string"


def brute_exact(rows):
    groups = {}
    for i, (doc_id, text, _) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, i))
    out = []
    for norm, g in groups.items():
        g.sort()
        keep = rows[g[0][3]][0]
        ids = [rows[x[3]][0] for x in g]
        out += [(i, keep, len(g), hashlib.sha256(norm.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def test_exact_groups_match_brute_force(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for hash_all in (True, False):
        rows = exact_dedup.exact_groups(docs, hash_all=hash_all).collect()
        want = brute_exact(ROWS)
        assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in rows), key=str) == sorted((w[:3] for w in want), key=str)
        assert sum(r.kept for r in rows) == len({w[3] for w in want})
        if hash_all:
            assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str) == want
        else:
            digest = {str(w[0]) + str(w[1]): w[3] for w in want}
            assert all(r.text_sha256 == digest[str(r.doc_id) + str(r.keep_id)] for r in rows if r.group_size > 1)
            assert all(r.text_sha256 in (None, digest[str(r.doc_id) + str(r.keep_id)]) for r in rows)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.n) for r in kept.collect()) == sorted([(1, "a  b", "x"), (5, " \t\n", "q"), (6, "Ab", None), *ROWS[8:9], *ROWS[10:12]])


def test_exact_groups_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_match_brute_force():
    for text in (None, "", " \n", "One", "one TWO", "a b c", "Ä ä b c d e", "x y z " * 50, "a b c d e f"):
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_are_all_pairs_within_two_bits(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(12)]
    prints = set(base) | {0}
    for b in base:
        for _ in range(12):
            x = b
            for _ in range(r.randrange(1, 4)):
                x ^= 1 << r.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    want = {frozenset((signed(a), signed(b))) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 2}
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    for big in (simhash.BIG, 4, 0):
        assert {frozenset((x.src, x.dst)) for x in simhash.links(df, big).collect()} == want


def test_near_duplicates_keep_one_of_each_component(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(3, text, "a"), (1, text + " w1", "b"), (None, text, "c"), (3, text, "a"), (4, "something else entirely here", None), (5, None, "e"), (6, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    prints = [brute_fingerprint(t) for _, t, _ in rows]
    assert len(got) == len(rows)
    assert {(x.doc_id, x.fp) for x in got} == {(r[0], signed(p)) for r, p in zip(rows, prints, strict=True)}
    near = (prints[0] ^ prints[1]).bit_count() <= 2
    assert {x.component_id for x in got if x.doc_id == 3} == {1 if near else 3}
    assert {x.component_id for x in got if x.doc_id in (5, 6)} == {5}
    kept = simhash.keep_one(docs).collect()
    assert len(kept) == len({x.component_id for x in got})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
