import re

import pytest
from pyspark.sql import functions as F

from loomline.functions import judgments as J
from loomline.functions import numeric as N
from loomline.functions import text as T


def one(spark, rows, *cols):
    return [tuple(r) for r in spark.createDataFrame([(r,) for r in rows], "t string").select(*cols).collect()]


def test_phrases_are_normalised(spark):
    want = {"The a More coherent argument": "coherent argument", "the": "the", None: "", "more  effective\tuse": "effective use", " A  clear thesis. ": "clear thesis."}
    got = one(spark, list(want), "t", T.normalise_phrase(F.col("t")))
    assert dict(got) == want


def test_words_split_at_unicode_blanks(spark):
    rows = ["", None, "  a b ", "x y\nz", "one"]
    got = one(spark, rows, "t", T.n_words(F.col("t")), T.truncated(F.col("t"), 2))
    assert [(t, n, h) for t, n, h in got] == [(t, len((t or "").split()), " ".join((t or "").split()[:2])) for t in rows]


def chunks(text, max_words=60, max_chunks=64):
    out, now = [], []
    for s in re.split(r"(?<=[.!?])\s+|\n+", text or ""):
        w = s.split()
        for piece in [w[i : i + max_words] for i in range(0, len(w), max_words)]:
            if now and len(now) + len(piece) > max_words:
                out.append(" ".join(now))
                now = []
            now += piece
    return (out + [" ".join(now)] * bool(now))[:max_chunks] or ["."]


def test_sentences_are_packed_as_by_a_loop(spark):
    rows = ["", None, "a b. c d e! f\n\ng", "w " * 150 + ". x y.", "One. " * 200, "no end"]
    assert one(spark, rows, T.sentence_chunks(F.col("t"))) == [(chunks(t),) for t in rows]
    assert one(spark, rows, T.sentence_chunks(F.col("t"), 3, 4)) == [(chunks(t, 3, 4),) for t in rows]


def test_quarters_overlap_and_markers(spark):
    got = one(spark, ["a b c", "a b c d e f g h i", ""], T.quarter_texts(F.col("t")))
    assert [g[0] for g in got] == [["a b c"] * 4, ["a b", "c d", "e f", "g h i"], ["."] * 4]
    row = spark.sql("select array('a','b','the') a, array('b','the','x') o, array() e")
    r = row.select(T.overlap(F.col("a"), F.col("o")), T.overlap(F.col("a"), F.col("e").cast("array<string>"))).first()
    assert r[0] == [2.0, 2 / 3, 2 / 3, 0.5] and r[1] == [0.0, 0.0, 0.0, 0.0]
    blob = T.item_blob(F.lit("t"), F.lit("b"), F.col("t"))
    assert one(spark, ["x [CHALLENGE]"], T.blob_challenge(blob)) == [("x [CHALLENGE]",)]
    with pytest.raises(Exception, match="no challenge marker"):
        one(spark, ["nothing"], T.blob_challenge(F.col("t")))


def test_posts_are_deidentified(spark):
    t = "CMV: I think so\n_____\n> Hello, users of CMV! Happy CMVing!* See [it](http://x) at https://y/z in r/topic, a delta!"
    got = one(spark, [t], T.deidentified(F.col("t")))[0][0]
    assert "CMV" not in got and "http" not in got and "delta" not in got and "r/topic" not in got and "it at" in got


def test_bins_and_roundings(spark):
    ps = [0.0, 0.1, 0.3, 0.6, 0.7, 0.999, 1.0]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    edges = [i * 0.1 for i in range(11)]
    assert [r[0] for r in df.select(N.bin_index(F.col("p"))).collect()] == [min(9, max(0, sum(p >= e for e in edges) - 1)) for p in ps]
    df = spark.createDataFrame([(x,) for x in (2.5, 0.5, -1.0, 11.0, 3.5)], "x double")
    assert [r[0] for r in df.select(N.half_even_clamped(F.col("x"))).collect()] == [2, 0, 0, 10, 4]
    assert [r[0] for r in df.select(N.half_up(F.col("x"))).collect()] == [3, 1, -1, 11, 4]


def test_answers_are_parsed_tolerantly(spark):
    rows = ['```json\n{"overall_winner": "A", "qualities": [{"quality": " q ", "evidence": null}, {"quality": " "}]}\n```', '{"overall_winner": "C"}', "{bad", None, '{"overall_winner": "B"}']
    got = one(spark, rows, J.comparative(F.col("t")))
    assert [None if g[0] is None else (g[0].winner, [q.quality for q in g[0].qualities]) for g in got] == [("A", ["q"]), None, None, None, ("B", [])]
    names = F.array(F.lit("a"), F.lit("b"))
    rows = ['{"criteria": [{"name": "b", "winner": "A"}, {"name": "zz", "winner": "B"}]}', '{"criteria": [{"name": "x", "winner": "B"}, {"name": "y", "winner": "?"}]}', "{}"]
    got = one(spark, rows, J.winners(F.col("t"), names))
    assert [[tuple(x) for x in g[0]] for g in got] == [[("b", "A")], [("a", "B")], []]
    rows = ["", "{", '{"criteria": [{"name": "a", "score": 1}, {"name": "a", "score": 2}]}', '{"criteria": [{"name": "c", "score": 1}]}', '{"criteria": [{"name": "a", "score": 1}]}', '{"criteria": [{"name": "a", "score": 1}, {"name": "b", "score": 11}]}', '{"criteria": [{"name": "a", "score": 1}, {"name": "b", "score": true}]}', '{"criteria": [{"name": "a", "score": 1}, {"name": "b", "score": 10}]}']
    assert [g[0] for g in one(spark, rows, J.panel_fault(F.col("t"), names))] == ["empty", "malformed", "duplicate", "unknown", "missing", "bad score", "bad score", None]
