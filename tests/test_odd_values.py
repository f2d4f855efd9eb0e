"""Queries against their SQL on values that the driver's small tables do not have."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from loomline.functions import numeric as N
from loomline.plans import QUERIES, SQL


def both(spark, tmp_path, name, documents):
    """Rows of a query in Spark and in DuckDB, sorted."""
    pq.write_table(documents, tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    got = QUERIES[name](spark, str(tmp_path))
    want = con.execute(SQL[name])
    names = [c[0] for c in want.description]
    return sorted(map(tuple, got.select(*names).collect())), sorted(map(tuple, want.fetchall()))


ODD = ["___ a Happy CMVing! b", "Hello, users of x Happy CMVing!*", "a ∆ Δ b", "édelta deltaé delta", "reddité \u00e9reddit reddit", "\u0301reddit", "x\x0b", "\x0by", "https://a.b\x0bc d", "end \u00a0", "end \u2028", "end \u0085", "\u3000z", "delta\u017f awarded a point", "\u212aCMV cmv\u212a: r/\u212ax", "award\u00e9 awarding\x0ba view", "delta\x0bbot", "r/\x0btopic", "[a\nb](c\nd)", "", None, "r/été subreddit\u017f\u00e9", "x  \t y\r\n"]


def test_deidentified_as_sql_on_odd_texts(spark, tmp_path):
    draw = random.Random(5)
    parts = ["delta", "Deltas", "bot", "reddit", "ors", "award", "ing", "a", "point", "cmv", "r/", "subreddit", "[", "](", ")", "http", "s://", "!", ":", *" \t\n\r\x0b\x0cé_9ſK∆\u00a0\u2028\u0085\u0301x"]
    texts = ODD + ["".join(draw.choices(parts, k=draw.randint(1, 14))) for _ in range(3000)]
    got, want = both(spark, tmp_path, "q_deidentify", pa.table({"doc_id": list(range(len(texts))), "text": texts}))
    assert [(g, w) for g, w in zip(got, want, strict=True) if g != w][:5] == []


def test_rounding_as_sql(spark):
    values = [k / n for n in (64, 128, 320, 640, 1280, 3200, 512 * 25) for k in range(1, n, 2)]
    got = [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", N.half_away(F.col("v"), 6).alias("x")).orderBy("i").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    assert got == [x for (x,) in con.execute("SELECT round(v, 6) FROM t ORDER BY i").fetchall()]


def test_calibration_table_as_sql_where_a_mean_is_323_of_640(spark, tmp_path):
    base = lambda i: i * 37 % 101
    some = [i for i in range(1, 2000) if i % 7]  # what gate 0 does not mask
    ids, left = [], 1262  # 25 forecasts (5 base + 6) / 512 of this sum have that mean
    for i in some:
        rest = 24 - len(ids)
        if rest and left - base(i) in range(rest * 45, rest * 56) or not rest and base(i) == left:
            ids.append(i)
            left -= base(i)
        if len(ids) == 25:
            break
    assert len(ids) == 25 and left == 0
    table = pa.table({"doc_id": ids, "source": ["s"] * 25, "lang": ["l"] * 25})
    got, want = both(spark, tmp_path, "q_calibration_table", table)
    assert [r[-1] for r in want if r[2] == 0] == [0.504687]
    assert [r[-1] for r in got] == [r[-1] for r in want]
