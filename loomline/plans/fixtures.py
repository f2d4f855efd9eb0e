"""Comparison data over the driver's tables, the same in Spark and in SQL.

Items are documents; pairs come from the circle method; a rule stands in for a judge: it cites a criterion of a pair
if the items' counts differ by more than a threshold, in wording that varies by a hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import md5_number
from ..functions.text import normalise_phrase
from ..operators import graph
from ..operators.order import numbered
from ..sources.shared import written
from .registry import once, table

ROUNDS = 4
#: criterion, threshold of its count's gap
CRITERIA = (("length", 200), ("lines", 2), ("commas", 3), ("capitals", 5))
#: criterion, wording number, wording
WORDINGS = tuple((c, i, p) for c, _ in CRITERIA for i, p in enumerate((f"The {c}", f"more  {c}", f"A better {c} ", f"{c} overall")))
#: phrase_norm, criterion, place: one wording is placed twice, one not at all
MEMBERS = tuple((p, c, i) for i, (p, c) in enumerate([(c, c) for c, _ in CRITERIA] + [(f"{c} overall", c) for c, _ in CRITERIA[:3]] + [("lines overall", "layout")]))


@once
def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``i, doc_id`` and four counts of each document."""
    docs = table(spark, sf_dir, "documents")
    count = lambda p: F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0)).cast("long")
    cols = [F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("length"), (count("\n") + 1).alias("lines"), count(",").alias("commas"), count("[A-Z]").alias("capitals")]
    return numbered(docs.select("doc_id", "source", *cols), ["doc_id"])


@once
def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pair_index, round, a, b, first, other``: item numbers, and document ids in slot order."""
    it = items(spark, sf_dir).select("i", "doc_id")
    n = table(spark, sf_dir, "documents").count()
    p = graph.circle_pairs(spark, n - n % 2, ROUNDS)
    ids = lambda c: it.select(F.col("i").alias(c), F.col("doc_id").alias(f"id_{c}"))
    p = p.join(ids("a"), "a").join(ids("b"), "b")
    front = graph.shown_first(F.col("id_a"), F.col("id_b"))
    return p.select("pair_index", "round", "a", "b", F.when(front, F.col("id_a")).otherwise(F.col("id_b")).alias("first"), F.when(front, F.col("id_b")).otherwise(F.col("id_a")).alias("other"))


@once
def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pair_index, first, other, winner, qualities``: qualities are structs of criterion, phrase, description, winner."""
    it = items(spark, sf_dir)
    side = lambda s: it.select(F.col("doc_id").alias(s), F.struct(*[c for c, _ in CRITERIA]).alias(f"at_{s}"))
    p = pairs(spark, sf_dir).join(side("first"), "first").join(side("other"), "other")
    all_q = []
    for c, least in CRITERIA:
        gap = F.col(f"at_first.{c}") - F.col(f"at_other.{c}")
        way = md5_number(F.concat_ws(":", F.col("pair_index").cast("string"), F.lit(c))) % 4
        phrase = F.element_at(F.array(*[F.lit(p) for k, _, p in WORDINGS if k == c]), (way + 1).cast("int"))
        q = F.struct(F.lit(c).alias("criterion"), phrase.alias("phrase"), F.concat(F.lit(f"has a larger {c}, way "), (way % 2).cast("string")).alias("description"), F.when(gap > 0, "A").otherwise("B").alias("winner"))
        all_q.append(F.when(F.abs(gap) > least, q))
    q = F.filter(F.array(*all_q), lambda x: x.isNotNull())
    j = p.select("pair_index", "first", "other", "a", "b", q.alias("qualities"))
    won = F.aggregate("qualities", F.lit(0), lambda n, x: n + F.when(x["winner"] == "A", 1).otherwise(-1))
    winner = F.when(won > 0, "A").when(won < 0, "B").otherwise(F.when(F.col("pair_index") % 2 == 0, "A").otherwise("B"))
    return written(j.withColumn("winner", winner), "judgments")


def members(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MEMBERS), "phrase_norm string, criterion string, ord int").withColumn("phrase_norm", normalise_phrase(F.col("phrase_norm")))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


#: CTEs of the same tables: items, pairs, cites (a row per cited quality), members.
CTES = rf"""
items AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS i, coalesce(length(text), 0) AS length,
  coalesce(len(regexp_extract_all(text, '\n')), 0) + 1 AS lines, coalesce(len(regexp_extract_all(text, ',')), 0) AS commas,
  coalesce(len(regexp_extract_all(text, '[A-Z]')), 0) AS capitals FROM documents),
size AS (SELECT count(*) - count(*) % 2 AS n FROM documents),
circle AS (SELECT r * (n // 2) + k AS pair_index, r AS round, (r + k) % (n - 1) AS a,
  CASE WHEN k = 0 THEN n - 1 ELSE (r - k + n - 1) % (n - 1) END AS b
  FROM size, (SELECT unnest(range({ROUNDS})) AS r), (SELECT unnest(range(n // 2)) AS k FROM size)),
slots AS (SELECT pair_index, round, a, b, x.doc_id AS id_a, y.doc_id AS id_b,
  CAST('0x' || substr(md5(x.doc_id || ':' || y.doc_id), 1, 8) AS BIGINT) % 2 = 0 AS front
  FROM circle JOIN items x ON x.i = a JOIN items y ON y.i = b),
pairs AS (SELECT pair_index, round, a, b, CASE WHEN front THEN id_a ELSE id_b END AS first, CASE WHEN front THEN id_b ELSE id_a END AS other FROM slots),
gaps AS (
  SELECT p.*, c.criterion, c.least, c.ord, CASE c.criterion WHEN 'length' THEN f.length - o.length WHEN 'lines' THEN f.lines - o.lines
    WHEN 'commas' THEN f.commas - o.commas ELSE f.capitals - o.capitals END AS gap,
    CAST('0x' || substr(md5(p.pair_index || ':' || c.criterion), 1, 8) AS BIGINT) % 4 AS way
  FROM pairs p JOIN items f ON f.doc_id = p.first JOIN items o ON o.doc_id = p.other,
    (VALUES {_values((c, t, i) for i, (c, t) in enumerate(CRITERIA))}) c(criterion, least, ord)),
cites AS (
  SELECT pair_index, first, other, a, b, g.criterion, w.phrase, 'has a larger ' || g.criterion || ', way ' || (g.way % 2) AS description,
    CASE WHEN gap > 0 THEN 'A' ELSE 'B' END AS winner_slot,
    row_number() OVER (PARTITION BY pair_index ORDER BY g.ord) - 1 AS ord,
    regexp_replace(regexp_replace(lower(trim(w.phrase)), '^(?:(?:the|a|an|more|better)\s+)+', ''), '\s+', ' ', 'g') AS phrase_norm
  FROM gaps g JOIN (VALUES {_values(WORDINGS)}) w(criterion, way, phrase) ON w.criterion = g.criterion AND w.way = g.way WHERE abs(gap) > least),
winners AS (
  SELECT p.pair_index, CASE WHEN coalesce(s, 0) > 0 THEN 'A' WHEN coalesce(s, 0) < 0 THEN 'B' WHEN p.pair_index % 2 = 0 THEN 'A' ELSE 'B' END AS winner
  FROM pairs p LEFT JOIN (SELECT pair_index, sum(CASE winner_slot WHEN 'A' THEN 1 ELSE -1 END) AS s FROM cites GROUP BY 1) t USING (pair_index)),
members(phrase_norm, criterion, ord) AS (VALUES {_values(MEMBERS)}),
tensor AS (
  SELECT pair_index, criterion, CAST(sign(sum(CASE winner_slot WHEN 'A' THEN 1 ELSE -1 END)) AS INTEGER) AS x
  FROM (SELECT c.pair_index, c.winner_slot, m.criterion FROM cites c
        JOIN (SELECT phrase_norm, arg_max(criterion, ord) AS criterion FROM members GROUP BY 1) m USING (phrase_norm))
  GROUP BY 1, 2 HAVING sum(CASE winner_slot WHEN 'A' THEN 1 ELSE -1 END) <> 0)
"""
