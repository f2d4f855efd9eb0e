"""Queries over comparison graphs, rationales, taxonomies and tensors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import md5_number
from ..operators import graph, rationale, spectrum
from ..operators.components import connected_components
from ..operators.skew import hot_safe_join
from ..sources.shared import written
from .fixtures import CTES, ROUNDS, items, judgments, members, pairs
from .registry import once, query, table


def sql(body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{CTES.strip()}{body}"


@query("q_circle_pairs", sql(" SELECT pair_index, CAST(round AS INTEGER) AS round, a, b, first, other FROM pairs"))
def circle_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir)


@query("q_graph_degree", sql(" SELECT e.node, count(*) AS degree FROM (SELECT a AS node FROM pairs UNION ALL SELECT b FROM pairs) e GROUP BY 1"))
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(pairs(spark, sf_dir))


BUDGETS_SQL = """,
budgets AS (SELECT unnest([n // 2, 2 * n // 2, n // 2 * {rounds}]) AS budget FROM size),
inside AS (SELECT budget, p.*, abs(x.length - y.length) AS gap FROM budgets, pairs p JOIN items x ON x.i = p.a JOIN items y ON y.i = p.b WHERE pair_index < budget),
ends AS (SELECT budget, a AS node FROM inside UNION ALL SELECT budget, b FROM inside),
deg AS (SELECT budget, node, count(*) AS d FROM ends GROUP BY 1, 2),
sym AS (SELECT budget, a, b FROM inside UNION SELECT budget, b, a FROM inside),
reach AS (SELECT budget, a AS node, a AS seen FROM sym UNION SELECT r.budget, r.node, s.b FROM reach r JOIN sym s ON s.budget = r.budget AND s.a = r.seen),
comp AS (SELECT budget, count(DISTINCT low) AS c FROM (SELECT budget, node, min(seen) AS low FROM reach GROUP BY 1, 2) GROUP BY 1)
SELECT CAST(d.budget AS BIGINT) AS budget, i.n_pairs, CAST(least_d AS BIGINT) AS degree_min, most_d AS degree_max, round(2.0 * n_pairs / n, 6) AS degree_mean, CAST(c AS BIGINT) AS components, round(gap, 6) AS mean_gap
FROM (SELECT budget, min(d) AS least_d, max(d) AS most_d FROM deg GROUP BY 1) d JOIN comp USING (budget) JOIN (SELECT budget, count(*) AS n_pairs, avg(gap) AS gap FROM inside GROUP BY 1) i USING (budget), size""".format(rounds=ROUNDS)


@query("q_graph_budgets")
def graph_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees, components and mean gap at three budgets; the SQL's recursion is too slow on whole tables, so a test has it."""
    it = items(spark, sf_dir)
    ends = lambda c: it.select(F.col("i").alias(c), F.col("length").alias(f"length_{c}"))
    p = pairs(spark, sf_dir).join(ends("a"), "a").join(ends("b"), "b").withColumn("gap", F.abs(F.col("length_a") - F.col("length_b")))
    n = table(spark, sf_dir, "documents").count() // 2 * 2
    out = graph.budget_report(p, n, [n // 2, n, n // 2 * ROUNDS], "gap")
    return out.withColumns({c: F.round(c, 6) for c in ("degree_mean", "mean_gap")})


@query("q_avoiding_report", sql(f" SELECT n // 2 * {ROUNDS} AS n_pairs, 0 AS n_forbidden, 0 AS n_repeated, {ROUNDS} AS degree_min, {ROUNDS} AS degree_max, true AS some_were_there FROM size"))
def avoiding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matchings rid of forbidden edges by swaps: none is left, no pair repeats, and every degree is what it was."""
    p = pairs(spark, sf_dir)
    barred = p.filter("pair_index % 37 = 0").select("a", "b")
    q = written(graph.avoiding(p, barred), "avoiding")
    e = q.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    n_barred = e.join(barred.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_semi").agg(F.count("*").cast("int").alias("n_forbidden"))
    twice = e.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").cast("int").alias("n_repeated"))
    d = graph.degrees(q).agg(F.min("degree").cast("int").alias("degree_min"), F.max("degree").cast("int").alias("degree_max"))
    total = q.agg(F.count("*").alias("n_pairs"))
    some = barred.agg((F.count("*") > 0).alias("some_were_there"))
    return total.join(n_barred, how="left", on=F.lit(True)).join(twice, how="left", on=F.lit(True)).join(d, how="left", on=F.lit(True)).join(some, how="left", on=F.lit(True))


@query("q_graph_components", """
WITH RECURSIVE e AS (SELECT o_custkey AS a, o_orderkey + 1000000000 AS b FROM orders),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS low FROM s UNION SELECT s.b, r.low FROM r JOIN s ON s.a = r.node WHERE r.low < s.b)
SELECT node, min(low) AS component FROM r GROUP BY node""")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and their orders as nodes of one graph."""
    o = table(spark, sf_dir, "orders")
    return connected_components(o.select(F.col("o_custkey").cast("long").alias("src"), (F.col("o_orderkey") + 1000000000).cast("long").alias("dst")))


@query("q_laplacian_entries", sql(""",
w AS (SELECT p.a, p.b, CAST(pair_index % 5 + 1 AS DOUBLE) AS w FROM pairs p)
SELECT i, j, round(sum(v), 6) AS value FROM (SELECT a AS i, a AS j, w AS v FROM w UNION ALL SELECT b, b, w FROM w UNION ALL SELECT a, b, -w FROM w UNION ALL SELECT b, a, -w FROM w) GROUP BY 1, 2"""))
def laplacian_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = pairs(spark, sf_dir).select("a", "b", (F.col("pair_index") % 5 + 1).cast("double").alias("w"))
    return graph.laplacian(e).withColumn("value", F.round("value", 6))


@query("q_forbidden_edges", sql(""",
f AS (SELECT min(i) AS lo, max(i) AS hi FROM items GROUP BY doc_id // 2 HAVING count(*) = 2)
SELECT pair_index, a, b FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lo = least(p.a, p.b) AND f.hi = greatest(p.a, p.b))"""))
def forbidden_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs without edges between items of one thread (here: ids that share their half)."""
    it = items(spark, sf_dir).select("i", F.expr("doc_id div 2").alias("thread"))
    same = graph.same_group_edges(it, "thread", "i").select("a", "b")
    return graph.without(pairs(spark, sf_dir), same).select("pair_index", "a", "b")


@query("q_anchor_assignment", sql(""",
anchors AS (SELECT doc_id, source FROM items WHERE i < 12),
r AS (SELECT t.doc_id, a.doc_id AS anchor_id, row_number() OVER (PARTITION BY t.doc_id ORDER BY CAST('0x' || substr(md5(t.doc_id || ':' || a.doc_id), 1, 8) AS BIGINT), a.doc_id) AS k
  FROM items t, anchors a WHERE t.i >= 12 AND t.source <> a.source)
SELECT doc_id, anchor_id, CAST(k AS INTEGER) AS k, CASE WHEN (doc_id + k) % 2 = 0 THEN 'A' ELSE 'B' END AS slot FROM r WHERE k <= 4"""))
def anchor_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item meets four of twelve anchors by other authors, slots in turn; the anchor set has a fixed size."""
    it = items(spark, sf_dir)
    anchors = F.broadcast(it.filter("i < 12").select(F.col("doc_id").alias("anchor_id"), F.col("source").alias("anchor_source")))
    met = it.filter("i >= 12").join(anchors, F.col("source") != F.col("anchor_source"))
    h = md5_number(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("anchor_id").cast("string")))
    met = met.withColumn("k", F.row_number().over(W.partitionBy("doc_id").orderBy(h, "anchor_id"))).filter("k <= 4")
    return met.select("doc_id", "anchor_id", "k", F.when((F.col("doc_id") + F.col("k")) % 2 == 0, "A").otherwise("B").alias("slot"))


@query("q_pair_faults", """
WITH p AS (SELECT conv_id % 9 AS a, turn AS b FROM conversations)
SELECT least(a, b) AS lo, greatest(a, b) AS hi, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) > 1 OR least(a, b) = greatest(a, b)""")
def pair_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.faults(table(spark, sf_dir, "conversations").select((F.col("conv_id") % 9).alias("a"), F.col("turn").alias("b")))


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rationale.explode_phrases(judgments(spark, sf_dir))


@query("q_rule_rationales", sql(" SELECT pair_index, CAST(ord AS INTEGER) AS ord, phrase, description, phrase_norm, winner_slot FROM cites"))
def rule_rationales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(spark, sf_dir)


@query("q_normalize_phrases", sql(""",
per AS (SELECT phrase_norm, description, count(*) AS n, min((pair_index, ord)) AS seen FROM cites GROUP BY 1, 2),
best AS (SELECT phrase_norm, description, row_number() OVER (PARTITION BY phrase_norm ORDER BY n DESC, seen) AS k, sum(n) OVER (PARTITION BY phrase_norm) AS total FROM per),
head AS (SELECT phrase_norm, arg_min(phrase, (pair_index, ord)) AS phrase FROM cites GROUP BY 1)
SELECT phrase_norm, CAST(total AS BIGINT) AS n_cited, phrase, description FROM best JOIN head USING (phrase_norm) WHERE k = 1 AND total >= 3"""))
def normalize_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rationale.phrase_table(phrases(spark, sf_dir), least=3)


def _placed(rule: str, rest: str, fill: str, pick: str) -> None:
    body = f""" SELECT phrase_norm, coalesce(m.criterion, {fill}) AS criterion, count(*) AS n_cited FROM cites
LEFT JOIN (SELECT phrase_norm, {pick}(criterion, ord) AS criterion FROM members GROUP BY 1) m USING (phrase_norm) GROUP BY 1, 2"""

    @query(f"q_taxonomy_{rule}_{rest}", sql(body))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = phrases(spark, sf_dir).groupBy("phrase_norm").agg(F.count("*").alias("n_cited"))
        return n.join(rationale.place(n, members(spark), rule, rest), "phrase_norm", "left").select("phrase_norm", "criterion", "n_cited")


_placed("last", "self", "phrase_norm", "arg_max")
_placed("first", "other", "'Other'", "arg_min")
_placed("last", "none", "NULL", "arg_max")


@once
def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases with their criterion; a phrase that much of the text cites is no hot key."""
    p = phrases(spark, sf_dir)
    n = p.groupBy("phrase_norm").agg(F.count("*").alias("n"))
    at = written(n.join(rationale.place(n, members(spark), "last", "none"), "phrase_norm"), "placed")
    return hot_safe_join(p, at, ["phrase_norm"], "n", p.count(), "inner")


PLACED_SQL = """,
placed AS (SELECT c.pair_index, c.winner_slot, m.criterion FROM cites c JOIN (SELECT phrase_norm, arg_max(criterion, ord) AS criterion FROM members GROUP BY 1) m USING (phrase_norm))"""


@query("q_active_criteria", sql(PLACED_SQL + """,
n AS (SELECT criterion, count(DISTINCT pair_index) AS mentions FROM placed GROUP BY 1),
s AS (SELECT criterion, mentions, mentions / sum(mentions) OVER () AS share FROM n)
SELECT criterion, mentions, round(share, 6) AS share, CAST(row_number() OVER (ORDER BY share DESC, criterion) - 1 AS INTEGER) AS k FROM s WHERE share >= 0.05"""))
def active_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rationale.active_criteria(cited(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query("q_verdict_tensor", sql(" SELECT pair_index, criterion, x FROM tensor"))
def verdict_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rationale.verdict_tensor(cited(spark, sf_dir))


@query("q_tensor_balance", sql(" SELECT criterion, count(*) AS cited, round(count(*) / (SELECT count(*) FROM pairs), 6) AS rate, round(avg(CASE WHEN x = 1 THEN 1.0 ELSE 0.0 END), 6) AS first_share FROM tensor GROUP BY 1"))
def tensor_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (table(spark, sf_dir, "documents").count() // 2) * ROUNDS
    t = rationale.verdict_tensor(cited(spark, sf_dir)).groupBy("criterion")
    return t.agg(F.count("*").alias("cited"), F.round(F.count("*") / n, 6).alias("rate"), F.round(F.avg(F.when(F.col("x") == 1, 1.0).otherwise(0.0)), 6).alias("first_share"))


@query("q_holistic_tensor", sql(PLACED_SQL + """
SELECT p.pair_index, CASE winner WHEN 'A' THEN 1 ELSE 0 END AS w, x.i AS item_a, y.i AS item_b, coalesce(string_agg(DISTINCT c.criterion, ',' ORDER BY c.criterion), '') AS mentioned
FROM pairs p JOIN winners USING (pair_index) JOIN items x ON x.doc_id = p.first JOIN items y ON y.doc_id = p.other LEFT JOIN placed c ON c.pair_index = p.pair_index GROUP BY 1, 2, 3, 4"""))
def holistic_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    j, it = judgments(spark, sf_dir), items(spark, sf_dir)
    r = cited(spark, sf_dir).groupBy("pair_index").agg(F.array_sort(F.collect_set("criterion")).alias("m"))
    end = lambda c, n: it.select(F.col("doc_id").alias(c), F.col("i").alias(n))
    out = j.join(end("first", "item_a"), "first").join(end("other", "item_b"), "other").join(r, "pair_index", "left")
    return out.select("pair_index", F.when(F.col("winner") == "A", 1).otherwise(0).alias("w"), "item_a", "item_b", F.coalesce(F.array_join("m", ","), F.lit("")).alias("mentioned"))


@query("q_won_cited", sql(" SELECT CASE w.winner WHEN 'A' THEN p.first ELSE p.other END AS item, criterion, count(*) AS n FROM tensor JOIN pairs p USING (pair_index) JOIN winners w USING (pair_index) GROUP BY 1, 2"))
def won_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judgments(spark, sf_dir).select("pair_index", "first", "other", F.col("winner").alias("winner_slot"))
    return rationale.won_and_cited(j, rationale.verdict_tensor(cited(spark, sf_dir)))


@query("q_grouping_faults", """
WITH e AS (SELECT supplier.s_suppkey AS entry, 'j' || (s_suppkey % 4) AS judge, 'n' || s_suppkey AS name FROM supplier),
m AS (SELECT s_suppkey // 3 AS cluster, CASE WHEN s_suppkey % 11 = 0 THEN s_suppkey + 1 ELSE s_suppkey END AS entry, 'j' || ((s_suppkey + CASE WHEN s_suppkey % 11 = 0 THEN 1 ELSE 0 END) % 4) AS judge,
  CASE WHEN s_suppkey % 13 = 0 THEN 'other' ELSE 'n' || (s_suppkey + CASE WHEN s_suppkey % 11 = 0 THEN 1 ELSE 0 END) END AS name FROM supplier)
SELECT 'left out' AS fault, entry FROM e WHERE entry NOT IN (SELECT entry FROM m)
UNION ALL SELECT DISTINCT 'invented', entry FROM m WHERE entry NOT IN (SELECT entry FROM e)
UNION ALL SELECT 'placed twice', entry FROM m GROUP BY entry HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'misquoted', m.entry FROM m JOIN e ON m.entry = e.entry WHERE m.judge <> e.judge OR m.name <> e.name
UNION ALL SELECT 'judge twice', min(entry) FROM m GROUP BY cluster, judge HAVING count(*) > 1""")
def grouping_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("long")
    e = s.select(k.alias("entry"), F.concat(F.lit("j"), k % 4).alias("judge"), F.concat(F.lit("n"), k).alias("name"))
    shifted = k + F.when(k % 11 == 0, 1).otherwise(0)
    m = s.select(F.expr("cast(s_suppkey as bigint) div 3").alias("cluster"), shifted.alias("entry"), F.concat(F.lit("j"), shifted % 4).alias("judge"), F.when(k % 13 == 0, "other").otherwise(F.concat(F.lit("n"), shifted)).alias("name"))
    return rationale.grouping_faults(m, e)


BANDED_ROUNDS = 4


def banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds over all documents in five bands of length: same-source neighbours preferred, half of the pairs within bands led across."""
    it = items(spark, sf_dir)
    n = table(spark, sf_dir, "documents").count() // 2 * 2  # an odd last document has no partner
    it = written(it.filter(F.col("i") < n).select(F.col("i").alias("node"), F.least(F.floor(F.col("length") / 1000), F.lit(4)).cast("int").alias("band")), "band-items")
    wish = it.filter("node % 10 = 0 and node + 1 < {}".format(n)).select(F.col("node").alias("a"), (F.col("node") + 1).alias("b"))
    return graph.nested_pairs(it, BANDED_ROUNDS, 0.5, wish)


@query("q_banded_pairs")
def banded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return banded(spark, sf_dir)


@query("q_banded_report", f"""
WITH size AS (SELECT count(*) - count(*) % 2 AS n FROM documents)
SELECT CAST(r AS INTEGER) AS round, n // 2 AS n_pairs, n AS n_nodes, 0 AS n_loops, 0 AS n_repeats, n // 10 + CASE WHEN n % 10 > 1 THEN 1 ELSE 0 END AS n_preferred, true AS fewer_within FROM size, (SELECT unnest(range({BANDED_ROUNDS})) AS r)""")
def banded_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every round is perfect, no pair repeats, all preferred edges are in some round, and fewer pairs are within a band than chance has."""
    p = written(banded(spark, sf_dir), "banded")
    ends = p.select("round", F.explode(F.array("a", "b")).alias("node")).groupBy("round").agg(F.countDistinct("node").alias("n_nodes"))
    n = p.groupBy("round").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("a") == F.col("b")).alias("n_loops"), F.avg((F.col("band_a") == F.col("band_b")).cast("double")).alias("within"))
    repeats = graph.faults(p).agg(F.count("*").alias("n_repeats"))
    wish = p.filter("least(a, b) % 10 = 0 and abs(a - b) = 1").agg(F.count("*").alias("n_preferred"))
    bands = p.select(F.explode(F.array("band_a", "band_b")).alias("band")).groupBy("band").agg(F.count("*").alias("n"))
    chance = bands.agg((F.sum(F.pow(F.col("n").cast("double"), F.lit(2.0))) / F.pow(F.sum("n").cast("double"), F.lit(2.0))).alias("chance"))
    out = n.join(ends, "round").crossJoin(repeats).crossJoin(wish).crossJoin(chance)  # single rows
    return out.select("round", "n_pairs", "n_nodes", "n_loops", "n_repeats", "n_preferred", (F.col("within") < F.col("chance")).alias("fewer_within"))


REPAIR_SQL = """
WITH r AS (
  SELECT 0 AS reply, doc_id % 7 AS grp, doc_id AS place, 'g' || (doc_id % 7) AS criterion, doc_id AS entry FROM documents WHERE doc_id % 5 <> 0
  UNION ALL SELECT 1, doc_id % 11, doc_id, 'g' || (doc_id % 11), doc_id FROM documents WHERE doc_id % 5 = 0 AND doc_id % 3 <> 0 OR doc_id % 13 = 0
  UNION ALL SELECT 2, doc_id % 3, doc_id, 'new' || (doc_id % 3), -1 - doc_id FROM documents WHERE doc_id % 17 = 0),
f AS (SELECT criterion, min(reply * 1000 + grp) AS pos FROM r GROUP BY 1),
m AS (SELECT r.*, f.pos FROM r JOIN f USING (criterion)),
a AS (SELECT entry, arg_max(criterion, row(pos, reply, grp, place)) AS after FROM m GROUP BY 1),
b AS (SELECT entry, arg_max(criterion, row(pos, reply, grp, place)) AS before FROM m WHERE reply = 0 GROUP BY 1)
SELECT coalesce(d.doc_id, a.entry) AS entry, before, after,
  CASE WHEN d.doc_id IS NULL THEN 'invented' WHEN after IS NULL THEN 'left out' WHEN before IS NULL THEN 'added' WHEN before = after THEN 'kept' ELSE 'moved' END AS change
FROM documents d FULL JOIN a ON a.entry = d.doc_id LEFT JOIN b ON b.entry = coalesce(d.doc_id, a.entry)"""


@query("q_taxonomy_repair", REPAIR_SQL)
def taxonomy_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A taxonomy and two repairs: groups of one name are joined, the last placement wins, and what moved is told."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    reply = lambda r, m, name, entry: d.select(F.lit(r).alias("reply"), (F.col("doc_id") % m).alias("grp"), F.col("doc_id").alias("place"), F.concat(F.lit(name), (F.col("doc_id") % m).cast("string")).alias("criterion"), entry.alias("entry"))
    replies = reply(0, 7, "g", F.col("doc_id")).filter("place % 5 <> 0")
    replies = replies.unionByName(reply(1, 11, "g", F.col("doc_id")).filter("place % 5 = 0 and place % 3 <> 0 or place % 13 = 0"))
    replies = replies.unionByName(reply(2, 3, "new", -1 - F.col("doc_id")).filter("place % 17 = 0"))
    return rationale.repaired(replies, d.select(F.col("doc_id").alias("entry")))


@query("q_fiedler_budgets")
def fiedler_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fiedler values and condition of the banded rounds after two, three and all of them, by Lanczos steps."""
    p = written(banded(spark, sf_dir), "banded")
    n = table(spark, sf_dir, "documents").count() // 2
    budgets = F.filter(F.array(*[F.lit(n * k).cast("long") for k in (2, 3, BANDED_ROUNDS)]), lambda b: F.col("pair_index") < b)
    edges = p.select(F.explode(budgets).alias("graph"), "a", "b", F.lit(1.0).alias("w"))
    return spectrum.laplacian_ends(edges, most=60, tol=1e-7).withColumnRenamed("graph", "budget")
