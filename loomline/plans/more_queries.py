"""Queries over smaller operators: orders, draws, splits, vectors, replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.judgments import elicited
from ..functions.numeric import cosine, logit, md5_number, unit_vector
from ..operators import graph, rationale
from .assembly_queries import MD5, SPREAD_SQL, h, spreads
from .evaluation_queries import correlation
from .fixtures import items, members, pairs
from .graph_queries import cited, phrases, sql
from .registry import query, table
from .stat_queries import DIALS_SQL


@query("q_first_per_source", f"""
SELECT source, arg_min(doc_id, ({MD5.format("'keep:' || doc_id")}, doc_id)) AS doc_id, count(*) AS n FROM documents GROUP BY 1""")
def first_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of each source, whichever a seeded order puts first."""
    at = F.struct(h("keep", F.col("doc_id")), "doc_id")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.min_by("doc_id", at).alias("doc_id"), F.count("*").alias("n"))


@query("q_texts_in_order", """
WITH f AS (SELECT md5(coalesce(text, '')) AS h, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1)
SELECT first_id, n, CAST(row_number() OVER (ORDER BY first_id) - 1 AS BIGINT) AS place FROM f""")
def texts_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts in the order in which they are first seen."""
    from ..operators.order import numbered

    f = table(spark, sf_dir, "documents").groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("h")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    return numbered(f.select("first_id", "n"), ["first_id"], "place")


@query("q_top_correlations", sql(DIALS_SQL + """
SELECT f, g, round(r, 6) + 0.0::DOUBLE AS r, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (ORDER BY round(abs(r), 6) DESC, f, g) AS k FROM r) WHERE k <= 5"""))
def top_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest coefficients by size, whatever their sign (a top-k report)."""
    k = F.row_number().over(W.orderBy(F.desc(F.round(F.abs("r"), 6)), "f", "g"))
    return correlation(spark, sf_dir).withColumn("k", k).filter("k <= 5").select("f", "g", (F.round("r", 6) + 0.0).alias("r"), "k")


@query("q_log_odds", """
WITH v AS (SELECT event_id, CAST(event_id % 101 AS DOUBLE) / 100 AS p FROM events)
SELECT event_id, round(ln(greatest(least(p, 1 - 1e-6), 1e-6) / (1 - greatest(least(p, 1 - 1e-6), 1e-6))), 6) + 0.0::DOUBLE AS z, round(tanh(p - 0.5), 6) + 0.0::DOUBLE AS t FROM v""")
def log_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 101).cast("double") / 100).alias("p"))
    return e.select("event_id", (F.round(logit(F.col("p")), 6) + 0.0).alias("z"), (F.round(F.tanh(F.col("p") - 0.5), 6) + 0.0).alias("t"))


@query("q_unit_vectors", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (1 + vec_id % 3)) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e)
SELECT vec_id, round(norm, 5) AS norm, round(v[1] / norm, 5) + 0.0::DOUBLE AS x0, round(list_sum(list_transform(v, lambda x: (x / norm) * (x / norm))), 6) AS one FROM n""")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of length one; one of length zero stays as it is."""
    v = F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 3))
    e = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).withColumns({"u": unit_vector(F.col("v")), "norm": F.sqrt(cosine(F.col("v"), F.col("v")))})
    return e.select("vec_id", F.round("norm", 5).alias("norm"), (F.round(F.get("u", F.lit(0)), 5) + 0.0).alias("x0"), F.round(cosine(F.col("u"), F.col("u")), 6).alias("one"))


@query("q_triangular_pairs", f"""
WITH n AS (SELECT count(*) AS n FROM documents), x AS (SELECT t, {MD5.format("'tri:' || t")} % (n * (n - 1) // 2) AS k, n FROM n, (SELECT unnest(range(500)) AS t)),
i AS (SELECT t, k, n, CAST(floor((2 * n - 1 - sqrt(CAST(pow(2 * n - 1, 2) - 8 * k AS DOUBLE))) / 2) AS BIGINT) AS i FROM x)
SELECT t, i AS a, k - i * (2 * n - i - 1) // 2 + i + 1 AS b FROM i""")
def triangular_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hundred pairs drawn alike from all, each from one number below n (n - 1) / 2 (a sampling operator)."""
    n = table(spark, sf_dir, "documents").count()
    k = md5_number(F.concat_ws(":", F.lit("tri"), F.col("id").cast("string"))) % (n * (n - 1) // 2)
    return graph.numbered_pairs(spark.range(500).select(F.col("id").alias("t"), k.alias("k")), "k", n).select("t", "a", "b")


@query("q_split_halves", sql(f""",
q AS (SELECT pair_index, first AS item, {MD5.format("'half:' || pair_index")} AS hh FROM pairs),
r AS (SELECT pair_index, item, row_number() OVER (PARTITION BY item ORDER BY hh, pair_index) AS k, count(*) OVER (PARTITION BY item) AS n FROM q)
SELECT pair_index, item, CASE WHEN k <= n // 2 THEN 0 ELSE 1 END AS half FROM r"""))
def split_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons in two disjoint halves within each item, in a seeded order; an odd one goes to the second."""
    w = W.partitionBy("item")
    q = pairs(spark, sf_dir).select("pair_index", F.col("first").alias("item"))
    k = F.row_number().over(w.orderBy(h("half", F.col("pair_index")), "pair_index"))
    return q.select("pair_index", "item", F.when(k <= F.floor(F.count("*").over(w) / 2), 0).otherwise(1).alias("half"))


@query("q_replicate_tables", sql(f""",
d AS (SELECT rep, i FROM items, (SELECT unnest(range(4)) AS rep) WHERE {MD5.format("'rt:' || rep || ':' || i")} % 3 > 0),
c AS (SELECT d.rep, q.phrase_norm, q.pair_index FROM cites q JOIN d ON d.i = q.a JOIN d e ON e.i = q.b AND e.rep = d.rep)
SELECT CAST(rep AS INTEGER) AS rep, phrase_norm, count(*) AS n_cited, count(DISTINCT pair_index) AS n_pairs FROM c GROUP BY 1, 2 HAVING count(*) >= 3"""))
def replicate_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase counts of each replicate over the pairs whose two items it drew, all replicates in one pass."""
    d = items(spark, sf_dir).select("i", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("rep")).filter(h("rt", F.col("rep"), F.col("i")) % 3 > 0)
    p = pairs(spark, sf_dir).select("pair_index", "a", "b").join(d.withColumnRenamed("i", "a"), "a").join(d.withColumnRenamed("i", "b"), ["rep", "b"], "left_semi").select("rep", "pair_index")
    c = phrases(spark, sf_dir).select("pair_index", "phrase_norm").join(p, "pair_index")
    return c.groupBy("rep", "phrase_norm").agg(F.count("*").alias("n_cited"), F.countDistinct("pair_index").alias("n_pairs")).filter("n_cited >= 3")


@query("q_taxonomy_replay", sql(" SELECT count(DISTINCT phrase_norm) AS n_phrases, 0::BIGINT AS n_changed FROM cites"))
def taxonomy_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping that the data kept was placed by, beside one rebuilt from the phrases: how many differ."""
    kept = cited(spark, sf_dir).select("phrase_norm", F.col("criterion").alias("kept")).distinct()
    again = rationale.place(phrases(spark, sf_dir).repartition(3), members(spark), "last", "none")
    both = kept.join(again, "phrase_norm", "full_outer")
    return both.agg(F.count("*").alias("n_phrases"), F.count_if(~F.col("kept").eqNullSafe(F.col("criterion"))).alias("n_changed"))


@query("q_surfacing", SPREAD_SQL + """,
p AS (SELECT DISTINCT judge, criterion FROM s WHERE (ascii(right(judge, 1)) + length(criterion)) % 3 > 0),
j AS (SELECT DISTINCT judge FROM p), g AS (SELECT judge, row_number() OVER (ORDER BY judge) - 1 AS b FROM j),
m AS (SELECT unnest(range(1, (1 << (SELECT count(*) FROM j)::INT))) AS mask),
c AS (SELECT mask, bit_count(mask) AS size, count(DISTINCT criterion) AS found FROM m JOIN g ON (mask >> b::INT) & 1 = 1 JOIN p USING (judge) GROUP BY ALL)
SELECT CAST(size AS INTEGER) AS size, count(*) AS n_subsets, round(avg(found), 6) AS mean_found, min(found) AS least, max(found) AS most FROM c GROUP BY 1""")
def surfacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many criteria sets of judges bring up together, over all sets of each size (judges are a handful)."""
    p = spreads(spark, sf_dir).filter((F.ascii(F.right("judge", F.lit(1))) + F.length("criterion")) % 3 > 0).select("judge", "criterion")
    j = p.select("judge").distinct().withColumn("b", F.row_number().over(W.orderBy("judge")) - 1)
    p = p.join(F.broadcast(j), "judge")
    n = j.count()
    masks = spark.range(1, 1 << n).withColumnRenamed("id", "mask")
    c = masks.join(p, F.expr("shiftright(mask, b) & 1 = 1")).groupBy("mask").agg(F.countDistinct("criterion").alias("found"))
    return c.groupBy(F.bit_count("mask").alias("size")).agg(F.count("*").alias("n_subsets"), F.round(F.avg("found"), 6).alias("mean_found"), F.min("found").alias("least"), F.max("found").alias("most"))


@query("q_rubric_fusion", """
WITH e AS (SELECT vec_id, label, vec_id % 5 AS rep, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
t AS (SELECT label, pos, sum(x) AS x FROM (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS pos FROM e) GROUP BY 1, 2),
s AS (SELECT label, list(x ORDER BY pos) AS c FROM t GROUP BY 1),
r AS (SELECT label, vec_id, rep, round(list_sum(list_transform(list_zip(v, c), lambda z: z[1] * z[2])), 6) AS mass FROM e JOIN s USING (label))
SELECT label, arg_min(vec_id, (-mass, vec_id)) AS medoid, count(*) AS n_members, count(DISTINCT rep) AS n_runs, label = 0 AS other FROM r GROUP BY 1""")
def rubric_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of elicited features: the most central member, how many there are and from how many runs; the rest group apart."""
    e = table(spark, sf_dir, "embeddings").withColumn("rep", F.col("vec_id") % 5)
    t = e.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.sum(F.col("x").cast("double")).alias("x"))
    c = t.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("c"))
    r = e.join(F.broadcast(c), "label").withColumn("mass", F.round(cosine(F.col("embedding"), F.col("c")), 6))
    return r.groupBy("label").agg(F.min_by("vec_id", F.struct((-F.col("mass")).alias("m"), "vec_id")).alias("medoid"), F.count("*").alias("n_members"), F.countDistinct("rep").alias("n_runs")).withColumn("other", F.col("label") == 0)


def _panel(i: Column) -> Column:
    """Elicited panels of five shapes: whole, with a blank name, one too few, a name twice, no JSON."""
    name = lambda n: F.concat(F.lit('{"name": "'), F.lit(n), F.lit('", "evidence": "x", "description": " d "}'))
    wrap = lambda *names: F.concat(F.lit('Here: {"features": ['), F.concat_ws(",", *map(name, names)), F.lit("]} done"))
    return F.when(i == 0, wrap("a", " b ", "c")).when(i == 1, wrap("a", "b", " ", "c")).when(i == 2, wrap("a", "b")).when(i == 3, wrap("a", "b", "c", "a")).otherwise(F.lit("none"))


@query("q_elicited_panels", """
SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1) THEN 'a,b,c' END AS exact3, CASE doc_id % 5 WHEN 0 THEN 'a,b,c' WHEN 1 THEN 'a,b,c' WHEN 2 THEN 'a,b' END AS least2 FROM documents""")
def elicited_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of elicited panels: exactly three of them, or at least two and no name twice; null where a panel is neither."""
    d = table(spark, sf_dir, "documents").select("doc_id", _panel(F.col("doc_id") % 5).alias("t"))
    show = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), ",")
    return d.select("doc_id", show(elicited(F.col("t"), exactly=3)).alias("exact3"), show(elicited(F.col("t"), least=2)).alias("least2"))


@query("q_digit_whitelist", """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[0-9]+') AS found FROM documents)
SELECT doc_id, len(found) AS n, len(list_filter(found, lambda x: NOT list_contains(['1', '2', '10', CAST(doc_id AS VARCHAR)], x))) AS n_strange FROM d""")
def digit_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in each text, and how many of them are none of those it may hold."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[0-9]+"), 0)
    d = table(spark, sf_dir, "documents").select("doc_id", found.alias("f"))
    may = F.array(F.lit("1"), F.lit("2"), F.lit("10"), F.col("doc_id").cast("string"))
    return d.select("doc_id", F.size("f").cast("long").alias("n"), F.size(F.filter("f", lambda x: ~F.array_contains(may, x))).cast("long").alias("n_strange"))


@query("q_retained_share", sql(""",
k AS (SELECT phrase_norm, count(*) AS n FROM cites GROUP BY 1)
SELECT least_n, round(sum(CASE WHEN n >= least_n THEN n ELSE 0 END) / sum(n), 6) AS share, count(*) FILTER (n >= least_n) AS n_phrases FROM k, (SELECT CAST(unnest([1, 10, 100]) AS INTEGER) AS least_n) GROUP BY 1"""))
def retained_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What share of citations the phrases keep that are cited often enough."""
    k = phrases(spark, sf_dir).groupBy("phrase_norm").agg(F.count("*").alias("n")).select("n", F.explode(F.array(F.lit(1), F.lit(10), F.lit(100))).alias("least_n"))
    kept = F.when(F.col("n") >= F.col("least_n"), F.col("n")).otherwise(0)
    return k.groupBy("least_n").agg(F.round(F.sum(kept) / F.sum("n"), 6).alias("share"), F.count_if(F.col("n") >= F.col("least_n")).alias("n_phrases"))


@query("q_participation_by_source", sql(""",
x AS (SELECT source, doc_id, f, v FROM (UNPIVOT (SELECT source, doc_id, CAST(length AS DOUBLE) AS length, CAST(lines AS DOUBLE) AS lines, CAST(commas AS DOUBLE) AS commas, CAST(capitals AS DOUBLE) AS capitals FROM items) ON length, lines, commas, capitals INTO NAME f VALUE v)),
r AS (SELECT source, doc_id, f, rank() OVER (PARTITION BY source, f ORDER BY v) + (count(*) OVER (PARTITION BY source, f, v) - 1) / 2.0 AS k FROM x),
c AS (SELECT a.source, a.f, b.f AS g, CASE WHEN a.f = b.f THEN 1 ELSE coalesce(CASE WHEN stddev_pop(a.k) * stddev_pop(b.k) <> 0 THEN covar_pop(a.k, b.k) / (stddev_pop(a.k) * stddev_pop(b.k)) END, 0) END AS r FROM r a JOIN r b ON a.source = b.source AND a.doc_id = b.doc_id GROUP BY 1, 2, 3)
SELECT source, round(16 / sum(r * r), 5) AS participation FROM c GROUP BY 1"""))
def participation_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participation ratio of the features' rank correlations within each source: squared trace over the sum of squares."""
    from ..functions.numeric import guarded_corr
    from ..operators.order import average_ranks
    from ..operators.skew import hot_safe_join
    from ..sources.shared import written
    from .stat_queries import NAMES

    x = items(spark, sf_dir).select("source", "doc_id", *[F.col(c).cast("double").alias(c) for c in NAMES]).unpivot(["source", "doc_id"], NAMES, "f", "v")
    at = written(average_ranks(x, ["source", "f"], "v"), "ranked")
    r = hot_safe_join(x, at, ["source", "f", "v"], "n", x.count(), "inner").select("source", "doc_id", "f", F.col("rank").alias("k"))
    both = r.join(r.select("source", "doc_id", F.col("f").alias("g"), F.col("k").alias("y")), ["source", "doc_id"])
    c = both.groupBy("source", "f", "g").agg(F.when(F.col("f") == F.col("g"), 1.0).otherwise(guarded_corr(F.col("k"), F.col("y"))).alias("r"))
    return c.groupBy("source").agg(F.round(float(len(NAMES) ** 2) / F.sum(F.col("r") * F.col("r")), 5).alias("participation"))
