"""Queries over replicates with rubrics of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import md5_number
from ..operators import resampling
from ..sources.shared import written
from .fixtures import items, members, pairs
from .graph_queries import phrases, sql
from .registry import query
from .stat_queries import NAMES

REPS, LEAST_CITED, TAU = 20, 40, 0.3

OWN_SQL = f""",
draw AS (SELECT rep, doc_id AS item FROM items, (SELECT unnest(range({REPS})) AS rep) WHERE CAST('0x' || substr(md5('own:' || rep || ':' || doc_id), 1, 8) AS BIGINT) % 10 < rep % 9 + 1),
sizes AS (SELECT rep, count(*) AS n_items FROM draw GROUP BY 1 HAVING count(*) >= 20),
dp AS (SELECT d.rep, s.n_items, p.pair_index, p.first, p.other FROM pairs p JOIN draw d ON d.item = p.first JOIN draw e ON e.item = p.other AND e.rep = d.rep JOIN sizes s ON s.rep = d.rep),
per AS (SELECT rep, count(*) AS size FROM dp GROUP BY 1),
mine AS (SELECT dp.rep, c.pair_index, c.phrase_norm, c.winner_slot FROM cites c JOIN dp USING (pair_index)),
kept AS (SELECT rep, phrase_norm FROM (SELECT rep, phrase_norm, count(*) AS n FROM mine GROUP BY 1, 2) JOIN per USING (rep) WHERE n >= greatest(1, ceil({LEAST_CITED} * size / (SELECT count(*) FROM pairs)))),
named AS (SELECT rep, phrase_norm, coalesce(m.criterion, phrase_norm) AS criterion FROM kept LEFT JOIN (SELECT phrase_norm, arg_max(criterion, ord) AS criterion FROM members GROUP BY 1) m USING (phrase_norm)),
tens AS (SELECT rep, pair_index, criterion, sign(sum(CASE winner_slot WHEN 'A' THEN 1 ELSE -1 END)) AS x FROM mine JOIN named USING (rep, phrase_norm) GROUP BY 1, 2, 3 HAVING sum(CASE winner_slot WHEN 'A' THEN 1 ELSE -1 END) <> 0),
both_ends AS (SELECT t.rep, criterion, first AS item, x AS v FROM tens t JOIN dp USING (rep, pair_index) UNION ALL SELECT t.rep, criterion, other, -x FROM tens t JOIN dp USING (rep, pair_index)),
net AS (SELECT rep, criterion, item, avg(CAST(v AS DOUBLE)) AS s FROM both_ends GROUP BY 1, 2, 3),
dial AS (UNPIVOT (SELECT doc_id AS item, CAST(length AS DOUBLE) AS length, CAST(lines AS DOUBLE) AS lines, CAST(commas AS DOUBLE) AS commas, CAST(capitals AS DOUBLE) AS capitals FROM items) ON length, lines, commas, capitals INTO NAME g VALUE y),
cors AS (SELECT rep, criterion, g, coalesce(CASE WHEN stddev_pop(s) * stddev_pop(y) <> 0 THEN covar_pop(s, y) / (stddev_pop(s) * stddev_pop(y)) END, 0) AS r FROM net JOIN dial USING (item) GROUP BY 1, 2, 3),
tops AS (SELECT rep, g, max(abs(r)) AS top FROM cors GROUP BY 1, 2)
SELECT t.rep, n_items, size AS n_pairs, n_criteria, count(*) AS n_dials, count(*) FILTER (top > {TAU}) AS n_recovered, round(avg(top), 6) AS mean_top
FROM tops t JOIN (SELECT rep, count(DISTINCT criterion) AS n_criteria FROM cors GROUP BY 1) c ON c.rep = t.rep JOIN sizes z ON z.rep = t.rep JOIN per ON per.rep = t.rep GROUP BY ALL"""


def own_rubric_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = items(spark, sf_dir)
    draws = it.select(F.col("doc_id").alias("item"), F.explode(F.sequence(F.lit(0), F.lit(REPS - 1))).alias("rep"))
    draws = draws.withColumn("rep", F.col("rep").cast("long")).filter(md5_number(F.concat_ws(":", F.lit("own"), F.col("rep").cast("string"), F.col("item").cast("string"))) % 10 < F.col("rep") % 9 + 1)
    p = pairs(spark, sf_dir).select("pair_index", "first", "other")
    drawn = written(resampling.drawn_pairs(p, draws), "drawn-pairs")
    rubric = resampling.own_rubrics(phrases(spark, sf_dir).select("pair_index", "phrase_norm", "winner_slot"), drawn, members(spark), LEAST_CITED, p.count())
    dials = it.select(F.col("doc_id").alias("item"), *[F.col(c).cast("double").alias(c) for c in NAMES]).unpivot("item", NAMES, "g", "y")
    out = resampling.recovery(resampling.net_wins(rubric, drawn), dials, TAU)
    return out.join(drawn.groupBy("rep", "n_items").agg(F.count("*").alias("n_pairs")), "rep")


@query("q_own_rubric_bootstrap", sql(OWN_SQL))
def own_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovery of four counts by each replicate of documents with a rubric, tensor and scores of its own."""
    out = own_rubric_replicates(spark, sf_dir)
    return out.select("rep", "n_items", "n_pairs", "n_criteria", "n_dials", "n_recovered", F.round("mean_top", 6).alias("mean_top"))


@query("q_own_rubric_bands")
def own_rubric_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and percentile bounds of the replicates' recovery."""
    return resampling.bands(own_rubric_replicates(spark, sf_dir), ["n_criteria", "share", "mean_top"])
