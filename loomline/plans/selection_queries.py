"""Queries over selections and penalised models; numerical, so checked by identities in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import md5_number
from ..operators import selection
from .graph_queries import sql
from .registry import query, table
from .stat_queries import MATCHED_SQL, NAMES, items, matched


@query("q_l1_paired")
def l1_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out predictions from signed differences of matched pairs, with two feature sets as arms."""
    m = matched(spark, sf_dir)
    sign = F.when(md5_number(F.concat(F.lit("s"), F.col("pair_id").cast("string"))) % 2 == 0, 1.0).otherwise(-1.0)
    d = m.select("pair_id", (F.col("pos_id") % 20).cast("string").alias("grp"), (F.col("pair_id") % 3 != 0).alias("train"), (sign > 0).cast("int").alias("y"), *[(F.col(c) * sign).alias(c) for c in NAMES])
    arms = d.withColumn("arm", F.explode(F.array(F.lit("all"), F.lit("length only"))))
    arms = arms.withColumns({c: F.when((F.col("arm") == "all") | F.lit(c == "length"), F.col(c)).otherwise(0.0) for c in NAMES})
    return selection.grouped_selection(arms, NAMES)


@query("q_matched_k")
def matched_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensionality against the number of features, per source, with a simultaneous band."""
    it = items(spark, sf_dir).select(F.col("source").alias("arm"), F.col("doc_id").alias("item"), *NAMES)
    return selection.matched_k(it, NAMES, reps=20)


@query("q_pack_to_budget", sql(MATCHED_SQL + """,
c AS (SELECT CASE WHEN pair_id % 3 = 0 THEN 'test' ELSE 'train' END AS split, pair_id, n_chars / 4.0::DOUBLE AS est_tokens FROM mp JOIN documents d ON d.doc_id = pos_id),
r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY est_tokens, pair_id) - 1 AS place, count(*) OVER (PARTITION BY split) AS n FROM c),
k AS (SELECT DISTINCT split, n, unnest(range(1, n + 1)) AS k FROM r),
p AS (SELECT DISTINCT split, k, CASE WHEN k = 1 THEN 0 ELSE CAST(round_even(j * ((n - 1)::DOUBLE / (k - 1)), 0) AS BIGINT) END AS place FROM (SELECT *, unnest(range(k)) AS j FROM k)),
s AS (SELECT p.split, p.k, sum(est_tokens) AS total FROM p JOIN r ON r.split = p.split AND r.place = p.place GROUP BY 1, 2),
b AS (SELECT split, max(k) AS k FROM s WHERE total <= 20000 * CASE split WHEN 'train' THEN 1.0::DOUBLE / 3 ELSE 2.0::DOUBLE / 3 END GROUP BY 1)
SELECT r.split, r.pair_id, r.est_tokens FROM b JOIN p USING (split, k) JOIN r ON r.split = p.split AND r.place = p.place"""))
def pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An even span of pairs, short to long, in a token budget split one to two between train and test."""
    m = matched(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos_id"), "n_chars"), "pos_id")
    c = m.select(F.when(F.col("pair_id") % 3 == 0, "test").otherwise("train").alias("split"), "pair_id", (F.col("n_chars") / 4.0).alias("est_tokens"))
    return selection.pack_to_budget(c, 20_000, {"train": 1 / 3, "test": 2 / 3})


@query("q_near_orthogonal")
def near_orthogonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A balanced design of 40 items and five dials, the best of 256 candidates."""
    return selection.near_orthogonal(table(spark, sf_dir, "region"), 40, [3, 3, 2, 2, 4], 256)
