"""Queries over paired tests, correlations, recovery, resampling, vectors, costs and item selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import cosine, md5_number
from ..operators import costs, kernels, stats
from ..operators.order import numbered
from .fixtures import CRITERIA, items
from .graph_queries import cited, sql
from .registry import query, table

NAMES = [c for c, _ in CRITERIA]
MATCHED_SQL = """,
lab AS (SELECT i.*, quality, row_number() OVER (PARTITION BY quality ORDER BY i.doc_id) AS k FROM items i JOIN labels l ON l.doc_id = i.doc_id),
mp AS (SELECT p.k AS pair_id, p.doc_id AS pos_id, n.doc_id AS neg_id, p.length - n.length AS length, p.lines - n.lines AS lines, p.commas - n.commas AS commas, p.capitals - n.capitals AS capitals
  FROM lab p JOIN lab n ON n.k = p.k AND p.quality = 1 AND n.quality = 0),
diffs AS (UNPIVOT mp ON length, lines, commas, capitals INTO NAME feature VALUE d)"""


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-th good document beside the k-th poor one: ``pair_id, pos_id, neg_id`` and a difference per count."""
    it = items(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    side = lambda q: numbered(it.filter(F.col("quality") == q), ["doc_id"], "k").select((F.col("k") + 1).alias("pair_id"), F.col("doc_id").alias(f"id_{q}"), *[F.col(c).alias(f"{c}_{q}") for c in NAMES])
    m = side(1).join(side(0), "pair_id")
    return m.select("pair_id", F.col("id_1").alias("pos_id"), F.col("id_0").alias("neg_id"), *[(F.col(f"{c}_1") - F.col(f"{c}_0")).alias(c) for c in NAMES])


def long(df: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(keys, NAMES, name, value)


@query("q_matched_pairs", sql(MATCHED_SQL + " SELECT * FROM mp"))
def matched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(spark, sf_dir)


@query("q_win_rates_bh", sql(MATCHED_SQL + """,
c AS (SELECT feature, count(*) AS n, count(*) FILTER (d > 0) AS n_win, count(*) FILTER (d < 0) AS n_loss FROM diffs GROUP BY 1),
p AS (SELECT *, n - n_win - n_loss AS n_tie, (n_win + 0.5 * (n - n_win - n_loss)) / n AS wr, CASE WHEN n_win = n_loss THEN 1.0 ELSE
  least(1.0, 2 * list_sum(list_transform(range(0, least(n_win, n_loss) + 1), lambda i: exp(lgamma(n_win + n_loss + 1) - lgamma(i + 1) - lgamma(n_win + n_loss - i + 1) - (n_win + n_loss) * ln(2))))) END AS p FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM p)
SELECT feature, n, n_win, n_loss, n_tie, round(wr, 6) AS win_rate, round(wr - 1.96 * sqrt(wr * (1 - wr) / n), 6) AS lo, round(wr + 1.96 * sqrt(wr * (1 - wr) / n), 6) AS hi, round(p, 6) AS p,
  round(least(1.0, greatest(0.0, min(p * m / k) OVER (ORDER BY k DESC))), 6) AS q FROM r"""))
def win_rates_bh(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = stats.win_rates(long(matched(spark, sf_dir), ["pair_id"], "feature", "d"))
    return w.select("feature", "n", "n_win", "n_loss", "n_tie", *[F.round(c, 6).alias(c) for c in ("win_rate", "lo", "hi", "p", "q")])


@query("q_sign_deck_design", sql(MATCHED_SQL + """,
r AS (SELECT *, row_number() OVER (ORDER BY CAST('0x' || substr(md5('42:' || pair_id), 1, 8) AS BIGINT), pair_id) AS k, count(*) OVER () AS n FROM mp)
SELECT pair_id, CAST(CASE WHEN k <= n // 2 THEN 1 ELSE -1 END AS INTEGER) AS sign, length * CASE WHEN k <= n // 2 THEN 1 ELSE -1 END AS length, commas * CASE WHEN k <= n // 2 THEN 1 ELSE -1 END AS commas FROM r"""))
def sign_deck_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.sign_deck(matched(spark, sf_dir), "pair_id")
    return s.select("pair_id", "sign", *[(F.col(c) * F.col("sign")).alias(c) for c in ("length", "commas")])


@query("q_length_residual", sql(MATCHED_SQL + """,
b AS (SELECT feature, sum(d * length) / sum(length * length) AS slope FROM diffs JOIN (SELECT pair_id, length FROM mp) USING (pair_id) WHERE pair_id % 3 <> 0 GROUP BY 1)
SELECT d.feature, count(*) AS n, round(any_value(slope), 6) AS slope, round(avg(abs(d - slope * length)), 4) AS mean_abs_residual FROM diffs d JOIN b USING (feature) JOIN (SELECT pair_id, length FROM mp) USING (pair_id) GROUP BY 1"""))
def length_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences without what length explains: a slope through the origin, learnt on the pairs of the train split."""
    m = matched(spark, sf_dir)
    d = long(m, ["pair_id"], "feature", "d").join(m.select("pair_id", "length"), "pair_id")
    b = d.filter("pair_id % 3 <> 0").groupBy("feature").agg((F.sum(F.col("d") * F.col("length")) / F.sum(F.col("length") * F.col("length"))).alias("slope"))
    return d.join(F.broadcast(b), "feature").groupBy("feature").agg(F.count("*").alias("n"), F.round(F.first("slope"), 6).alias("slope"), F.round(F.avg(F.abs(F.col("d") - F.col("slope") * F.col("length"))), 4).alias("mean_abs_residual"))


@query("q_mcnemar", sql(""",
t AS (SELECT quality = 1 AS y, length > 1500 AS a, commas > 12 AS b FROM items JOIN labels USING (doc_id)),
c AS (SELECT count(*) FILTER ((a = y) AND NOT (b = y)) AS only_a, count(*) FILTER ((b = y) AND NOT (a = y)) AS only_b, avg(CASE WHEN a = y THEN 1.0 ELSE 0.0 END) AS acc_a, avg(CASE WHEN b = y THEN 1.0 ELSE 0.0 END) AS acc_b FROM t)
SELECT only_a, only_b, round(acc_a, 6) AS acc_a, round(acc_b, 6) AS acc_b, round(CASE WHEN only_a = only_b THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))))) END, 6) AS p FROM c"""))
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = items(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").select((F.col("quality") == 1).alias("y"), (F.col("length") > 1500).alias("a"), (F.col("commas") > 12).alias("b"))
    return stats.mcnemar(t, "y", "a", "b").select("only_a", "only_b", *[F.round(c, 6).alias(c) for c in ("acc_a", "acc_b", "p")])


@query("q_zero_shot_orders", """
WITH v AS (SELECT doc_id AS pair_id, o, CASE WHEN CAST('0x' || substr(md5(doc_id || ':' || o), 1, 8) AS BIGINT) % 10 < 6 THEN 'A' ELSE 'B' END AS slot, (doc_id % 2 = 0) = (o = 1) AS win_in_a FROM documents, (SELECT unnest([1, 2]) AS o)),
p AS (SELECT pair_id, max(CASE WHEN o = 1 THEN CAST((slot = 'A') = win_in_a AS INT) END) AS o1, max(CASE WHEN o = 2 THEN CAST((slot = 'A') = win_in_a AS INT) END) AS o2, max(CASE WHEN o = 1 THEN slot END) AS s1, max(CASE WHEN o = 2 THEN slot END) AS s2 FROM v GROUP BY 1)
SELECT count(*) AS n_pairs, round(avg(o1), 6) AS single_order_acc, round(avg(CASE WHEN o1 = o2 THEN o1 ELSE 0.5 END), 6) AS order_averaged_acc, round(avg(CASE WHEN o1 = o2 THEN 1.0 ELSE 0.0 END), 6) AS consistency,
  count(*) FILTER (o1 <> o2 AND s1 = 'A' AND s2 = 'A') AS named_first, count(*) FILTER (o1 <> o2 AND s1 = 'B' AND s2 = 'B') AS named_second FROM p""")
def zero_shot_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both orders of each pair side by side: accuracy, consistency and slot bias."""
    v = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("o"))
    v = v.withColumn("slot", F.when(md5_number(F.concat_ws(":", F.col("pair_id").cast("string"), F.col("o").cast("string"))) % 10 < 6, "A").otherwise("B"))
    v = v.withColumn("right", ((F.col("slot") == "A") == ((F.col("pair_id") % 2 == 0) == (F.col("o") == 1))).cast("int"))
    p = v.groupBy("pair_id").pivot("o", [1, 2]).agg(F.first("right").alias("r"), F.first("slot").alias("s"))
    same = F.col("1_r") == F.col("2_r")
    both = lambda s: F.count_if(~same & (F.col("1_s") == s) & (F.col("2_s") == s))
    return p.agg(F.count("*").alias("n_pairs"), F.round(F.avg("1_r"), 6).alias("single_order_acc"), F.round(F.avg(F.when(same, F.col("1_r").cast("double")).otherwise(0.5)), 6).alias("order_averaged_acc"), F.round(F.avg(same.cast("double")), 6).alias("consistency"), both("A").alias("named_first"), both("B").alias("named_second"))


DIALS_SQL = """,
f AS (UNPIVOT (SELECT doc_id AS item, CAST(length AS DOUBLE) AS length, CAST(lines AS DOUBLE) AS lines, CAST(commas AS DOUBLE) AS commas, CAST(capitals AS DOUBLE) AS capitals FROM items) ON length, lines, commas, capitals INTO NAME f VALUE x),
d AS (SELECT i.doc_id AS item, g, CASE g WHEN 'en' THEN CAST(d.lang = 'en' AS DOUBLE) WHEN 'size' THEN CAST(d.n_chars AS DOUBLE) WHEN 'parity' THEN CAST(i.doc_id % 2 AS DOUBLE) ELSE 1.0 END AS y FROM items i JOIN documents d USING (doc_id), (SELECT unnest(['en', 'size', 'parity', 'constant']) AS g)),
r AS (SELECT f, g, coalesce(CASE WHEN stddev_pop(x) * stddev_pop(y) <> 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END, 0) AS r FROM f JOIN d USING (item) GROUP BY 1, 2)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = items(spark, sf_dir).select(F.col("doc_id").alias("item"), *[F.col(c).cast("double").alias(c) for c in NAMES])
    return it.unpivot(["item"], NAMES, "f", "x")


def dials(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), (F.col("lang") == "en").cast("double").alias("en"), F.col("n_chars").cast("double").alias("size"), (F.col("doc_id") % 2).cast("double").alias("parity"), F.lit(1.0).alias("constant"))
    return d.unpivot(["item"], ["en", "size", "parity", "constant"], "g", "y")


@query("q_corr_matrix", sql(DIALS_SQL + " SELECT f, g, round(r, 6) + 0.0::DOUBLE AS r FROM r"))
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.correlations(features(spark, sf_dir), dials(spark, sf_dir)).withColumn("r", F.round("r", 6) + 0.0)


@query("q_spearman", sql(DIALS_SQL + """,
k AS (SELECT item, f, rank() OVER (PARTITION BY f ORDER BY x) + (count(*) OVER (PARTITION BY f, x) - 1) / 2.0 AS x FROM f)
SELECT a.f AS f, b.f AS g, round(CASE WHEN stddev_pop(a.x) * stddev_pop(b.x) <> 0 THEN covar_pop(a.x, b.x) / (stddev_pop(a.x) * stddev_pop(b.x)) ELSE 0 END, 6) + 0.0::DOUBLE AS r FROM k a JOIN k b USING (item) GROUP BY 1, 2"""))
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = stats.ranked(features(spark, sf_dir), "f", "x")
    return stats.correlations(k, k.select("item", F.col("f").alias("g"), F.col("x").alias("y"))).withColumn("r", F.round("r", 6) + 0.0)


@query("q_effective_rank", sql(DIALS_SQL + """,
m AS (SELECT a.f AS f, b.f AS g, covar_pop(a.x, b.x) / (stddev_pop(a.x) * stddev_pop(b.x)) AS r FROM f a JOIN f b USING (item) GROUP BY 1, 2)
SELECT round(pow(count(DISTINCT f), 2) / sum(r * r), 6) AS effective_rank FROM m"""))
def effective_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    r = stats.correlations(f, f.select("item", F.col("f").alias("g"), F.col("x").alias("y")))
    return stats.effective_rank(r).select(F.round("effective_rank", 6).alias("effective_rank"))


@query("q_recovery_scores", sql(DIALS_SQL + """,
best AS (SELECT g, max(abs(r)) AS top, sum(r * r) AS ss, arg_max(f, (abs(r), f)) AS tracker FROM r GROUP BY 1),
ok AS (SELECT f, count(*) FILTER (top > 0.4 AND top * top / ss > 0.5 AND tracker = f) AS own FROM r JOIN best USING (g) GROUP BY 1)
SELECT g, tracker, round(top, 6) AS top, top > 0.4 AS tracked, coalesce(top > 0.4 AND top * top / nullif(ss, 0) > 0.5, false) AS attributable FROM best"""))
def recovery_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per dial: the feature that follows it best, whether it is tracked, and whether one feature alone accounts for it."""
    r = stats.correlations(features(spark, sf_dir), dials(spark, sf_dir))
    best = r.groupBy("g").agg(F.max(F.abs("r")).alias("top"), F.sum(F.col("r") * F.col("r")).alias("ss"), F.max_by("f", F.struct(F.abs("r"), "f")).alias("tracker"))
    alone = F.coalesce((F.col("top") > 0.4) & (F.col("top") * F.col("top") / F.when(F.col("ss") != 0, F.col("ss")) > 0.5), F.lit(False))
    return best.select("g", "tracker", F.round("top", 6).alias("top"), (F.col("top") > 0.4).alias("tracked"), alone.alias("attributable"))


@query("q_bootstrap_bands", sql(""",
u AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, CASE WHEN (length > 1500) = (quality = 1) THEN 1.0 ELSE 0.0 END AS a, CASE WHEN (commas > 12) = (quality = 1) THEN 1.0 ELSE 0.0 END AS b FROM items JOIN labels USING (doc_id)),
x AS (SELECT rep, CAST('0x' || substr(md5('0:' || rep || ':' || pos), 1, 8) AS BIGINT) % (SELECT count(*) FROM u) AS i FROM (SELECT unnest(range(400)) AS rep), (SELECT unnest(range((SELECT count(*) FROM u))) AS pos)),
m AS (SELECT rep, avg(a) AS a, avg(b) AS b FROM x JOIN u USING (i) GROUP BY 1)
SELECT round(quantile_cont(a, 0.025), 6) AS a_lo, round(quantile_cont(a, 0.975), 6) AS a_hi, round(quantile_cont(b, 0.025), 6) AS b_lo, round(quantile_cont(b, 0.975), 6) AS b_hi,
  round(quantile_cont(a - b, 0.025), 6) AS d_lo, round(quantile_cont(a - b, 0.975), 6) AS d_hi, count(*) FILTER (a > b) AS wins FROM m"""))
def bootstrap_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arms on shared resamples: marginal bands, the paired difference's band, and how often the first is ahead."""
    t = items(spark, sf_dir).drop("i").join(table(spark, sf_dir, "labels"), "doc_id")
    right = lambda c: F.when(c == (F.col("quality") == 1), 1.0).otherwise(0.0)
    u = numbered(t.select("doc_id", right(F.col("length") > 1500).alias("a"), right(F.col("commas") > 12).alias("b")), ["doc_id"])
    m = stats.replicate_index(u, u.count(), 400).join(u, "i").groupBy("rep").agg(F.avg("a").alias("a"), F.avg("b").alias("b")).withColumn("d", F.col("a") - F.col("b"))
    band = [F.round(F.percentile(c, F.lit(p)), 6).alias(f"{c}_{n}") for c in ("a", "b", "d") for n, p in (("lo", 0.025), ("hi", 0.975))]
    return m.agg(*band, F.count_if(F.col("d") > 0).alias("wins"))


@query("q_cosine_medoid", """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
t AS (SELECT label, pos, sum(x) AS x FROM (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS pos FROM e) GROUP BY 1, 2),
s AS (SELECT label, list(x ORDER BY pos) AS c FROM t GROUP BY 1),
r AS (SELECT label, vec_id, list_sum(list_transform(list_zip(v, c), lambda z: z[1] * z[2])) AS mass FROM e JOIN s USING (label)),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(mass, 6) DESC, vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM r)
SELECT label, vec_id, n, round(mass / n, 5) AS mean_cosine FROM k WHERE k = 1""")
def cosine_medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector with the largest sum of cosines to its group: the sum is one product with the group's total."""
    e = table(spark, sf_dir, "embeddings")
    t = e.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.sum(F.col("x").cast("double")).alias("x"))
    c = t.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("c"))
    r = e.join(F.broadcast(c), "label").select("label", "vec_id", cosine(F.col("embedding"), F.col("c")).alias("mass"))
    best = F.min(F.struct((-F.round("mass", 6)).alias("m"), "vec_id", "mass")).alias("b")
    return r.groupBy("label").agg(best, F.count("*").alias("n")).select("label", "b.vec_id", "n", F.round(F.col("b.mass") / F.col("n"), 5).alias("mean_cosine"))


@query("q_linkage")
def linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average linkage of each label's vectors at cosine 0.3: one task per label, as large as a label."""
    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        v = np.stack(pdf["embedding"].to_numpy()).astype(float)
        return pd.DataFrame({"label": pdf["label"], "vec_id": pdf["vec_id"], "cluster": kernels.average_linkage_of(v, 0.3)})

    return table(spark, sf_dir, "embeddings").groupBy("label").applyInPandas(cut, "label int, vec_id long, cluster int")


@query("q_hungarian")
def hungarian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dials matched to features at the largest total of absolute correlations; the matrix has a row per dial."""
    r = stats.correlations(features(spark, sf_dir), dials(spark, sf_dir)).withColumn("one", F.lit(1))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="g", columns="f", values="r").sort_index().sort_index(axis=1)
        pairs = kernels.assignment(-m.abs().to_numpy())
        return pd.DataFrame({"g": [m.index[i] for i, _ in pairs], "f": [m.columns[j] for _, j in pairs], "r": [m.iloc[i, j] for i, j in pairs]})

    return r.groupBy("one").applyInPandas(match, "g string, f string, r double")


@query("q_dimensionality")
def dimensionality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participation ratio and entropy rank of the features' correlations, per source, side by side."""
    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[NAMES].rank().to_numpy()
        x = x - x.mean(axis=0)
        sd = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
        r = (x / sd).T @ (x / sd) / len(x)
        np.fill_diagonal(r, 1.0)
        return pd.DataFrame({"source": [pdf["source"].iloc[0]], "n": [len(pdf)], "participation": [kernels.participation_ratio(r)], "entropy_rank": [kernels.entropy_rank(r)]})

    return items(spark, sf_dir).select("source", *NAMES).groupBy("source").applyInPandas(measure, "source string, n long, participation double, entropy_rank double")


PRICES = (("gpt-small", 0.25, 2.0), ("gpt-small-mini", 0.1, 0.8), ("judge", 1.0, 5.0))


@query("q_price_match", f"""
WITH prices(name, pi, po) AS (VALUES {', '.join(f"('{n}', {a}, {b})" for n, a, b in PRICES)}),
q AS (SELECT event_id, ['gpt-small', 'gpt-small-mini-2026', 'gpt-small-2026', 'judge', 'other'][1 + event_id % 5] AS model, 1000 + event_id % 700 AS tin, 100 + event_id % 90 AS tout, event_id % 2 = 0 AS batch FROM events),
m AS (SELECT q.*, coalesce(arg_max(pi, length(name)), 2.5) AS pi, coalesce(arg_max(po, length(name)), 10.0) AS po FROM q LEFT JOIN prices ON starts_with(model, name) GROUP BY ALL)
SELECT model, count(*) AS n, CAST(sum(tin) AS BIGINT) AS input_tokens, sum((tin * CAST(round(pi * 10000) AS BIGINT) + tout * CAST(round(po * 10000) AS BIGINT)) * CASE WHEN batch THEN 1 ELSE 2 END)::DOUBLE / 2e10::DOUBLE AS usd FROM m GROUP BY 1""")
def price_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("gpt-small", "gpt-small-mini-2026", "gpt-small-2026", "judge", "other")))
    usage = F.concat(F.lit('{"prompt_tokens": '), 1000 + F.col("event_id") % 700, F.lit(', "completion_tokens": '), 100 + F.col("event_id") % 90, F.lit("}"))
    e = table(spark, sf_dir, "events").select(F.get(names, (F.col("event_id") % 5).cast("int")).alias("model"), (F.col("event_id") % 2 == 0).alias("batch"), usage.alias("usage"))
    e = costs.priced(e.withColumns(costs.tokens_used(F.col("usage"))), spark.createDataFrame(list(PRICES), "name string, price_in double, price_out double"))
    cost = costs.cost_units(F.col("input_tokens"), F.col("output_tokens"), F.col("price_in"), F.col("price_out"), F.col("batch"))
    return e.groupBy("model").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("input_tokens"), (F.sum(cost) / costs.UNITS).alias("usd"))


@query("q_cache_partition", """
WITH r AS (SELECT conv_id, turn, md5(conv_id || ':' || (turn // 2)) AS h FROM conversations),
c AS (SELECT md5(conv_id || ':' || (turn // 2)) AS h, min(CASE WHEN turn % 5 = 4 THEN 1 ELSE 0 END) AS bad FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT CASE WHEN h IN (SELECT h FROM c WHERE bad = 0) THEN 'hit' ELSE 'miss' END AS part, count(*) AS n, count(DISTINCT h) AS requests FROM r GROUP BY 1""")
def cache_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    h = F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), F.expr("turn div 2").cast("string"))).alias("request_hash")
    cache = c.filter("role = 'user'").select(h, F.when(F.col("turn") % 5 == 4, "failed").alias("error"), "text")
    kept = costs.merged_cache(cache.filter("error is not null"), cache)
    parts = costs.cache_split(c.select("conv_id", "turn", h), kept)
    both = [p.withColumn("part", F.lit(n)) for p, n in zip(parts, ("hit", "miss"), strict=True)]
    return both[0].unionByName(both[1]).groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("request_hash").alias("requests"))


@query("q_cost_line", """
WITH s AS (SELECT o_custkey % 20 + 5 AS k, CAST(o_totalprice AS DOUBLE) / 1e5 AS usd FROM orders)
SELECT round(regr_slope(usd, k), 8) AS slope, round(regr_intercept(usd, k), 6) AS intercept, CAST(greatest(1, floor((100 - regr_intercept(usd, k)) / avg(usd))) AS BIGINT) AS n_star FROM s""")
def cost_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost per request as a line in the number of criteria, and how many replicates a budget of 100 buys."""
    s = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20 + 5).alias("k"), (F.col("o_totalprice").cast("double") / 1e5).alias("usd"))
    n = F.greatest(F.lit(1), F.floor((100 - F.regr_intercept("usd", "k")) / F.avg("usd"))).cast("long")
    return s.agg(F.round(F.regr_slope("usd", "k"), 8).alias("slope"), F.round(F.regr_intercept("usd", "k"), 6).alias("intercept"), n.alias("n_star"))


@query("q_eligible_sample", sql(""",
e AS (SELECT pair_id, pos_id, neg_id, CAST('0x' || substr(md5('7:' || pair_id), 1, 8) AS BIGINT) AS h FROM mp JOIN items p ON p.doc_id = pos_id JOIN items n ON n.doc_id = neg_id WHERE p.length BETWEEN 50 AND 5000 AND n.length BETWEEN 50 AND 5000),
s AS (SELECT *, row_number() OVER (ORDER BY h, pair_id) AS k FROM e)
SELECT format('wa{:04d}', row_number() OVER (ORDER BY pair_id, side DESC) - 1) AS item_id, pair_id, side, CASE side WHEN 'pos' THEN pos_id ELSE neg_id END AS doc_id FROM s, (SELECT unnest(['pos', 'neg']) AS side) WHERE k <= 20""".replace(",\ne AS", MATCHED_SQL + ",\ne AS", 1)))
def eligible_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty eligible pairs by a seeded hash, both sides as items in table order (a sampling operator)."""
    it = items(spark, sf_dir)
    ok = it.filter(F.col("length").between(50, 5000)).select("doc_id")
    e = matched(spark, sf_dir).select("pair_id", "pos_id", "neg_id")
    e = e.join(ok.withColumnRenamed("doc_id", "pos_id"), "pos_id", "left_semi").join(ok.withColumnRenamed("doc_id", "neg_id"), "neg_id", "left_semi")
    s = e.orderBy(md5_number(F.concat_ws(":", F.lit("7"), F.col("pair_id").cast("string"))), "pair_id").limit(20)
    both = s.select("pair_id", F.explode(F.array(F.struct(F.lit("pos").alias("side"), F.col("pos_id").alias("doc_id")), F.struct(F.lit("neg").alias("side"), F.col("neg_id").alias("doc_id")))).alias("e")).select("pair_id", "e.*")
    return both.select(F.format_string("wa%04d", F.row_number().over(W.orderBy("pair_id", F.desc("side"))) - 1).alias("item_id"), "pair_id", "side", "doc_id")


@query("q_failure_bins", """
WITH p AS (SELECT user_id, count(*) AS n, avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) AS r FROM events GROUP BY 1)
SELECT CASE WHEN r <= 0 THEN '0' WHEN r <= 0.02 THEN '(0, 0.02]' WHEN r <= 0.05 THEN '(0.02, 0.05]' WHEN r <= 0.1 THEN '(0.05, 0.1]' WHEN r <= 0.2 THEN '(0.1, 0.2]' WHEN r <= 0.5 THEN '(0.2, 0.5]' ELSE '(0.5, 1]' END AS bin, count(*) AS n_users, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1""")
def failure_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg(F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)).alias("r"))
    edges = (0, 0.02, 0.05, 0.1, 0.2, 0.5, 1)
    label = F.when(F.col("r") <= 0, "0")
    for lo, hi in zip(edges, edges[1:], strict=False):
        label = label.when(F.col("r") <= hi, f"({lo}, {hi}]")
    return p.groupBy(label.alias("bin")).agg(F.count("*").alias("n_users"), F.sum("n").alias("n"))


@query("q_pivot_panels", """
WITH a AS (SELECT user_id AS item, event_type AS criterion, avg(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2),
b AS (SELECT user_id AS item, event_type AS criterion, avg(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2),
m AS (SELECT item, criterion, avg(v) AS v FROM (SELECT * FROM a UNION ALL SELECT b.* FROM b WHERE criterion IN (SELECT criterion FROM a)) GROUP BY 1, 2)
SELECT item, round(max(CASE WHEN criterion = 'click' THEN v END), 6) AS click, round(max(CASE WHEN criterion = 'view' THEN v END), 6) AS view, round(max(CASE WHEN criterion = 'purchase' THEN v END), 6) AS purchase FROM m GROUP BY 1""")
def pivot_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of a panel averaged cell by cell over the first run's criteria, then one column per criterion."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.col("event_type").alias("criterion"), "value", "event_id")
    mean = lambda d: d.groupBy("item", "criterion").agg(F.avg("value").alias("v"))
    a, b = mean(e.filter("event_id % 2 = 0")), mean(e.filter("event_id % 2 = 1"))
    m = a.unionByName(b.join(a.select("criterion").distinct(), "criterion", "left_semi")).groupBy("item", "criterion").agg(F.avg("v").alias("v"))
    return m.groupBy("item").pivot("criterion", ["click", "view", "purchase"]).agg(F.round(F.first("v"), 6))


@query("q_induced_subgraph", sql(""",
draw AS (SELECT rep, i FROM items, (SELECT unnest(range(5)) AS rep) WHERE CAST('0x' || substr(md5(rep || ':' || i), 1, 8) AS BIGINT) % 3 > 0)
SELECT d.rep, count(*) AS n_pairs, count(DISTINCT p.a) AS n_a FROM pairs p JOIN draw d ON d.i = p.a JOIN draw e ON e.i = p.b AND e.rep = d.rep GROUP BY 1"""))
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which a replicate drew both ends, for all replicates in one pass."""
    from .fixtures import pairs

    it = items(spark, sf_dir).select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("rep"), "i").filter(md5_number(F.concat_ws(":", F.col("rep").cast("string"), F.col("i").cast("string"))) % 3 > 0)
    p = pairs(spark, sf_dir).join(it.withColumnRenamed("i", "a"), "a").join(it.withColumnRenamed("i", "b"), ["rep", "b"], "left_semi")
    return p.groupBy(F.col("rep").cast("long").alias("rep")).agg(F.count("*").alias("n_pairs"), F.countDistinct("a").alias("n_a"))


@query("q_set_operations", """
WITH a AS (SELECT DISTINCT source FROM documents WHERE lang = 'en'), b AS (SELECT DISTINCT source FROM documents WHERE lang = 'es')
SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'left', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'any', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)
UNION ALL SELECT 'differ', count(*) FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)) UNION ALL SELECT 'texts', count(*) FROM (SELECT text FROM documents GROUP BY text)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    a, b = d.filter("lang = 'en'").select("source").distinct(), d.filter("lang = 'es'").select("source").distinct()
    parts = {"both": a.intersect(b), "left": a.subtract(b), "any": a.union(b).distinct(), "differ": a.subtract(b).union(b.subtract(a)), "texts": d.groupBy("text").agg(F.min("doc_id"))}
    out = None
    for name, p in parts.items():
        row = p.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("q_citation_counts", sql("""
SELECT c.phrase_norm, count(DISTINCT c.pair_index) AS n_pairs, round(count(*) / (SELECT count(*) FROM cites), 6) AS share FROM cites c JOIN (SELECT DISTINCT phrase_norm FROM members) USING (phrase_norm) GROUP BY 1"""))
def citation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .graph_queries import phrases

    p, placed = phrases(spark, sf_dir), cited(spark, sf_dir).filter("criterion is not null")
    return placed.groupBy("phrase_norm").agg(F.countDistinct("pair_index").alias("n_pairs"), F.round(F.count("*") / p.count(), 6).alias("share"))


