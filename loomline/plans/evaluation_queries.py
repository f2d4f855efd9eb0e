"""Queries over forecasts, recovery of known dials, panels from several cells, and probes of judges."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import half_away, md5_number
from ..operators import calibration as C
from ..operators import panels, recovery, stats
from .graph_queries import sql
from .registry import query, table
from .stat_queries import DIALS_SQL, MATCHED_SQL, NAMES, dials, features, long, matched

REPS = 100
MD5 = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
#: Forecasts of three gates per document, a hashed outcome, a masked seventh, and the observed rate as reference.
#: Forecasts are multiples of 1/512, so that their sums are exact in any order.
CELLS_SQL = f"""
WITH f AS (SELECT doc_id AS t, source, lang, k, ((doc_id * 37 + k * 11) % 101 * 5 + 6) / 512.0::DOUBLE AS p,
    CASE WHEN {MD5.format("doc_id || ':' || k")} % 100 < (doc_id * 37 + k * 11) % 101 - 5 * k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM documents, (SELECT CAST(unnest(range(3)) AS INTEGER) AS k) WHERE (doc_id + k) % 7 <> 0),
c AS (SELECT *, avg(y) OVER (PARTITION BY k) AS pr FROM f)"""
U = f"{MD5.format('''rep || ':' || t''')} / 4294967296.0::DOUBLE"
WEIGHT = f"CASE WHEN rep = 0 THEN 1 ELSE {' + '.join(f'CAST({U} >= {c!r}::DOUBLE AS INT)' for c in C.POISSON)} END"
BINS_SQL = CELLS_SQL + f""",
b0 AS (SELECT k, t, (SELECT count(*) FROM (SELECT unnest(range(1, 10)) AS e) WHERE p >= e * CAST(0.1 AS DOUBLE)) AS bin, count(*) AS n, sum(p) AS sp, sum(y) AS sy, sum((p - y) * (p - y)) AS se, sum((pr - y) * (pr - y)) AS sr FROM c GROUP BY ALL),
b1 AS (SELECT b0.*, rep, {WEIGHT} AS w FROM b0, (SELECT unnest(range({REPS + 1})) AS rep)),
b AS (SELECT k, rep, bin, sum(w * n) AS n, sum(w * sp) AS sp, sum(w * sy) AS sy, sum(w * se) AS se, sum(w * sr) AS sr FROM b1 GROUP BY ALL)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("t"), "source", "lang", F.explode(F.array(*map(F.lit, range(3)))).alias("k")).filter("(t + k) % 7 <> 0")
    base = (F.col("t") * 37 + F.col("k") * 11) % 101
    h = md5_number(F.concat_ws(":", F.col("t").cast("string"), F.col("k").cast("string"))) % 100
    c = d.withColumns({"p": (base * 5 + 6) / 512.0, "y": F.when(h < base - 5 * F.col("k"), 1.0).otherwise(0.0)})
    return c.join(F.broadcast(c.groupBy("k").agg(F.avg("y").alias("pr"))), "k")


def rounded(df: DataFrame, keep: list[str], names: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keep, *[(half_away(F.col(c), digits) + 0.0).alias(c) for c in names])


def _bounds(names) -> str:
    return ", ".join(f"round(max(CASE WHEN rep = 0 THEN {c} END), 6) + 0.0::DOUBLE AS {c}, round(quantile_cont(CASE WHEN rep > 0 THEN {c} END, 0.025), 6) + 0.0::DOUBLE AS {c}_lo, round(quantile_cont(CASE WHEN rep > 0 THEN {c} END, 0.975), 6) + 0.0::DOUBLE AS {c}_hi" for c in names)


def _three(names) -> list[str]:
    return [x for c in names for x in (c, f"{c}_lo", f"{c}_hi")]


@query("q_calibration_intervals", BINS_SQL + f""",
s AS (SELECT k, rep, sum(n) AS n, sum(abs(sp - sy)) / nullif(sum(n), 0) AS ece, sum(se) / nullif(sum(n), 0) AS brier, 1 - sum(se) / nullif(sum(n), 0) / 0.25 AS bss_chance, 1 - sum(se) / nullif(sum(sr), 0) AS bss_emp FROM b GROUP BY ALL)
SELECT k, CAST(max(CASE WHEN rep = 0 THEN n END) AS BIGINT) AS n, {_bounds(C.STATS)} FROM s GROUP BY k""")
def calibration_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration with intervals over resampled documents, all gates of a document together."""
    return rounded(C.calibration_intervals(cells(spark, sf_dir), ["k"], "t", REPS, md5=True), ["k", "n"], _three(C.STATS))


@query("q_calibration_bins", BINS_SQL + f""",
s AS (SELECT k, bin, rep, n, sp / nullif(n, 0) AS p_mean, sy / nullif(n, 0) AS y_mean FROM b)
SELECT k, CAST(bin AS INTEGER) AS bin, CAST(max(CASE WHEN rep = 0 THEN n END) AS BIGINT) AS n, {_bounds(("p_mean", "y_mean"))} FROM s GROUP BY k, bin""")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.bin_rates(cells(spark, sf_dir), ["k"], "t", REPS, md5=True), ["k", "bin", "n"], _three(("p_mean", "y_mean")))


@query("q_ece_two_ways", BINS_SQL + """,
m AS (SELECT k, (SELECT count(*) FROM (SELECT unnest(range(1, 10)) AS e) WHERE p >= e * CAST(0.1 AS DOUBLE)) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM c GROUP BY ALL)
SELECT k, round(sum(n * gap) / sum(n), 6) AS ece, true AS agrees FROM m GROUP BY k""")
def ece_two_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibration error from means, and whether the one from sums agrees within 1e-10."""
    c = cells(spark, sf_dir)
    a = C.ece_of_means(c, ["k"])
    b = C.calibration_intervals(c, ["k"], "t", 1).select("k", F.col("ece").alias("other"))
    return a.join(b, "k").select("k", F.round("ece", 6).alias("ece"), (F.abs(F.col("ece") - F.col("other")) < 1e-10).alias("agrees"))


METRICS_SQL = """n, round(log_loss, 6) AS log_loss, round(accuracy, 6) AS accuracy, round(rate, 6) AS rate, round(mean_p, 6) AS mean_p FROM (
  SELECT {by}, count(*) AS n, avg(-(y * ln(greatest(least(p, 1 - 1e-12), 1e-12)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-12), 1e-12)))) AS log_loss, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy, avg(y) AS rate, avg(p) AS mean_p FROM c GROUP BY {by})"""


@query("q_forecast_metrics", CELLS_SQL + " SELECT k, " + METRICS_SQL.format(by="k"))
def forecast_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.forecast_metrics(cells(spark, sf_dir), ["k"]), ["k", "n"], ["log_loss", "accuracy", "rate", "mean_p"])


@query("q_calibration_table", CELLS_SQL + " SELECT source, lang, k, " + METRICS_SQL.format(by="source, lang, k"))
def calibration_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of every corpus, judge and gate in one pass (source and language stand in)."""
    by = ["source", "lang", "k"]
    return rounded(C.forecast_metrics(cells(spark, sf_dir), by), [*by, "n"], ["log_loss", "accuracy", "rate", "mean_p"])


JUDGES = 3
GS = ("constant", "en", "parity", "size")
COS_SQL = f""",
mv AS (SELECT vec_id % {JUDGES} AS j, label, pos, avg(v) AS v FROM (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL),
cosines AS (
  SELECT a.j, f, g, sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)) AS cos FROM mv a JOIN mv b ON b.j = a.j AND b.pos = a.pos
  JOIN (VALUES {', '.join(f"({i}, '{f}')" for i, f in enumerate(NAMES))}) nf(label, f) ON nf.label = a.label
  JOIN (VALUES {', '.join(f"({i + len(NAMES)}, '{g}')" for i, g in enumerate(GS))}) ng(label, g) ON ng.label = b.label GROUP BY ALL),
orders(pid, g, f) AS (VALUES {', '.join(f"({i}, '{g}', '{f}')" for i, perm in enumerate(itertools.permutations(sorted(NAMES))) for g, f in zip(GS, perm, strict=True))}),
sums AS (SELECT j, pid, sum(cos) AS total FROM orders JOIN cosines USING (f, g) GROUP BY ALL),
best AS (SELECT j, arg_max(pid, total) AS pid FROM sums GROUP BY 1),
matches AS (SELECT b.j, o.g, o.f, c.cos FROM best b JOIN orders o USING (pid) JOIN cosines c ON c.j = b.j AND c.f = o.f AND c.g = o.g)"""


def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.correlations(features(spark, sf_dir), dials(spark, sf_dir))


def cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities of every feature with every dial: cosines of mean vectors of labels that stand for them.

    A third of the vectors each belongs to one of three judges.
    """
    v = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % JUDGES).alias("j"), "label", F.posexplode("embedding").alias("pos", "v"))
    mean = v.groupBy("j", "label", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    named = lambda names, first: F.element_at(F.array(*map(F.lit, names)), F.col("label") - first + 1)
    f = mean.filter(F.col("label").between(0, len(NAMES) - 1)).select("j", "pos", named(NAMES, 0).alias("f"), F.col("v").alias("a"))
    g = mean.filter(F.col("label").between(len(NAMES), len(NAMES) + len(GS) - 1)).select("j", "pos", named(GS, len(NAMES)).alias("g"), F.col("v").alias("b"))
    dot = lambda x, y: F.sum(F.col(x) * F.col(y))
    return f.join(g, ["j", "pos"]).groupBy("j", "f", "g").agg((dot("a", "b") / F.sqrt(dot("a", "a") * dot("b", "b"))).alias("cos"))


@query("q_semantic_matches", sql(DIALS_SQL + COS_SQL + " SELECT j, g, f, round(cos, 6) AS cos FROM matches"))
def semantic_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.matched(cosines(spark, sf_dir), ["j"]).withColumn("cos", F.round("cos", 6))


@query("q_theta_calibration", sql(DIALS_SQL + COS_SQL + " SELECT round(quantile_cont(c.cos, 0.95), 6) AS theta, count(*) AS n FROM cosines c ANTI JOIN matches m ON m.j = c.j AND m.f = c.f AND m.g = c.g"))
def theta_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95th percentile of cosines that no matching picked: the least cosine to be taken for a match."""
    return recovery.rejected_quantile(cosines(spark, sf_dir), ["j"]).select(F.round("theta", 6).alias("theta"), "n")


TAUS = (0.3, 0.35, 0.4, 0.45, 0.5)


@query("q_recovery_scorecard", sql(DIALS_SQL + COS_SQL + f""",
taus AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in TAUS)}]) AS tau), a AS (SELECT f, g, abs(r) AS a FROM r),
dial AS (SELECT g, max(a) AS top, arg_min(f, (-a, f)) AS tracker FROM a GROUP BY 1),
k AS (SELECT f, max(a) AS top, sum(a * a) AS ss FROM a GROUP BY 1),
alone AS (SELECT tau, f, coalesce(top > tau AND top * top / nullif(ss, 0) > 0.5, false) AS alone FROM k, taus),
one AS (SELECT tau, count(*) FILTER (top > tau) AS n_tracked, avg(CAST(top > tau AS INT)) AS sf, avg(top) AS sm, avg(CAST(coalesce(m.cos >= {recovery.THETA} AND x.a > tau, false) AS INT)) AS sr FROM taus, dial d LEFT JOIN matches m ON m.g = d.g AND m.j = 0 LEFT JOIN a x ON x.g = d.g AND x.f = m.f GROUP BY 1),
lk AS (SELECT tau, avg(l) AS lk FROM (SELECT tau, a.g, avg(a.a) AS l FROM a JOIN dial d USING (g) JOIN alone n ON n.f = a.f AND n.alone WHERE a.f <> d.tracker GROUP BY 1, 2) GROUP BY 1)
SELECT tau, (SELECT count(*) FROM k) AS k, n_tracked, round(sf, 6) AS sf, round(sm, 6) AS sm, round(sr, 6) AS sr, (SELECT round(avg(CAST(alone AS INT)), 6) FROM alone n WHERE n.tau = one.tau) AS af, round(lk, 6) AS lk FROM one LEFT JOIN lk USING (tau)"""))
def recovery_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All recovery scores of one method at every threshold of a sweep."""
    m = recovery.matched(cosines(spark, sf_dir).filter("j = 0"), ["j"])
    return rounded(recovery.scorecard(correlation(spark, sf_dir), m, list(TAUS)), ["tau", "k", "n_tracked"], ["sf", "sm", "sr", "af", "lk"])


PERMS = 5


@query("q_permutation_floor", sql(DIALS_SQL + f""",
ii AS (SELECT doc_id, i FROM items),
pl AS (SELECT rep, i, row_number() OVER (PARTITION BY rep ORDER BY {MD5.format("'perm:' || rep || ':' || i")}, i) - 1 AS t FROM ii, (SELECT unnest(range({PERMS})) AS rep)),
s AS (SELECT rep, t AS i, g, y FROM d JOIN ii ON ii.doc_id = d.item JOIN pl ON pl.i = ii.i),
q AS (SELECT rep, f, g, coalesce(CASE WHEN stddev_pop(x) * stddev_pop(y) <> 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END, 0) AS r FROM f JOIN ii ON ii.doc_id = f.item JOIN s USING (i) GROUP BY 1, 2, 3),
top AS (SELECT rep, g, max(abs(r)) AS top FROM q GROUP BY 1, 2)
SELECT round(avg(top), 6) AS mean_top, round(quantile_cont(top, 0.95), 6) AS p95_top, count(*) AS n FROM top"""))
def permutation_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fixtures import items

    ids = items(spark, sf_dir).select(F.col("doc_id").alias("item"), "i")
    f, d = features(spark, sf_dir).join(ids, "item").drop("item"), dials(spark, sf_dir).join(ids, "item").drop("item")
    floor = recovery.permutation_floor(f, d, PERMS)
    return floor.select(F.round("mean_top", 6).alias("mean_top"), F.round("p95_top", 6).alias("p95_top"), "n")


@query("q_dial_matrix", """
SELECT doc_id AS item, 'length' AS dial, CAST(n_chars AS DOUBLE) AS value FROM documents UNION ALL SELECT doc_id, 'parity', doc_id % 2 FROM documents
UNION ALL SELECT doc_id, 'fluency', -CAST(len(regexp_extract_all(coalesce(text, ''), '[A-Z]{2,}')) AS DOUBLE) FROM documents""")
def dial_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known dials of items in long form; mistakes enter with their sign turned, so higher is better for every dial."""
    d = table(spark, sf_dir, "documents")
    wide = d.select(F.col("doc_id").alias("item"), F.col("n_chars").cast("double").alias("length"), (F.col("doc_id") % 2).cast("double").alias("parity"), (-F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[A-Z]{2,}")).cast("double")).alias("fluency"))
    return wide.unpivot(["item"], ["length", "parity", "fluency"], "dial", "value")


@query("q_total_scores", """
WITH s AS (SELECT d.doc_id, lang, CAST(n_chars AS DOUBLE) / 100 + doc_id % 10 AS total, CAST(quality AS DOUBLE) AS human FROM documents d JOIN labels USING (doc_id)),
k AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY total) + (count(*) OVER (PARTITION BY lang, total) - 1) / 2.0 AS a, rank() OVER (PARTITION BY lang ORDER BY human) + (count(*) OVER (PARTITION BY lang, human) - 1) / 2.0 AS b FROM s)
SELECT lang, count(*) AS n, round(CASE WHEN stddev_pop(a) * stddev_pop(b) <> 0 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) ELSE 0 END, 6) + 0.0::DOUBLE AS spearman, round(stddev_samp(total), 5) AS sd, round(quantile_cont(total, 0.25), 5) AS q25, round(quantile_cont(total, 0.5), 5) AS q50, round(quantile_cont(total, 0.75), 5) AS q75 FROM k GROUP BY 1""")
def total_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's total beside the human score: rank correlation, sample deviation and quartiles, by language."""
    from ..functions.numeric import guarded_corr
    from ..operators.order import average_rank

    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    s = d.select("lang", (F.col("n_chars").cast("double") / 100 + F.col("doc_id") % 10).alias("total"), F.col("quality").cast("double").alias("human"))
    k = s.withColumns({"a": average_rank("total", ["lang"]).cast("double"), "b": average_rank("human", ["lang"]).cast("double")})
    q = [F.round(F.percentile("total", F.lit(p)), 5).alias(n) for n, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))]
    return k.groupBy("lang").agg(F.count("*").alias("n"), (F.round(guarded_corr(F.col("a"), F.col("b")), 6) + 0.0).alias("spearman"), F.round(F.stddev_samp("total"), 5).alias("sd"), *q)


@query("q_cross_judge_consensus", """
WITH s AS (SELECT event_type || ':' || (user_id % 6) AS construct, 'j' || (event_id % 4) AS judge, stddev_pop(value) AS sigma FROM events WHERE (user_id % 6) + event_id % 4 < 7 GROUP BY 1, 2),
a AS (SELECT construct, count(*) AS size, min(sigma) AS lo, max(sigma) AS hi, arg_min(judge, (sigma, judge)) AS lowest, arg_max(judge, (sigma, judge)) AS highest FROM s GROUP BY 1)
SELECT construct, size, round(lo, 6) AS lo, round(hi, 6) AS hi, lowest, highest FROM a WHERE size >= 3""")
def cross_judge_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constructs that at least three judges share: the range of their spreads and who has the least and the most."""
    e = table(spark, sf_dir, "events").filter("(user_id % 6) + event_id % 4 < 7")
    s = e.groupBy(F.concat_ws(":", "event_type", (F.col("user_id") % 6).cast("string")).alias("construct"), F.concat(F.lit("j"), F.col("event_id") % 4).alias("judge")).agg(F.stddev_pop("value").alias("sigma"))
    at = F.struct("sigma", "judge")
    a = s.groupBy("construct").agg(F.count("*").alias("size"), F.round(F.min("sigma"), 6).alias("lo"), F.round(F.max("sigma"), 6).alias("hi"), F.min_by("judge", at).alias("lowest"), F.max_by("judge", at).alias("highest"))
    return a.filter("size >= 3")


CELLS3 = """
WITH raw AS (SELECT event_id % 3 AS cell, user_id AS item, event_type || ':' || (event_id % 5) AS criterion, avg(value) AS v FROM events WHERE NOT (event_id % 3 = 0 AND event_id % 5 > 2) AND NOT (event_id % 3 = 1 AND event_id % 5 = 4) GROUP BY 1, 2, 3)"""


def cells3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three cells with criteria in common: the first lacks some, the second others."""
    e = table(spark, sf_dir, "events").filter("not (event_id % 3 = 0 and event_id % 5 > 2) and not (event_id % 3 = 1 and event_id % 5 = 4)")
    return e.groupBy((F.col("event_id") % 3).alias("cell"), F.col("user_id").alias("item"), F.concat_ws(":", "event_type", (F.col("event_id") % 5).cast("string")).alias("criterion")).agg(F.avg("value").alias("v"))


@query("q_pooled_panel", CELLS3 + """,
src AS (SELECT criterion, min(cell) AS cell FROM raw GROUP BY 1)
SELECT item, criterion, round(v, 6) AS v, cell FROM raw JOIN src USING (criterion, cell) WHERE item IN (SELECT item FROM raw WHERE cell = 0)""")
def pooled_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel from three cells: later ones add the criteria that earlier ones lack, for the first one's items."""
    return rounded(panels.pooled_panel(cells3(spark, sf_dir)), ["item", "criterion", "cell"], ["v"])


@query("q_pooled_panel_dropped", CELLS3 + """,
src AS (SELECT criterion, 0 AS cell FROM (SELECT DISTINCT criterion FROM raw WHERE cell = 0 AND criterion <> 'click:1') UNION ALL SELECT 'click:1', 1 UNION ALL
  SELECT criterion, 2 FROM (SELECT DISTINCT criterion FROM raw WHERE cell = 2 AND criterion NOT IN (SELECT criterion FROM raw WHERE cell < 2)))
SELECT item, criterion, round(v, 6) AS v, CAST(cell AS BIGINT) AS cell FROM raw JOIN src USING (criterion, cell) WHERE item IN (SELECT item FROM raw WHERE cell = 0)""")
def pooled_panel_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a criterion that the second cell is named for: it comes from there, and nothing else does."""
    dropped = spark.createDataFrame([(1, "click:1")], "cell long, criterion string")
    return rounded(panels.pooled_panel(cells3(spark, sf_dir), dropped), ["item", "criterion", "cell"], ["v"])


@query("q_panel_outer_join", CELLS3 + """,
a AS (SELECT item, avg(v) AS a FROM raw WHERE cell = 1 AND item % 3 > 0 GROUP BY 1), b AS (SELECT item, avg(v) AS b FROM raw WHERE cell = 2 AND item % 5 > 0 GROUP BY 1)
SELECT coalesce(a.item, b.item) AS item, round(a, 9) AS a, round(b, 9) AS b FROM a FULL JOIN b ON a.item = b.item""")
def panel_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cells side by side with every item of either."""
    c = cells3(spark, sf_dir)
    side = lambda k, m, n: c.filter((F.col("cell") == k) & (F.col("item") % m > 0)).groupBy("item").agg(F.round(F.avg("v"), 9).alias(n))
    return side(1, 3, "a").join(side(2, 5, "b"), "item", "full_outer")


@query("q_panel_left_join", CELLS3 + """,
a AS (SELECT item, avg(v) AS a FROM raw WHERE cell = 1 AND item % 3 > 0 GROUP BY 1), b AS (SELECT item, avg(v) AS b FROM raw WHERE cell = 2 AND item % 5 > 0 GROUP BY 1)
SELECT a.item, round(a, 9) AS a, round(b, 9) AS b FROM a LEFT JOIN b ON a.item = b.item""")
def panel_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a second cell beside the items of the first; unrated ones stay null."""
    c = cells3(spark, sf_dir)
    side = lambda k, m, n: c.filter((F.col("cell") == k) & (F.col("item") % m > 0)).groupBy("item").agg(F.round(F.avg("v"), 9).alias(n))
    return side(1, 3, "a").join(side(2, 5, "b"), "item", "left")


TESTS_SQL = MATCHED_SQL + """,
c AS (SELECT feature, count(*) AS n, count(*) FILTER (d > 0) AS n_win, count(*) FILTER (d < 0) AS n_loss FROM diffs GROUP BY 1),
t AS (SELECT *, (n_win + 0.5 * (n - n_win - n_loss)) / n AS win_rate, CASE WHEN n_win = n_loss THEN 1.0 ELSE
  least(1.0, 2 * list_sum(list_transform(range(0, least(n_win, n_loss) + 1), lambda i: exp(lgamma(n_win + n_loss + 1) - lgamma(i + 1) - lgamma(n_win + n_loss - i + 1) - (n_win + n_loss) * ln(2))))) END AS p FROM c),
rk AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM t),
w AS (SELECT *, least(1.0, min(p * m / k) OVER (ORDER BY k DESC)) AS q FROM rk),
ks AS (SELECT max(CASE WHEN p <= 0.05 * k / m THEN k END) AS k_star, max(m) AS m, max(n) AS n FROM rk),
band AS (SELECT k_star, m, n, """ + panels.normal_upper("(0.05::DOUBLE * coalesce(k_star, 1) / (2.0::DOUBLE * m))") + " * sqrt(0.25 / n) AS margin FROM ks)"


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.win_rates(long(matched(spark, sf_dir), ["pair_id"], "feature", "d"))


@query("q_chance_band", sql(TESTS_SQL + " SELECT CAST(k_star AS BIGINT) AS k_star, m, n, round(margin, 8) AS margin FROM band"))
def chance_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band around one half that the panel's Benjamini-Hochberg level implies."""
    b = panels.chance_band(tests(spark, sf_dir))
    return b.select(F.col("k_star").cast("long").alias("k_star"), "m", "n", F.round("margin", 8).alias("margin"))


@query("q_band_contradictions", sql(TESTS_SQL + " SELECT feature, round(win_rate, 6) AS win_rate, round(q, 6) AS q FROM w, band WHERE (abs(win_rate - 0.5) > margin) <> (q < 0.05)"))
def band_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tests(spark, sf_dir)
    with_margin = t.join(F.broadcast(panels.chance_band(t).select("margin")), how="left", on=F.lit(True))
    return panels.against_band(with_margin, F.col("margin")).select("feature", F.round("win_rate", 6).alias("win_rate"), F.round("q", 6).alias("q"))


@query("q_length_reference", sql(MATCHED_SQL + " SELECT count(*) AS n, round(avg(CASE WHEN length > 0 THEN 1.0 WHEN length = 0 THEN 0.5 ELSE 0.0 END), 6) AS rate FROM mp"))
def length_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matched(spark, sf_dir).withColumn("zero", F.lit(0))
    return panels.length_reference(m, "length", "zero").select("n", F.round("rate", 6).alias("rate"))


@query("q_plain_win_rates", sql(MATCHED_SQL + """,
c AS (SELECT feature, count(*) AS n, count(*) FILTER (d > 0) AS k FROM diffs GROUP BY 1)
SELECT feature, n, round(k / n, 6) AS win_rate, round(CASE WHEN 2 * k = n THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(k, n - k) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))) END, 6) AS p FROM c"""))
def plain_win_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Win rates whose ties are not split."""
    return rounded(panels.plain_win_rates(long(matched(spark, sf_dir), ["pair_id"], "feature", "d")), ["feature", "n"], ["win_rate", "p"])


@query("q_win_rate_cells", sql(MATCHED_SQL + """,
cells AS (SELECT feature, CASE WHEN feature IN ('length', 'lines') THEN 'first' ELSE 'second' END AS cell, d FROM diffs)
SELECT cell, feature, count(*) AS n, round((count(*) FILTER (d > 0) + 0.5 * count(*) FILTER (d = 0)) / count(*), 6) AS win_rate FROM cells GROUP BY 1, 2"""))
def win_rate_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table from two cells of the same graph, naming the cell that rated each criterion."""
    d = long(matched(spark, sf_dir), ["pair_id"], "feature", "d")
    d = d.withColumns({"cell": F.when(F.col("feature").isin("length", "lines"), "first").otherwise("second"), "graph": F.lit("matched")})
    cell = panels.same_graph(d).select("feature", "cell").distinct()
    return stats.win_rates(d).join(F.broadcast(cell), "feature").select("cell", "feature", "n", F.round("win_rate", 6).alias("win_rate"))


PROBE_SQL = f"""
WITH a AS (SELECT doc_id AS unit, fr AS framing, CAST({MD5.format("doc_id || ':' || fr")} % 100 < CASE fr WHEN 'p1' THEN 55 ELSE 60 END AS INT) AS ok, doc_id % 2 AS label, CASE WHEN doc_id % 3 = 0 THEN 'heldout' ELSE 'train' END AS split FROM documents, (SELECT unnest(['p1', 'p2']) AS fr)),
w AS (SELECT unit, label, split, max(CASE framing WHEN 'p1' THEN ok END) AS p1, max(CASE framing WHEN 'p2' THEN ok END) AS p2 FROM a GROUP BY ALL)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit"), (F.col("doc_id") % 2).alias("label"), F.when(F.col("doc_id") % 3 == 0, "heldout").otherwise("train").alias("split"), F.explode(F.array(F.lit("p1"), F.lit("p2"))).alias("framing"))
    h = md5_number(F.concat_ws(":", F.col("unit").cast("string"), "framing")) % 100
    return d.withColumn("ok", (h < F.when(F.col("framing") == "p1", 55).otherwise(60)).cast("int"))


@query("q_contamination_probe", PROBE_SQL + " SELECT label, split, count(*) AS n, round(avg(p1), 6) AS p1, round(avg(p2), 6) AS p2, round(100 * avg(p2 - p1), 5) + 0.0::DOUBLE AS lift_pp FROM w GROUP BY ROLLUP (label, split)")
def contamination_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy per framing and their lift, by outcome and split, with totals."""
    p = panels.probe(answers(spark, sf_dir))
    return p.select("label", "split", "n", F.round("p1", 6).alias("p1"), F.round("p2", 6).alias("p2"), (F.round("lift_pp", 5) + 0.0).alias("lift_pp"))


SIGN_P = "CASE WHEN b = c THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END"


@query("q_framing_discordance", PROBE_SQL + f", q AS (SELECT count(*) FILTER (p2 = 1 AND p1 = 0) AS b, count(*) FILTER (p2 = 0 AND p1 = 1) AS c FROM w) SELECT b, c, round({SIGN_P}, 6) AS p FROM q")
def framing_discordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.discordant(answers(spark, sf_dir)).select("b", "c", F.round("p", 6).alias("p"))


@query("q_subset_comparison", f"""
WITH v AS (SELECT doc_id AS unit, CAST({MD5.format("doc_id || ':ours'")} % 100 < 70 AS INT) AS ours, CAST({MD5.format("doc_id || ':1'")} % 100 < 60 AS INT) AS o1, CAST({MD5.format("doc_id || ':2'")} % 100 < 60 AS INT) AS o2 FROM documents),
s AS (SELECT *, o1 = o2 AS same, CASE WHEN o1 = o2 THEN o1 ELSE 0.5 END AS score FROM v),
x AS (SELECT 'all' AS subset, * FROM s UNION ALL SELECT CASE WHEN same THEN 'self consistent' ELSE 'by position' END, * FROM s),
g AS (SELECT subset, count(*) AS n, avg(score) AS zero_shot, avg(ours) AS ours, count(*) FILTER (ours = 1 AND score < 1) AS b0, CAST(sum(ours) AS BIGINT) AS b, CAST(count(*) - sum(ours) AS BIGINT) AS c FROM x GROUP BY 1)
SELECT subset, n, round(zero_shot, 6) AS zero_shot, round(ours, 6) AS ours, round(ours - zero_shot, 6) + 0.0::DOUBLE AS gap, round({SIGN_P}, 6) AS p FROM g""")
def subset_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A method beside a zero-shot judge: on all pairs, on those it answers alike in both orders, and on the others."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    h = lambda tag: md5_number(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(tag))) % 100
    s = d.select((h("ours") < 70).cast("int").alias("ours"), (h("1") < 60).cast("int").alias("o1"), (h("2") < 60).cast("int").alias("o2"))
    same = F.col("o1") == F.col("o2")
    s = s.withColumn("score", F.when(same, F.col("o1").cast("double")).otherwise(0.5))
    x = s.withColumn("subset", F.explode(F.array(F.lit("all"), F.when(same, "self consistent").otherwise("by position"))))
    g = x.groupBy("subset").agg(F.count("*").alias("n"), F.avg("score").alias("zero_shot"), F.avg("ours").alias("ours"), F.sum("ours").alias("b"))
    g = g.withColumns({"gap": F.col("ours") - F.col("zero_shot"), "p": stats.sign_test(F.col("b"), F.col("n") - F.col("b"))})
    return rounded(g, ["subset", "n"], ["zero_shot", "ours", "gap", "p"])
