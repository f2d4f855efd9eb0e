"""Queries over choice models: at fixed parameters (compared with SQL) and fitted (checked by identities in tests)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import bin_index, log_sigmoid
from ..operators import calibration, choice, gated, kernels, panel_fit, rationale
from ..sources.shared import written
from .fixtures import CRITERIA, items, judgments
from .graph_queries import PLACED_SQL, cited, sql
from .registry import once, query

NAMES = [c for c, _ in CRITERIA]
BETA = 0.1


def score_of(i, k):
    """A fixed score of item number and criterion number."""
    return ((i * 37 + k * 11) % 101 - 50) / 25.0


GRID_SQL = f""",
ks(criterion, k) AS (VALUES {', '.join(f"('{c}', {k})" for k, c in enumerate(NAMES))}),
cells AS (
  SELECT p.pair_index, f.i AS ia, o.i AS ib, ks.criterion, ks.k, coalesce(t.x, 0) AS x,
    ((f.i * 37 + k * 11) % 101 - 50) / 25.0 - ((o.i * 37 + k * 11) % 101 - 50) / 25.0 AS d, 0.3 * k - 0.5 AS g
  FROM pairs p JOIN items f ON f.doc_id = p.first JOIN items o ON o.doc_id = p.other, ks LEFT JOIN tensor t ON t.pair_index = p.pair_index AND t.criterion = ks.criterion),
z AS (SELECT *, abs(CAST(d AS DOUBLE)) + ln(1 + exp(-2 * abs(CAST(d AS DOUBLE)))) + CAST(g AS DOUBLE) AS zc, CAST(d AS DOUBLE) + {BETA}::DOUBLE AS zd, CAST(d AS DOUBLE) AS dd FROM cells),
terms AS (SELECT *, 1 / (1 + exp(-zc)) AS pc, 1 / (1 + exp(-zd)) AS pd, tanh(dd) AS t, CASE WHEN x <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cited, CASE WHEN x = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS pos FROM z)
"""


@once
def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair and criterion with its verdict: ``pair_index, ia, ib, criterion, k, x, d, g``."""
    it, j = items(spark, sf_dir), judgments(spark, sf_dir)
    end = lambda c, n: it.select(F.col("doc_id").alias(c), F.col("i").alias(n))
    ks = F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.lit(k).alias("k")) for k, c in enumerate(NAMES)]))
    p = j.join(end("first", "ia"), "first").join(end("other", "ib"), "other").select("pair_index", "ia", "ib", ks.alias("e")).select("pair_index", "ia", "ib", "e.*")
    x = rationale.verdict_tensor(cited(spark, sf_dir))
    out = p.join(x, ["pair_index", "criterion"], "left").withColumn("x", F.coalesce("x", F.lit(0)))
    return written(out.withColumns({"d": score_of(F.col("ia"), F.col("k")) - score_of(F.col("ib"), F.col("k")), "g": 0.3 * F.col("k") - 0.5}), "cells")


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = choice.gated_terms(F.col("d"), F.col("g"), F.lit(BETA), F.col("x"))
    return cells(spark, sf_dir).withColumns(t)


@query("q_gated_nll_fixed", sql(GRID_SQL + """
SELECT criterion, round(-sum(CASE WHEN x <> 0 THEN least(zc, 0) - ln(1 + exp(-abs(zc))) ELSE least(-zc, 0) - ln(1 + exp(-abs(zc))) END), 4) AS nll_cite,
  round(-sum(CASE WHEN x = 1 THEN least(zd, 0) - ln(1 + exp(-abs(zd))) WHEN x = -1 THEN least(-zd, 0) - ln(1 + exp(-abs(zd))) ELSE 0 END), 4) AS nll_dir FROM terms GROUP BY 1"""))
def gated_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms(spark, sf_dir).groupBy("criterion").agg(F.round(-F.sum("ll_cite"), 4).alias("nll_cite"), F.round(-F.sum("ll_dir"), 4).alias("nll_dir"))


@query("q_gate_probs", sql(GRID_SQL + " SELECT pair_index, criterion, round(pc, 6) AS p_cite, round(pd, 6) AS p_dir, round(pc * (1 - pc) * t * t + cited * pd * (1 - pd), 6) AS h_dd FROM terms"))
def gate_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms(spark, sf_dir).select("pair_index", "criterion", *[F.round(c, 6).alias(c) for c in ("p_cite", "p_dir", "h_dd")])


@query("q_gated_gradient", sql(GRID_SQL + """,
u AS (SELECT ia, ib, criterion, -((cited - pc) * t + pos - cited * pd) AS u FROM terms)
SELECT node, criterion, round(sum(u), 5) + 0.0::DOUBLE AS slope FROM (SELECT ia AS node, criterion, u FROM u UNION ALL SELECT ib, criterion, -u FROM u) GROUP BY 1, 2"""))
def gated_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.explode(F.array(F.struct(F.col("ia").alias("node"), (-F.col("slope")).alias("u")), F.struct(F.col("ib").alias("node"), F.col("slope").alias("u")))).alias("e")
    return terms(spark, sf_dir).select("criterion", u).groupBy("e.node", "criterion").agg((F.round(F.sum("e.u"), 5) + 0.0).alias("slope"))


@query("q_holistic_nll_fixed", sql(PLACED_SQL + GRID_SQL + f""",
h AS (SELECT c.*, CASE w.winner WHEN 'A' THEN 1 ELSE 0 END AS w, EXISTS (SELECT 1 FROM placed q WHERE q.pair_index = c.pair_index AND q.criterion = c.criterion) AS r FROM terms c JOIN winners w USING (pair_index)),
m AS (SELECT *, (2 * w - 1) * dd + CAST(g AS DOUBLE) AS zm FROM h),
s AS (SELECT pair_index, w, sum(dd) + {BETA}::DOUBLE AS zw, -sum(CASE WHEN r THEN least(zm, 0) - ln(1 + exp(-abs(zm))) ELSE least(-zm, 0) - ln(1 + exp(-abs(zm))) END) AS nm FROM m GROUP BY 1, 2)
SELECT w, count(*) AS n, round(sum(nm), 4) AS nll_mention, round(-sum(CASE WHEN w = 1 THEN least(zw, 0) ELSE least(-zw, 0) END - ln(1 + exp(-abs(zw)))), 4) AS nll_winner FROM s GROUP BY 1"""))
def holistic_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = judgments(spark, sf_dir).select("pair_index", F.when(F.col("winner") == "A", 1).otherwise(0).alias("w"))
    said = cited(spark, sf_dir).select("pair_index", "criterion", F.lit(1).alias("r")).distinct()
    c = cells(spark, sf_dir).join(won, "pair_index").join(said, ["pair_index", "criterion"], "left")
    zm = (2 * F.col("w") - 1) * F.col("d") + F.col("g")
    nm = -F.when(F.col("r") == 1, log_sigmoid(zm)).otherwise(log_sigmoid(-zm))
    s = c.groupBy("pair_index", "w").agg((F.sum("d") + BETA).alias("zw"), F.sum(nm).alias("nm"))
    nw = -F.when(F.col("w") == 1, log_sigmoid(F.col("zw"))).otherwise(log_sigmoid(-F.col("zw")))
    return s.groupBy("w").agg(F.count("*").alias("n"), F.round(F.sum("nm"), 4).alias("nll_mention"), F.round(F.sum(nw), 4).alias("nll_winner"))


@query("q_ece_brier", sql(GRID_SQL + """,
two AS (SELECT criterion, 'cite' AS gate, pc AS p, cited AS y FROM terms UNION ALL SELECT criterion, 'direction', pd, pos FROM terms WHERE x <> 0),
ref AS (SELECT *, avg(y) OVER (PARTITION BY criterion, gate) AS pr FROM two),
b AS (SELECT criterion, gate, (SELECT count(*) FROM (SELECT unnest(range(1, 10)) AS e) WHERE p >= e * CAST(0.1 AS DOUBLE)) AS bin, count(*) AS n, abs(sum(p) - sum(y)) AS gap, sum((p - y) * (p - y)) AS se, sum((pr - y) * (pr - y)) AS sr FROM ref GROUP BY 1, 2, 3)
SELECT criterion, gate, CAST(sum(n) AS BIGINT) AS n, round(sum(gap) / sum(n), 6) AS ece, round(sum(se) / sum(n), 6) AS brier, round(1 - sum(se) / sum(n) / 0.25, 6) AS skill_chance, round(1 - sum(se) / nullif(sum(sr), 0), 5) AS skill_reference FROM b GROUP BY 1, 2"""))
def ece_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = terms(spark, sf_dir)
    y = lambda c: F.when(c, 1.0).otherwise(0.0)
    gates = F.array(F.struct(F.lit("cite").alias("gate"), F.col("p_cite").alias("p"), y(F.col("x") != 0).alias("y")), F.when(F.col("x") != 0, F.struct(F.lit("direction").alias("gate"), F.col("p_dir").alias("p"), y(F.col("x") == 1).alias("y"))))
    c = t.select("criterion", F.explode(F.filter(gates, lambda g: g.isNotNull())).alias("e")).select("criterion", "e.*")
    rate = c.groupBy("criterion", "gate").agg(F.avg("y").alias("pr"))
    out = choice.calibration(c.join(F.broadcast(rate), ["criterion", "gate"]), "p", "y", "pr", ["criterion", "gate"], bin_index(F.col("p")))
    return out.select("criterion", "gate", "n", *[F.round(c, 6).alias(c) for c in ("ece", "brier", "skill_chance")], F.round("skill_reference", 5).alias("skill_reference"))


@query("q_frozen_score_newton", sql(GRID_SQL + f""",
q AS (SELECT ia AS item, criterion, list({{'sign': 1.0::DOUBLE, 'c': {BETA}::DOUBLE - CAST(((ib * 37 + k * 11) % 101 - 50) / 25.0 AS DOUBLE), 'w': pos}} ORDER BY pair_index) AS comps FROM terms WHERE x <> 0 GROUP BY 1, 2),
r AS (SELECT item, criterion, comps, list_reduce(range(12), lambda x, i: CAST(x AS DOUBLE) - (0.001::DOUBLE * x + list_sum(list_transform(comps, lambda q: q.sign * (1 / (1 + exp(-(q.sign * x + q.c))) - q.w)))) / (0.001::DOUBLE + list_sum(list_transform(comps, lambda q: (1 / (1 + exp(-(q.sign * x + q.c)))) * (1 - 1 / (1 + exp(-(q.sign * x + q.c))))))), 0.0::DOUBLE) AS s FROM q)
SELECT item, criterion, round(s, 4) + 0.0::DOUBLE AS score FROM r"""))
def frozen_newton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of first-shown items against the others' frozen scores, in twelve Newton steps."""
    return frozen_scores(spark, sf_dir).select("item", "criterion", (F.round("s", 4) + 0.0).alias("score"))


def frozen_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons of first-shown items by criterion, in the order of their pairs: ``item, criterion, l``."""
    c = cells(spark, sf_dir).filter("x <> 0")
    q = F.struct(F.lit(1.0).alias("sign"), (BETA - score_of(F.col("ib"), F.col("k"))).alias("c"), F.when(F.col("x") == 1, 1.0).otherwise(0.0).alias("w"))
    comps = c.groupBy(F.col("ia").alias("item"), "criterion").agg(F.array_sort(F.collect_list(F.struct("pair_index", q.alias("q")))).alias("l"))
    return comps.select("item", "criterion", F.transform("l", lambda x: x["q"]).alias("l"))


def frozen_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frozen_comparisons(spark, sf_dir).select("item", "criterion", choice.frozen_score(F.col("l")).alias("s"))


def runs(spark: SparkSession, sf_dir: str, rounds: int = 6) -> DataFrame:
    """Comparison cells within each source, every source a run of its own: ``run, t, a, b, w, k, x, r``.

    A verdict favours the item with more, softened by a hash; criteria are cited where counts differ enough.
    """
    it = items(spark, sf_dir).withColumn("at", F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1)
    n = it.groupBy("source").agg((F.floor(F.count("*") / 2) * 2).cast("long").alias("n")).filter(f"n > {rounds}")
    g = n.select("source", "n", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("r")).select("*", F.explode(F.sequence(F.lit(0), (F.col("n") / 2 - 1).cast("int"))).alias("h"))
    m = F.col("n") - 1
    g = g.select("source", (F.col("r") * 1000000 + F.col("h")).alias("t"), ((F.col("r") + F.col("h")) % m).alias("a"), F.when(F.col("h") == 0, m).otherwise((F.col("r") - F.col("h") + m) % m).alias("b"))
    side = lambda s: it.select("source", F.col("at").alias(s), F.array(*NAMES).alias(f"v{s}"))
    p = g.join(side("a"), ["source", "a"]).join(side("b"), ["source", "b"])
    noise = F.pmod(F.hash("source", "t"), F.lit(100)) < 85
    k = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(least).alias("least")) for i, (_, least) in enumerate(CRITERIA)])).alias("e")
    p = p.withColumn("w", F.when((F.get("va", F.lit(0)) > F.get("vb", F.lit(0))) == noise, 1).otherwise(0)).select("source", "t", "a", "b", "w", "va", "vb", k)
    gap = F.get("va", F.col("e.k")) - F.get("vb", F.col("e.k"))
    x = F.when(F.abs(gap) > F.col("e.least"), F.when((gap > 0) == (F.pmod(F.hash("t", "e.k"), F.lit(100)) < 90), 1).otherwise(-1)).otherwise(0)
    return p.select(F.col("source").alias("run"), "t", "a", "b", "w", "e.k", x.alias("x"), F.abs(x).alias("r"))


def gated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(runs(spark, sf_dir).select("run", "t", "a", "b", "k", "x"), "gated-runs")


@query("q_fit_gated")
def fit_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gated fit per source with standard errors; kappa above 100 or rho of 0.5 or less fails the screen."""
    out = gated.inference(gated.fit(gated_runs(spark, sf_dir), ["run"]), ["run"])
    return out.select("*", *gated.wald("gamma", "se_gamma"), *gated.wald("beta", "se_beta")).withColumn("reliable", (F.col("kappa") <= 100) & (F.col("rho") > 0.5))


@query("q_position_by_criterion")
def position_by_criterion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits with a position term a criterion beside those with one for all: terms, errors, reliability and a likelihood-ratio test a source."""
    cells = gated_runs(spark, sf_dir)
    shared = gated.fit(cells, ["run"])
    own = gated.fit(cells, ["run"], own=True, start=shared)
    test = gated.position_test(shared, own, ["run"])
    one = gated.inference(shared, ["run"]).select("run", "k", F.col("beta").alias("beta_shared"), F.col("kappa").alias("kappa_shared"), F.col("rho").alias("rho_shared"), F.col("spread").alias("spread_shared"))
    each = gated.inference(own, ["run"]).select("run", "k", "beta", "se_beta", "se_beta_direction", "kappa", "rho", "spread", *gated.wald("beta", "se_beta"))
    moved = scores_moved(gated.scores(shared, ["run"]), gated.scores(own, ["run"]))
    return each.join(one, ["run", "k"]).join(moved, ["run", "k"]).join(test, "run")


def scores_moved(a: DataFrame, b: DataFrame) -> DataFrame:
    """By run and criterion, how the scores of two fits agree: ``r`` and the largest shift."""
    both = a.select("run", "k", "item", F.col("s").alias("s0")).join(b.select("run", "k", "item", F.col("s").alias("s1")), ["run", "k", "item"])
    sd = F.stddev_pop("s0") * F.stddev_pop("s1")
    return both.groupBy("run", "k").agg((F.covar_pop("s0", "s1") / F.when(sd != 0, sd)).alias("r"), F.max(F.abs(F.col("s0") - F.col("s1"))).alias("shift"))


@query("q_fit_holistic")
def fit_holistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One holistic fit per source; the screen is strict in kappa here."""
    out = choice.fit_holistic(runs(spark, sf_dir).select("run", "t", "a", "b", "w", "k", "r"))
    return out.select("*", *gated.wald("gamma", "se_gamma"), *gated.wald("beta", "se_beta")).withColumn("reliable", (F.col("kappa") < 100) & (F.col("rho") > 0.5))


FOLDS = 5


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``runs`` with a fold of each pair, all criteria of a pair together."""
    return written(runs(spark, sf_dir).withColumn("fold", F.pmod(F.hash(F.lit("fold"), "run", "t"), F.lit(FOLDS))), "folded")


@query("q_holistic_held_out")
def holistic_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners and mentions of pairs that a fit has not seen, per source: accuracy on a fifth held out, and over all five."""
    told = choice.holistic_forecasts(folded(spark, sf_dir).select("run", "t", "a", "b", "w", "k", "r", "fold"))
    pairs = told.filter("k = 0").withColumn("right", ((F.col("p_win") > 0.5) == (F.col("w") == 1)).cast("double"))
    one = pairs.groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.col("held") == 0).alias("n_test"), F.avg(F.when(F.col("held") == 0, F.col("right"))).alias("accuracy_fifth"), F.avg("right").alias("accuracy"))
    said = told.groupBy("run").agg(F.avg(F.pow(F.col("p_mention") - F.col("r"), F.lit(2.0))).alias("brier_mention"))
    return one.join(said, "run")


@query("q_calibration_fitted")
def calibration_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration of both gates over out-of-fold forecasts of all sources and criteria, references from training folds.

    Intervals over 2,000 replicates of resampled pairs, all cells of a pair together.
    """
    told = written(gated.forecasts(folded(spark, sf_dir).select("run", "t", "a", "b", "k", "x", "fold"), ["run"]), "forecasts")
    cells = gated.gate_cells(told.withColumn("unit", F.concat_ws(":", "run", "t")), ["unit"])
    metrics = calibration.forecast_metrics(cells, ["gate"]).drop("n")
    return calibration.calibration_intervals(cells, ["gate"], "unit", 2000).join(metrics, "gate")


@query("q_bradley_terry")
def bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores per source and criterion from the cited comparisons."""
    c = runs(spark, sf_dir).filter("x <> 0").select("run", "k", "a", "b", F.when(F.col("x") == 1, 1).otherwise(0).alias("w"))
    return choice.fit_bradley_terry(c, ["run", "k"])


@query("q_out_of_fold")
def out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate probabilities of every pair and criterion from gated fits without its fold, with the training folds' rates."""
    return gated.forecasts(folded(spark, sf_dir).select("run", "t", "a", "b", "k", "x", "fold"), ["run"])


def panel_judgments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cited comparisons as ``pair_index, feature, first, other, w``, and items of which every fifth is a test item."""
    c = cells(spark, sf_dir).filter("x <> 0").select("pair_index", F.col("criterion").alias("feature"), F.col("ia").alias("first"), F.col("ib").alias("other"), F.when(F.col("x") == 1, 1.0).otherwise(0.0).alias("w"))
    return c, items(spark, sf_dir).select(F.col("i").alias("item"), F.when(F.col("i") % 5 == 0, "test").otherwise("train").alias("split"))


PANEL_SQL = GRID_SQL + """,
j AS (SELECT pair_index, criterion AS feature, ia, ib, pos AS w, ia % 5 = 0 AS ta, ib % 5 = 0 AS tb FROM terms WHERE x <> 0),
won AS (
  SELECT feature, item, sum(y) AS y, count(*) AS n FROM (
    SELECT feature, ia AS item, w AS y, ta, tb FROM j UNION ALL SELECT feature, ib, 1 - w, ta, tb FROM j) WHERE NOT ta AND NOT tb GROUP BY 1, 2),
anchors AS (SELECT feature, item, ln((y + 0.5::DOUBLE) / (n - y + 0.5::DOUBLE)) AS s FROM won),
tests AS (
  SELECT pair_index, feature, CASE WHEN ta THEN ia ELSE ib END AS item, CASE WHEN ta THEN ib ELSE ia END AS anchor, CASE WHEN ta THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign, w FROM j WHERE ta <> tb),
met AS (SELECT t.*, a.s FROM tests t LEFT JOIN anchors a ON a.feature = t.feature AND a.item = t.anchor),
q AS (
  SELECT feature, item, count(*) AS n, count(s) AS known, list({'sign': sign, 'c': 0.1::DOUBLE - sign * s, 'w': w} ORDER BY pair_index) AS comps FROM met GROUP BY 1, 2),
r AS (SELECT feature, item, n, list_reduce(range(31), lambda x, i: CAST(x AS DOUBLE) - (0.1::DOUBLE * x + list_sum(list_transform(comps, lambda q: q.sign * (1 / (1 + exp(-(q.sign * x + q.c))) - q.w)))) / (0.1::DOUBLE + list_sum(list_transform(comps, lambda q: (1 / (1 + exp(-(q.sign * x + q.c)))) * (1 - 1 / (1 + exp(-(q.sign * x + q.c))))))), 0.0::DOUBLE) AS s FROM q WHERE n = known)"""


@query("q_panel_frozen", sql(PANEL_SQL + """
SELECT q.feature, q.item, q.n, round(r.s, 5) + 0.0::DOUBLE AS score FROM q LEFT JOIN r ON r.feature = q.feature AND r.item = q.item"""))
def panel_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items scored against frozen anchors: anchors' log odds of winning among themselves, joined by anchor and feature."""
    j, it = panel_judgments(spark, sf_dir)
    split = lambda c: F.when(F.col(c) % 5 == 0, "test").otherwise("train")
    j = j.withColumns({"fs": split("first"), "os": split("other")})
    both = F.explode(F.array(F.struct(F.col("first").alias("item"), F.col("w").alias("y")), F.struct(F.col("other").alias("item"), (1 - F.col("w")).alias("y")))).alias("e")
    won = j.filter("fs = 'train' and os = 'train'").select("feature", both).groupBy("feature", "e.item").agg(F.sum("e.y").alias("y"), F.count("*").alias("n"))
    anchors = won.select("feature", "item", F.log((F.col("y") + 0.5) / (F.col("n") - F.col("y") + 0.5)).alias("score"), F.lit(BETA).alias("beta"))
    front = F.col("fs") == "test"
    tests = j.filter("fs <> os").select("pair_index", "feature", F.when(front, F.col("first")).otherwise(F.col("other")).alias("item"), F.when(front, F.col("other")).otherwise(F.col("first")).alias("anchor"), F.when(front, 1.0).otherwise(-1.0).alias("sign"), "w")
    out = panel_fit.score_tests(tests, anchors, [], ridge=0.1, steps=30)
    return out.select("feature", "item", "n", (F.round("score", 5) + 0.0).alias("score"))


@query("q_panel_fit")
def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel of all documents and criteria: anchors fitted once, tests scored against them, null where nothing was compared."""
    return panel_fit.fit_panel(*panel_judgments(spark, sf_dir), [])


@query("q_panel_halves")
def panel_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the test scores of two disjoint halves of the comparisons, both halves fitted in the same jobs."""
    j, it = panel_judgments(spark, sf_dir)
    j = written(panel_fit.halves(j, it, []), "panel-halves")
    return panel_fit.half_reliability(panel_fit.fit_panel(j, it, ["half"]), [])
