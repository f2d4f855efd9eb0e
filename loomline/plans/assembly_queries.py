"""Queries over samples, panels and reports: draws, screens, listings, resamples, matched numbers of criteria."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import cosine, guarded_corr, md5_number
from ..operators import matched_k, stats
from ..operators.order import average_rank
from ..operators.panels import normal_upper
from .fixtures import ROUNDS, pairs
from .graph_queries import sql
from .registry import query, table
from .stat_queries import DIALS_SQL, MATCHED_SQL, NAMES, features, matched

MD5 = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
WORD = r"[^\x20\x09-\x0D]+"


def h(*parts: Column | str) -> Column:
    """A number from a hash of texts and columns."""
    return md5_number(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


#: Text conditions as expressions over a text; their word counts are taken on the fly.
CONDITIONS = {"whole": lambda t: t, "first line": lambda t: F.substring_index(t, "\n", 1), "head": lambda t: F.substring(t, 1, 200)}
_COND_SQL = {"whole": "text", "first line": "split_part(text, chr(10), 1)", "head": "substr(text, 1, 200)"}


@query("q_eligible_by_condition", sql(MATCHED_SQL + ",\n" + "w AS (" + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS condition, coalesce(len(regexp_extract_all({e}, '{WORD}')), 0) AS n FROM documents" for c, e in _COND_SQL.items()) + """)
SELECT a.condition, count(*) AS n_pairs, count(*) FILTER (a.n BETWEEN 10 AND 400 AND b.n BETWEEN 10 AND 400) AS n_eligible, CAST(sum(a.n + b.n) AS BIGINT) AS words FROM mp JOIN w a ON a.doc_id = pos_id JOIN w b ON b.doc_id = neg_id AND b.condition = a.condition GROUP BY 1"""))
def eligible_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose two sides both have 10 to 400 words, under each text condition."""
    d = table(spark, sf_dir, "documents")
    count = lambda t: F.coalesce(F.regexp_count(t, F.lit(WORD)), F.lit(0)).cast("long")
    w = d.select("doc_id", F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), count(of(F.col("text"))).alias("n")) for c, of in CONDITIONS.items()])).alias("e")).select("doc_id", "e.*")
    side = lambda s: w.select(F.col("doc_id").alias(f"{s}_id"), "condition", F.col("n").alias(f"n_{s}"))
    m = matched(spark, sf_dir).select("pos_id", "neg_id").join(side("pos"), "pos_id").join(side("neg"), ["neg_id", "condition"])
    both = F.col("n_pos").between(10, 400) & F.col("n_neg").between(10, 400)
    return m.groupBy("condition").agg(F.count("*").alias("n_pairs"), F.count_if(both).alias("n_eligible"), F.sum(F.col("n_pos") + F.col("n_neg")).alias("words"))


def draw_split(units: DataFrame, n: int, n_test: int, from_held_out: bool, seed: str) -> DataFrame:
    """``unit, split``: a train set of ``n`` with all forced units, and a test set.

    ``units``: ``unit, train, forced`` (eligible ones). Forced train units are always in, the rest of the ``n`` are drawn
    from the other train units by a seeded hash. The test set is ``n_test`` of the held-out units or, without
    ``from_held_out``, of the units drawn here that were not forced. Too few units to draw from are an error.
    """
    at = h(seed, F.col("unit"))
    forced = units.filter("train and forced").select("unit")
    n_more = n - forced.count()
    pool = units.filter("train and not forced").select("unit", at.alias("at"))
    if pool.limit(max(0, n_more)).count() < n_more:
        raise ValueError(f"fewer than {n_more} units to draw from")
    extra = pool.orderBy("at", "unit").limit(max(0, n_more))
    if from_held_out:
        test = units.filter("not train").select("unit", at.alias("at")).orderBy("at", "unit").limit(n_test).select("unit", F.lit("test").alias("split"))
        train = forced.unionByName(extra.select("unit")).withColumn("split", F.lit("train"))
        return train.unionByName(test)
    test = extra.orderBy(h(seed, F.lit("test"), F.col("unit")), "unit").limit(n_test).select("unit", F.lit("test").alias("split"))
    train = forced.unionByName(extra.select("unit")).join(test.select("unit"), "unit", "left_anti").withColumn("split", F.lit("train"))
    return train.unionByName(test)


_UNITS_SQL = f"""
WITH u AS (SELECT doc_id AS unit, doc_id % 4 <> 0 AS train, doc_id % 40 = 1 AS forced, {MD5.format("'draw:' || doc_id")} AS h1, {MD5.format("'draw:test:' || doc_id")} AS h2 FROM documents WHERE n_chars >= 40),
f AS (SELECT unit FROM u WHERE train AND forced), k AS (SELECT 30 - count(*) AS n_more FROM f),
x AS (SELECT unit, h2 FROM (SELECT unit, h2, row_number() OVER (ORDER BY h1, unit) AS r FROM u WHERE train AND NOT forced), k WHERE r <= n_more)"""


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("n_chars >= 40")
    return d.select(F.col("doc_id").alias("unit"), (F.col("doc_id") % 4 != 0).alias("train"), (F.col("doc_id") % 40 == 1).alias("forced"))


@query("q_draw_held_out", _UNITS_SQL + """
SELECT unit, 'train' AS split FROM f UNION ALL SELECT unit, 'train' FROM x UNION ALL SELECT unit, 'test' FROM (SELECT unit, row_number() OVER (ORDER BY h1, unit) AS r FROM u WHERE NOT train) WHERE r <= 12""")
def draw_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw of at least thirty train units with all forced ones, and twelve held-out ones as test (a sampling operator)."""
    u = _units(spark, sf_dir)
    n = max(30, u.filter("train and forced").count())
    return draw_split(u, n, 12, True, "draw")


@query("q_draw_fraction", _UNITS_SQL + """,
t AS (SELECT unit FROM (SELECT unit, row_number() OVER (ORDER BY h2, unit) AS r FROM x) WHERE r <= 9)
SELECT unit, CASE WHEN unit IN (SELECT unit FROM t) THEN 'test' ELSE 'train' END AS split FROM (SELECT unit FROM f UNION ALL SELECT unit FROM x)""")
def draw_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the test set drawn from the additional units (a sampling operator)."""
    u = _units(spark, sf_dir)
    n = max(30, u.filter("train and forced").count())
    return draw_split(u, n, 9, False, "draw")


@query("q_elicitation_subsets", f"""
WITH r AS (SELECT r, i, CASE WHEN r = 0 THEN i ELSE {MD5.format("'pool:' || r || ':' || i")} END AS h1 FROM (SELECT unnest(range(6)) AS r), (SELECT DISTINCT user_id % 12 AS i FROM events))
SELECT CAST(r AS INTEGER) AS r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY r ORDER BY h1, i) AS k FROM r) WHERE k <= 4""")
def elicitation_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six subsets of four elicitations: the first four, then seeded ones."""
    i = table(spark, sf_dir, "events").select((F.col("user_id") % 12).alias("i")).distinct()
    r = i.select("i", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("r"))
    at = F.when(F.col("r") == 0, F.col("i")).otherwise(h("pool", F.col("r"), F.col("i")))
    return r.withColumn("k", F.row_number().over(W.partitionBy("r").orderBy(at, "i"))).filter("k <= 4").select("r", "i")


SPREAD_SQL = """
WITH s AS (SELECT 'j' || (user_id % 4) AS judge, event_type || ':' || (event_id % 3) AS criterion, stddev_pop(value) AS sd, stddev_pop(value) - 0.02 * (event_id % 3) * avg(value) AS dn, count(*) AS n FROM events GROUP BY 1, 2, event_id % 3)"""


def spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spread and a denoised one by judge and criterion."""
    e = table(spark, sf_dir, "events").withColumn("m", F.col("event_id") % 3)
    s = e.groupBy(F.concat(F.lit("j"), F.col("user_id") % 4).alias("judge"), F.concat_ws(":", "event_type", F.col("m").cast("string")).alias("criterion"), "m")
    s = s.agg(F.stddev_pop("value").alias("sd"), F.avg("value").alias("mean"), F.count("*").alias("n"))
    return s.select("judge", "criterion", "sd", (F.col("sd") - 0.02 * F.col("m") * F.col("mean")).alias("dn"), "n")


@query("q_ranks_within_judge", SPREAD_SQL + """,
r AS (SELECT judge, criterion, sd, dn, CAST(floor(rank() OVER (PARTITION BY judge ORDER BY sd DESC) + (count(*) OVER (PARTITION BY judge, sd) - 1) / 2.0) AS INTEGER) AS rank_sd,
  CAST(floor(rank() OVER (PARTITION BY judge ORDER BY dn DESC) + (count(*) OVER (PARTITION BY judge, dn) - 1) / 2.0) AS INTEGER) AS rank_dn FROM s)
SELECT judge, criterion, rank_sd, rank_dn, rank_sd <> rank_dn AS moved, round(100 * (1 - dn / sd), 5) + 0.0::DOUBLE AS shrink_pct FROM r""")
def ranks_within_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descending ranks before and after denoising, ties at their mean rank cut to a whole number."""
    r = spreads(spark, sf_dir).withColumns({"up": -F.col("sd"), "up_dn": -F.col("dn")})
    r = r.withColumns({"rank_sd": average_rank("up", ["judge"]).cast("int"), "rank_dn": average_rank("up_dn", ["judge"]).cast("int")})
    return r.select("judge", "criterion", "rank_sd", "rank_dn", (F.col("rank_sd") != F.col("rank_dn")).alias("moved"), (F.round(100 * (1 - F.col("dn") / F.col("sd")), 5) + 0.0).alias("shrink_pct"))


@query("q_radar_axes", SPREAD_SQL + """,
a AS (SELECT criterion, count(*) AS size, max(n / t) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY judge) AS t FROM s) WHERE NOT (judge = 'j0' AND criterion LIKE '%:1') GROUP BY 1 HAVING count(*) >= 2)
SELECT criterion, size, round(share, 6) AS share FROM a ORDER BY size DESC, round(share, 6) DESC, criterion LIMIT 6""")
def radar_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six constructs of most judges, then of the largest share in any of them (a top-k report)."""
    s = spreads(spark, sf_dir)
    total = s.groupBy("judge").agg(F.sum("n").alias("t"))
    s = s.join(F.broadcast(total), "judge").filter("not (judge = 'j0' and criterion like '%:1')")
    a = s.groupBy("criterion").agg(F.count("*").alias("size"), F.round(F.max(F.col("n") / F.col("t")), 6).alias("share")).filter("size >= 2")
    return a.orderBy(F.desc("size"), F.desc("share"), "criterion").limit(6)


@query("q_precision_weighted_sd", SPREAD_SQL + """
SELECT judge, round(sum(n * sd) / sum(n), 6) AS mean, round(sqrt(greatest(0, sum(n * sd * sd) / sum(n) - pow(sum(n * sd) / sum(n), 2))), 5) AS sd FROM s GROUP BY 1""")
def precision_weighted_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of estimates weighted by their precision, from two weighted sums."""
    w = F.sum("n")
    m, q = F.sum(F.col("n") * F.col("sd")) / w, F.sum(F.col("n") * F.col("sd") * F.col("sd")) / w
    return spreads(spark, sf_dir).groupBy("judge").agg(F.round(m, 6).alias("mean"), F.round(F.sqrt(F.greatest(F.lit(0.0), q - m * m)), 5).alias("sd"))


@query("q_screen_failures", SPREAD_SQL + """,
g AS (SELECT judge, sd > 24 AS kappa, dn < 23 AS rho FROM s)
SELECT judge, count(*) AS n, count(*) FILTER (kappa AND NOT rho) AS kappa_only, count(*) FILTER (rho AND NOT kappa) AS rho_only, count(*) FILTER (kappa AND rho) AS both_fail, count(*) FILTER (NOT kappa AND NOT rho) AS kept FROM g GROUP BY 1""")
def screen_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two screens criteria fail, by run."""
    k, r = F.col("sd") > 24, F.col("dn") < 23
    return spreads(spark, sf_dir).groupBy("judge").agg(F.count("*").alias("n"), F.count_if(k & ~r).alias("kappa_only"), F.count_if(r & ~k).alias("rho_only"), F.count_if(k & r).alias("both_fail"), F.count_if(~k & ~r).alias("kept"))


@query("q_step_up_reliability", SPREAD_SQL + """,
r AS (SELECT judge, median(dn / sd) AS m, sum(dn) AS latent, sum(sd) AS seen FROM s GROUP BY 1)
SELECT judge, round(m, 6) AS median_reliability, round(2 * m / (1 + m), 6) AS stepped_up, round(100 * (1 - latent / seen), 5) AS shrink_pct FROM r""")
def step_up_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split-half reliability stepped up to full length, and what correction for noise takes off."""
    r = spreads(spark, sf_dir).groupBy("judge").agg(F.median(F.col("dn") / F.col("sd")).alias("m"), F.sum("dn").alias("latent"), F.sum("sd").alias("seen"))
    return r.select("judge", F.round("m", 6).alias("median_reliability"), F.round(2 * F.col("m") / (1 + F.col("m")), 6).alias("stepped_up"), F.round(100 * (1 - F.col("latent") / F.col("seen")), 5).alias("shrink_pct"))


@query("q_listings", """
WITH g AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) - 1 AS i FROM g),
l AS (SELECT lang, string_agg('[' || i || '] ' || source || ' — ' || lang || ' (cited ' || n || ')', chr(10) ORDER BY i) AS listing FROM i GROUP BY 1)
SELECT lang, replace(replace('About [[WHAT]]:' || chr(10) || '[[LIST]]', '[[WHAT]]', lang), '[[LIST]]', listing) AS prompt FROM l""")
def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines of what is cited, the most cited first, put into a template."""
    g = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    lines = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "source", "n")))
    g = g.groupBy("lang").agg(lines.alias("l"))
    line = lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), x["source"], F.lit(" — "), F.col("lang"), F.lit(" (cited "), x["n"].cast("string"), F.lit(")"))
    listing = F.array_join(F.transform("l", line), "\n")
    return g.select("lang", F.replace(F.replace(F.lit("About [[WHAT]]:\n[[LIST]]"), F.lit("[[WHAT]]"), F.col("lang")), F.lit("[[LIST]]"), listing).alias("prompt"))


BLOCKS_SQL = MATCHED_SQL + f""",
blk AS (SELECT pair_id, CASE WHEN flip = 0 THEN pos_id ELSE neg_id END AS a_id, CASE WHEN flip = 0 THEN neg_id ELSE pos_id END AS b_id, flip = 0 AS a_is_winner, p.length + n.length AS chars, pair_id % 3 = 0 AS sampled
  FROM (SELECT *, {MD5.format("'show:' || pair_id")} % 2 AS flip FROM mp) JOIN items p ON p.doc_id = pos_id JOIN items n ON n.doc_id = neg_id)"""


def pair_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of each pair in a seeded order; who won is kept apart from what is shown."""
    from .fixtures import items

    it = items(spark, sf_dir)
    side = lambda s: it.select(F.col("doc_id").alias(f"{s}_id"), F.col("length").alias(f"l_{s}"))
    m = matched(spark, sf_dir).select("pair_id", "pos_id", "neg_id").join(side("pos"), "pos_id").join(side("neg"), "neg_id")
    keep = h("show", F.col("pair_id")) % 2 == 0
    return m.select("pair_id", F.when(keep, F.col("pos_id")).otherwise(F.col("neg_id")).alias("a_id"), F.when(keep, F.col("neg_id")).otherwise(F.col("pos_id")).alias("b_id"), keep.alias("a_is_winner"), (F.col("l_pos") + F.col("l_neg")).alias("chars"), (F.col("pair_id") % 3 == 0).alias("sampled"))


@query("q_pair_blocks", sql(BLOCKS_SQL + " SELECT pair_id, a_id, b_id, a_is_winner, chars, round(chars / 4.0, 2) AS est_tokens FROM blk"))
def shown_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_blocks(spark, sf_dir).select("pair_id", "a_id", "b_id", "a_is_winner", "chars", F.round(F.col("chars") / 4.0, 2).alias("est_tokens"))


@query("q_sample_report", sql(BLOCKS_SQL + """
SELECT count(*) FILTER (sampled) AS n_pairs, count(*) AS n_pool, round(count(*) FILTER (sampled) / count(*), 6) AS coverage, round(avg(CASE WHEN sampled THEN CAST(a_is_winner AS INT) END), 6) AS winner_is_a, avg(CAST(a_is_winner AS INT)) BETWEEN 0.4 AND 0.6 AS balanced,
  round(quantile_cont(CASE WHEN sampled THEN chars END, 0.1), 4) AS s10, round(quantile_cont(CASE WHEN sampled THEN chars END, 0.5), 4) AS s50, round(quantile_cont(CASE WHEN sampled THEN chars END, 0.9), 4) AS s90, round(quantile_cont(chars, 0.1), 4) AS p10, round(quantile_cont(chars, 0.5), 4) AS p50, round(quantile_cont(chars, 0.9), 4) AS p90 FROM blk"""))
def sample_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a sample covers its pool, the lengths of both, and whether the shown order gives the winner away."""
    won = F.col("a_is_winner").cast("double")
    s = F.when(F.col("sampled"), F.col("chars"))
    q = lambda c, n: [F.round(F.percentile(c, F.lit(p)), 4).alias(f"{n}{int(100 * p)}") for p in (0.1, 0.5, 0.9)]
    return pair_blocks(spark, sf_dir).agg(F.count_if("sampled").alias("n_pairs"), F.count("*").alias("n_pool"), F.round(F.count_if("sampled") / F.count("*"), 6).alias("coverage"), F.round(F.avg(F.when(F.col("sampled"), won)), 6).alias("winner_is_a"), F.avg(won).between(0.4, 0.6).alias("balanced"), *q(s, "s"), *q(F.col("chars"), "p"))


@query("q_blindness_check", sql(BLOCKS_SQL + """,
t AS (SELECT b.pair_id, 'First:' || chr(10) || coalesce(x.text, '') || chr(10) || 'Second:' || chr(10) || coalesce(y.text, '') AS prompt, length(coalesce(x.text, '')) + length(coalesce(y.text, '')) AS n, a_is_winner FROM blk b JOIN documents x ON x.doc_id = a_id JOIN documents y ON y.doc_id = b_id)
SELECT count(*) AS n, count(*) FILTER (length(prompt) = n + 16) AS n_template_only, count(*) FILTER (contains(prompt, 'pair_id')) AS n_with_id, avg(CAST(a_is_winner AS INT)) BETWEEN 0.35 AND 0.65 AS balanced FROM t"""))
def blindness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts hold the template and the two texts and nothing else, and the winner is not shown first too often."""
    d = table(spark, sf_dir, "documents")
    side = lambda s: d.select(F.col("doc_id").alias(f"{s}_id"), F.coalesce("text", F.lit("")).alias(f"t_{s}"))
    t = pair_blocks(spark, sf_dir).join(side("a"), "a_id").join(side("b"), "b_id")
    t = t.withColumn("prompt", F.concat(F.lit("First:\n"), "t_a", F.lit("\nSecond:\n"), "t_b"))
    n = F.length("t_a") + F.length("t_b")
    return t.agg(F.count("*").alias("n"), F.count_if(F.length("prompt") == n + 16).alias("n_template_only"), F.count_if(F.contains("prompt", F.lit("pair_id"))).alias("n_with_id"), F.avg(F.col("a_is_winner").cast("double")).between(0.35, 0.65).alias("balanced"))


@query("q_orthogonality", sql(DIALS_SQL + """,
m AS (SELECT a.f AS a, b.f AS b, coalesce(CASE WHEN stddev_pop(a.x) * stddev_pop(b.x) <> 0 THEN covar_pop(a.x, b.x) / (stddev_pop(a.x) * stddev_pop(b.x)) END, 0) AS r FROM f a JOIN f b USING (item) WHERE a.f < b.f AND NOT (a.f = 'commas' AND b.f = 'length') GROUP BY 1, 2)
SELECT a, b, round(r, 6) AS r, round(max(abs(r)) OVER (), 6) AS max_abs FROM m ORDER BY abs(r) DESC LIMIT 8"""))
def orthogonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight largest correlations between dials, those that hold by construction left out (a top-k report)."""
    f = features(spark, sf_dir)
    m = f.withColumnRenamed("f", "a").join(f.select("item", F.col("f").alias("b"), F.col("x").alias("y")), "item").filter("a < b and not (a = 'commas' and b = 'length')")
    m = m.groupBy("a", "b").agg(guarded_corr(F.col("x"), F.col("y")).alias("r"))
    return m.withColumn("max_abs", F.round(F.max(F.abs("r")).over(W.partitionBy()), 6)).orderBy(F.desc(F.abs("r"))).limit(8).withColumn("r", F.round("r", 6))


@query("q_dataset_gates", """
WITH d AS (SELECT doc_id % 3 AS level, n_chars, text, source FROM documents), b AS (SELECT level, count(*) AS n FROM d GROUP BY 1)
SELECT 'realized' AS gate, bool_and(n_chars = coalesce(length(text), 0)) AS ok FROM d UNION ALL SELECT 'present', bool_and(text IS NOT NULL AND source IS NOT NULL) FROM d
UNION ALL SELECT 'balance', count(*) = 3 AND max(abs(n - (SELECT count(*) FROM d) / 3.0)) <= 1 FROM b
UNION ALL SELECT 'length', abs(coalesce(CASE WHEN stddev_pop(level) * stddev_pop(n_chars) <> 0 THEN covar_pop(level, n_chars) / (stddev_pop(level) * stddev_pop(n_chars)) END, 0)) < 0.25 FROM d""")
def dataset_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks that a generated set must pass: realised as assigned, complete, balanced, length unrelated to the level."""
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 3).alias("level"), "n_chars", "text", "source")
    total = d.agg(F.count("*").alias("t"))
    b = d.groupBy("level").agg(F.count("*").alias("n")).join(F.broadcast(total), how="left", on=F.lit(True))
    one = lambda name, df, c: df.agg(c.alias("ok")).select(F.lit(name).alias("gate"), "ok")
    gates = [one("realized", d, F.bool_and(F.col("n_chars") == F.coalesce(F.length("text"), F.lit(0)))), one("present", d, F.bool_and(F.col("text").isNotNull() & F.col("source").isNotNull())),
             one("balance", b, (F.count("*") == 3) & (F.max(F.abs(F.col("n") - F.col("t") / 3.0)) <= 1)), one("length", d, F.abs(guarded_corr(F.col("level").cast("double"), F.col("n_chars").cast("double"))) < 0.25)]
    out = gates[0]
    for g in gates[1:]:
        out = out.unionByName(g)
    return out


@query("q_rep_slice_and_mean", """
WITH e AS (SELECT user_id AS item, event_type AS criterion, event_id % 3 AS rep, avg(value) AS v FROM events GROUP BY 1, 2, 3)
SELECT item, criterion, round(arg_min(v, rep), 6) AS first_rep, round(avg(v), 6) AS rep_mean, count(*) AS n_reps FROM e GROUP BY 1, 2""")
def rep_slice_and_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel's scores from its first replicate beside their mean over replicates."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("item"), F.col("event_type").alias("criterion"), (F.col("event_id") % 3).alias("rep")).agg(F.avg("value").alias("v"))
    return e.groupBy("item", "criterion").agg(F.round(F.min_by("v", "rep"), 6).alias("first_rep"), F.round(F.avg("v"), 6).alias("rep_mean"), F.count("*").alias("n_reps"))


@query("q_merged_results", """
WITH a AS (SELECT event_type AS method, avg(value) AS score FROM events GROUP BY 1), b AS (SELECT lang AS method, avg(n_chars) AS score FROM documents GROUP BY 1)
SELECT coalesce(m.label, x.method) AS method, x.origin, round(score, 5) AS score FROM (SELECT method, score, 'events' AS origin FROM a UNION ALL SELECT method, score, 'documents' FROM b) x LEFT JOIN (VALUES ('click', 'Ours'), ('en', 'English')) m(method, label) USING (method)""")
def merged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two result tables as one, methods under the names that a report uses."""
    a = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("method")).agg(F.avg("value").alias("score")).withColumn("origin", F.lit("events"))
    b = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("method")).agg(F.avg("n_chars").alias("score")).withColumn("origin", F.lit("documents"))
    names = F.create_map(*[F.lit(x) for x in ("click", "Ours", "en", "English")])
    return a.unionByName(b).select(F.coalesce(names[F.col("method")], "method").alias("method"), "origin", F.round("score", 5).alias("score"))


@query("q_canonical_panel", """
WITH c AS (SELECT DISTINCT source AS name FROM documents WHERE source <> 'src0'), k AS (SELECT DISTINCT source AS name FROM documents WHERE lang = 'en')
SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS place, name IN (SELECT name FROM k) AS kept FROM c""")
def canonical_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria by name without the catch-all, and which of them the screen kept."""
    d = table(spark, sf_dir, "documents")
    c = d.filter("source <> 'src0'").select(F.col("source").alias("name")).distinct()
    k = d.filter("lang = 'en'").select(F.col("source").alias("name"), F.lit(True).alias("kept")).distinct()
    return c.join(k, "name", "left").select("name", (F.row_number().over(W.orderBy("name")) - 1).alias("place"), F.coalesce("kept", F.lit(False)).alias("kept"))


@query("q_survivors_checked", """
WITH a AS (SELECT DISTINCT source FROM documents WHERE lang = 'en'), b AS (SELECT DISTINCT source FROM documents WHERE n_chars > 500), c AS (SELECT DISTINCT source FROM documents)
SELECT source, source IN (SELECT source FROM b) AS in_second, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM c)) = 0 AS all_known FROM a""")
def survivors_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that passed one gate, looked up in another, with a check that all of them are on the panel."""
    d = table(spark, sf_dir, "documents")
    names = lambda c: d.filter(c).select("source").distinct()
    a, b = names("lang = 'en'"), names("n_chars > 500").withColumn("hit", F.lit(True))
    unknown = a.join(names("true"), "source", "left_anti").agg((F.count("*") == 0).alias("all_known"))
    return a.join(b, "source", "left").join(F.broadcast(unknown), how="left", on=F.lit(True)).select("source", F.coalesce("hit", F.lit(False)).alias("in_second"), "all_known")


@query("q_fusion_differences", f"""
WITH v AS (SELECT f, d, m, {MD5.format("'ours:' || f || ':' || d || ':' || m")} % 1000 / 1000.0::DOUBLE - {MD5.format("'other:' || d || ':' || m")} % 1000 / 1000.0::DOUBLE AS diff FROM (SELECT DISTINCT user_id % 8 AS f FROM events), (SELECT unnest(range(40)) AS d), (SELECT unnest(['SF', 'LK']) AS m))
SELECT f, m, round(avg(diff), 6) AS mean, round(min(diff), 6) AS lo, round(max(diff), 6) AS hi, round(avg(CASE WHEN CASE m WHEN 'LK' THEN -diff ELSE diff END > 0 THEN 1.0 ELSE 0.0 END), 6) AS favours FROM v GROUP BY 1, 2""")
def fusion_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired differences over fusions and draws; for leakage, where less is better, the sign is turned."""
    f = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("f")).distinct()
    v = f.select("f", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("d")).select("f", "d", F.explode(F.array(F.lit("SF"), F.lit("LK"))).alias("m"))
    diff = h("ours", F.col("f"), F.col("d"), F.col("m")) % 1000 / 1000.0 - h("other", F.col("d"), F.col("m")) % 1000 / 1000.0
    v = v.withColumn("diff", diff)
    good = F.when(F.col("m") == "LK", -F.col("diff")).otherwise(F.col("diff")) > 0
    return v.groupBy("f", "m").agg(F.round(F.avg("diff"), 6).alias("mean"), F.round(F.min("diff"), 6).alias("lo"), F.round(F.max("diff"), 6).alias("hi"), F.round(F.avg(good.cast("double")), 6).alias("favours"))


@query("q_ledger_statistics", """
SELECT lang, count(*) AS n, round(avg(n_chars), 5) AS mean, round(stddev_samp(n_chars), 5) AS sd, count(*) FILTER (n_chars BETWEEN 100 AND 5000) AS n_eligible, count(DISTINCT source) AS n_sources FROM documents GROUP BY 1""")
def ledger_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 5).alias("mean"), F.round(F.stddev_samp("n_chars"), 5).alias("sd"), F.count_if(F.col("n_chars").between(100, 5000)).alias("n_eligible"), F.countDistinct("source").alias("n_sources"))


@query("q_nested_graph_report", sql(f""",
d AS (SELECT unnest(range(1, {ROUNDS + 1})) AS d),
e AS (SELECT d, p.*, x.source = y.source AS same, x.doc_id % 2 <> y.doc_id % 2 AS crossed FROM d, pairs p JOIN items x ON x.i = p.a JOIN items y ON y.i = p.b WHERE p.round < d),
g AS (SELECT d, node, count(*) AS k FROM (SELECT d, a AS node FROM e UNION ALL SELECT d, b FROM e) GROUP BY 1, 2),
q AS (SELECT d, min(k) AS k_min, max(k) AS k_max FROM g GROUP BY 1),
u AS (SELECT d, count(*) AS n_distinct FROM (SELECT DISTINCT d, least(a, b) AS a, greatest(a, b) AS b FROM e) GROUP BY 1)
SELECT CAST(d AS INTEGER) AS d, count(*) AS n_pairs, any_value(k_min) = any_value(k_max) AS regular, any_value(k_max) = d AS degree_ok, count(*) - any_value(n_distinct) AS n_repeated, count(*) FILTER (a = b) AS n_self, count(*) FILTER (same) AS n_same_source, round(avg(CAST(crossed AS INT)), 6) AS crossed FROM e JOIN q USING (d) JOIN u USING (d) GROUP BY d"""))
def nested_graph_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each nested degree: is the graph regular, are pairs repeated or of one item, how many are of one source or cross outcomes?"""
    from .fixtures import items

    it = items(spark, sf_dir)
    side = lambda s: it.select(F.col("i").alias(s), F.col("source").alias(f"s_{s}"), (F.col("doc_id") % 2).alias(f"o_{s}"))
    e = pairs(spark, sf_dir).select("a", "b", "round").join(side("a"), "a").join(side("b"), "b")
    e = e.select("*", F.explode(F.sequence(F.col("round").cast("int") + 1, F.lit(ROUNDS))).alias("d"))
    deg = e.select("d", F.explode(F.array("a", "b")).alias("node")).groupBy("d", "node").agg(F.count("*").alias("k")).groupBy("d").agg(F.min("k").alias("k_min"), F.max("k").alias("k_max"))
    once = e.select("d", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct().groupBy("d").agg(F.count("*").alias("n_distinct"))
    out = e.groupBy("d").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("a") == F.col("b")).alias("n_self"), F.count_if(F.col("s_a") == F.col("s_b")).alias("n_same_source"), F.round(F.avg((F.col("o_a") != F.col("o_b")).cast("double")), 6).alias("crossed"))
    out = out.join(deg, "d").join(once, "d")
    return out.select("d", "n_pairs", (F.col("k_min") == F.col("k_max")).alias("regular"), (F.col("k_max") == F.col("d")).alias("degree_ok"), (F.col("n_pairs") - F.col("n_distinct")).alias("n_repeated"), "n_self", "n_same_source", "crossed")


@query("q_matching_resample", sql(f""",
x AS (SELECT rep, {MD5.format("'match:' || rep || ':' || j")} % {ROUNDS} AS round FROM (SELECT unnest(range(20)) AS rep), (SELECT unnest(range({ROUNDS})) AS j))
SELECT CAST(rep AS INTEGER) AS rep, count(*) AS n_pairs, count(DISTINCT pair_index) AS n_distinct FROM x JOIN pairs p ON p.round = x.round GROUP BY 1"""))
def matching_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole matchings drawn with replacement: their pairs, those drawn twice kept twice."""
    x = spark.range(20).select(F.col("id").cast("int").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(ROUNDS - 1))).alias("j"))
    x = x.select("rep", (h("match", F.col("rep"), F.col("j")) % ROUNDS).alias("round"))
    return pairs(spark, sf_dir).join(F.broadcast(x), "round").groupBy("rep").agg(F.count("*").alias("n_pairs"), F.countDistinct("pair_index").alias("n_distinct"))


@query("q_letter_resample", f"""
WITH u AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, CASE WHEN (n_chars > 1500) = (quality = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ok FROM documents JOIN labels USING (doc_id)),
x AS (SELECT rep, {MD5.format("'letters:' || rep || ':' || pos")} % (SELECT count(*) FROM u) AS i FROM (SELECT unnest(range(20)) AS rep), (SELECT unnest(range((SELECT count(*) FROM u))) AS pos)),
m AS (SELECT rep, i, count(*) AS times FROM x GROUP BY 1, 2)
SELECT rep, CAST(sum(times) AS BIGINT) AS n, count(*) AS n_distinct, round(sum(times * ok) / sum(times), 6) AS acc, round(avg(ok), 6) AS acc_distinct FROM m JOIN u USING (i) GROUP BY 1""")
def letter_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items drawn with replacement: a fit sees each drawn item once, the evaluation as often as it was drawn."""
    from ..operators.order import numbered

    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    u = numbered(d.select("doc_id", ((F.col("n_chars") > 1500) == (F.col("quality") == 1)).cast("double").alias("ok")), ["doc_id"])
    m = stats.replicate_index(u, u.count(), 20, "letters").groupBy("rep", "i").agg(F.count("*").alias("times")).join(u, "i")
    return m.groupBy("rep").agg(F.sum("times").alias("n"), F.count("*").alias("n_distinct"), F.round(F.sum(F.col("times") * F.col("ok")) / F.sum("times"), 6).alias("acc"), F.round(F.avg("ok"), 6).alias("acc_distinct"))


KS, SUBSETS, DRAWS = (2, 3, 5), 4, 40
CURVE_SQL = f"""
WITH pr AS (SELECT row_number() OVER (ORDER BY conv_id) - 1 AS pair, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
ks AS (SELECT unnest([{', '.join(map(str, KS))}]) AS k), arms AS (SELECT unnest(['a', 'b']) AS arm), ss AS (SELECT unnest(range({SUBSETS})) AS subset),
c AS (SELECT arm, k, subset, pair, CAST({MD5.format("arm || ':' || k || ':' || subset || ':' || conv_id")} % 100 < CASE arm WHEN 'a' THEN 60 ELSE 54 END + k AS INT) AS ok FROM pr, ks, arms, ss),
reps AS (SELECT unnest(range({DRAWS})) AS rep),
w AS (SELECT rep, arm, k, subset, 1.0::DOUBLE / {SUBSETS} AS w FROM reps, ks, arms, ss WHERE k = 5 UNION ALL
  SELECT rep, arm, k, {MD5.format("'subset:' || rep || ':' || arm || ':' || k || ':' || subset")} % {SUBSETS} AS subset, count(*) * 1.0::DOUBLE / {SUBSETS} FROM reps, ks, arms, ss WHERE k <> 5 GROUP BY 1, 2, 3, 4),
x AS (SELECT rep, {MD5.format("'pairs:' || rep || ':' || pos")} % (SELECT count(*) FROM pr) AS pair, count(*) AS times FROM reps, (SELECT pair AS pos FROM pr) GROUP BY 1, 2),
acc AS (SELECT rep, arm, k, sum(times * w * ok) / (SELECT count(*) FROM pr) AS acc FROM c JOIN x USING (pair) JOIN w USING (rep, arm, k, subset) GROUP BY 1, 2, 3),
d AS (SELECT rep, k, max(CASE arm WHEN 'a' THEN acc END) - max(CASE arm WHEN 'b' THEN acc END) AS d FROM acc GROUP BY 1, 2),
pt AS (SELECT k, avg(CASE arm WHEN 'a' THEN ok END) AS acc_a, avg(CASE arm WHEN 'b' THEN ok END) AS acc_b FROM c GROUP BY 1),
bd AS (SELECT k, acc_a, acc_b, acc_a - acc_b AS delta, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi, stddev_samp(d) AS se FROM d JOIN pt USING (k) GROUP BY ALL),
far AS (SELECT rep, max(abs(d - delta) / se) AS t FROM d JOIN bd USING (k) GROUP BY 1),
q AS (SELECT quantile_cont(t, 0.95) AS q FROM far)"""


def _curves(spark: SparkSession, sf_dir: str):
    from ..operators.order import numbered

    pr = numbered(table(spark, sf_dir, "conversations").select("conv_id").distinct(), ["conv_id"], "pair")
    each = lambda vals: F.explode(F.array(*map(F.lit, vals)))
    c = pr.select("conv_id", "pair", each(KS).alias("k")).select("*", each(("a", "b")).alias("arm")).select("*", each(range(SUBSETS)).alias("subset"))
    ok = h(F.col("arm"), F.col("k"), F.col("subset"), F.col("conv_id")) % 100 < F.when(F.col("arm") == "a", 60).otherwise(54) + F.col("k")
    c = c.select("arm", "k", F.col("subset").cast("long").alias("subset"), "pair", ok.cast("int").alias("ok"))
    panels = spark.createDataFrame([(arm, k, k == 5, SUBSETS) for arm in "ab" for k in KS], "arm string, k int, exact boolean, n_subsets long")
    return matched_k.curves(c, panels, "a", "b", pr.count(), DRAWS)


@query("q_matched_k_curve", CURVE_SQL + """,
sp AS (SELECT arm, k, subset, avg(ok) AS acc FROM c GROUP BY 1, 2, 3),
gp AS (SELECT a.k, a.acc - b.acc AS g FROM sp a JOIN sp b ON a.k = b.k AND a.arm = 'a' AND b.arm = 'b'),
sd AS (SELECT k, quantile_cont(g, 0.1) AS spread_lo, quantile_cont(g, 0.9) AS spread_hi, avg(CASE WHEN g > 0 THEN 1.0 WHEN g = 0 THEN 0.5 ELSE 0.0 END) AS wins FROM gp GROUP BY 1)
SELECT k, round(acc_a, 6) AS acc_a, round(acc_b, 6) AS acc_b, round(delta, 6) + 0.0::DOUBLE AS delta, round(lo, 6) + 0.0::DOUBLE AS lo, round(hi, 6) + 0.0::DOUBLE AS hi, round(delta - q * se, 6) + 0.0::DOUBLE AS lo_simul, round(delta + q * se, 6) + 0.0::DOUBLE AS hi_simul, round(spread_lo, 6) + 0.0::DOUBLE AS spread_lo, round(spread_hi, 6) + 0.0::DOUBLE AS spread_hi, round(wins, 6) AS p_subset_a_wins FROM bd JOIN sd USING (k), q""")
def matched_k_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two panels' accuracies at matched sizes with pointwise and simultaneous bounds of their difference."""
    by_k, _ = _curves(spark, sf_dir)
    names = ["acc_a", "acc_b", "delta", "lo", "hi", "lo_simul", "hi_simul", "spread_lo", "spread_hi", "p_subset_a_wins"]
    return by_k.select("k", *[(F.round(c, 6) + 0.0).alias(c) for c in names])


@query("q_matched_k_summary", CURVE_SQL + """,
e AS (SELECT avg(delta) AS estimate FROM bd), m AS (SELECT rep, avg(d) AS m FROM d GROUP BY 1)
SELECT round(any_value(estimate), 6) + 0.0::DOUBLE AS estimate, round(quantile_cont(m, 0.025), 6) + 0.0::DOUBLE AS lo, round(quantile_cont(m, 0.975), 6) + 0.0::DOUBLE AS hi, round(stddev_samp(m), 6) AS se, round(avg(CASE WHEN abs(m - estimate) >= abs(estimate) - 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS p, count(*) AS n_boot FROM m, e""")
def matched_k_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = matched_k.summary(*_curves(spark, sf_dir))
    return s.select(*[(F.round(c, 6) + 0.0).alias(c) for c in ("estimate", "lo", "hi", "se", "p")], "n_boot")


@query("q_embedding_similarities", """
WITH v AS (SELECT vec_id // 4 AS t, vec_id % 4 AS c, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT r.t, r.c AS rc, o.c AS oc, list_sum(list_transform(list_zip(r.v, o.v), lambda z: z[1] * z[2])) AS s FROM v r JOIN v o ON o.t = r.t + 1 AND r.t % 2 = 0),
w AS (SELECT r.t, list_sum(list_transform(list_zip(r.v, o.v), lambda z: z[1] * z[2])) AS s FROM v r JOIN v o ON o.t = r.t AND o.c > r.c AND r.t % 2 = 0),
rm AS (SELECT t, avg(m) AS reply_grounded FROM (SELECT t, rc, max(s) AS m FROM s GROUP BY 1, 2) GROUP BY 1), om AS (SELECT t, avg(m) AS op_addressed FROM (SELECT t, oc, max(s) AS m FROM s GROUP BY 1, 2) GROUP BY 1),
od AS (SELECT t, avg(s) AS within_reply FROM w GROUP BY 1)
SELECT t, round(max(CASE WHEN rc = 0 AND oc = 0 THEN s END), 5) AS whole, round(max(s), 5) AS s_max, round(min(s), 5) AS s_min, round(avg(s), 5) AS s_mean, round(stddev_pop(s), 5) AS s_std, round(any_value(reply_grounded), 5) AS reply_grounded, round(any_value(op_addressed), 5) AS op_addressed, round(coalesce(any_value(within_reply), 0), 5) AS within_reply FROM s JOIN rm USING (t) JOIN om USING (t) LEFT JOIN od USING (t) GROUP BY 1""")
def embedding_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply's chunks against those of what it answers: extremes, mean, spread, how well each covers the other, and the reply's own unity."""
    v = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 4").alias("t"), (F.col("vec_id") % 4).alias("c"), "embedding")
    r = v.filter("t % 2 = 0").select("t", F.col("c").alias("rc"), F.col("embedding").alias("x"))
    o = v.filter("t % 2 = 1").select((F.col("t") - 1).alias("t"), F.col("c").alias("oc"), F.col("embedding").alias("y"))
    s = r.join(o, "t").select("t", "rc", "oc", cosine(F.col("x"), F.col("y")).alias("s"))
    best = lambda c, n: s.groupBy("t", c).agg(F.max("s").alias("m")).groupBy("t").agg(F.avg("m").alias(n))
    own = r.join(r.select("t", F.col("rc").alias("rd"), F.col("x").alias("z")), "t").filter("rd > rc").groupBy("t").agg(F.avg(cosine(F.col("x"), F.col("z"))).alias("within_reply"))
    out = s.groupBy("t").agg(F.max(F.when((F.col("rc") == 0) & (F.col("oc") == 0), F.col("s"))).alias("whole"), F.max("s").alias("s_max"), F.min("s").alias("s_min"), F.avg("s").alias("s_mean"), F.stddev_pop("s").alias("s_std"))
    out = out.join(best("rc", "reply_grounded"), "t").join(best("oc", "op_addressed"), "t").join(own, "t", "left").fillna(0.0, ["within_reply"])
    return out.select("t", *[F.round(c, 5).alias(c) for c in ("whole", "s_max", "s_min", "s_mean", "s_std", "reply_grounded", "op_addressed", "within_reply")])


PARAM_SQL = """
WITH p AS (SELECT 's[' || (user_id % 30) || ',' || event_type || ']' AS name, avg(value) / 100 AS value, stddev_pop(value) / 100 / sqrt(count(*)) AS se FROM events GROUP BY 1)"""


@query("q_wald_intervals", PARAM_SQL + f" SELECT name, round(value, 6) AS value, round(value - se * {normal_upper('0.05::DOUBLE')}, 6) AS lo90, round(value + se * {normal_upper('0.05::DOUBLE')}, 6) AS hi90, round(value - se * {normal_upper('0.005::DOUBLE')}, 6) AS lo99, round(value + se * {normal_upper('0.005::DOUBLE')}, 6) AS hi99 FROM p")
def wald_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named parameters with Wald intervals at two levels."""
    e = table(spark, sf_dir, "events")
    name = F.concat(F.lit("s["), (F.col("user_id") % 30).cast("string"), F.lit(","), "event_type", F.lit("]"))
    p = e.groupBy(name.alias("name")).agg((F.avg("value") / 100).alias("value"), (F.stddev_pop("value") / 100 / F.sqrt(F.count("*"))).alias("se"))
    z = lambda q: F.expr(normal_upper(f"{q}::DOUBLE"))
    bound = lambda s, q: F.round(F.col("value") + s * F.col("se") * z(q), 6)
    return p.select("name", F.round("value", 6).alias("value"), bound(-1, 0.05).alias("lo90"), bound(1, 0.05).alias("hi90"), bound(-1, 0.005).alias("lo99"), bound(1, 0.005).alias("hi99"))


@query("q_score_spread", """
WITH s AS (SELECT user_id % 30 AS i, event_type AS k, avg(value) / 50 AS s FROM events GROUP BY 1, 2),
m AS (SELECT *, s - avg(s) OVER (PARTITION BY k) AS c, count(*) OVER (PARTITION BY k) AS n FROM s),
v AS (SELECT k, any_value(n) AS n, sum(c * c) / any_value(n) AS var, 0.0004::DOUBLE AS noise FROM m GROUP BY 1),
g AS (SELECT a.k, sum(2 * a.c / a.n * 2 * b.c / b.n * 0.0004 * exp(-abs(a.i - b.i))) AS vv FROM m a JOIN m b ON a.k = b.k GROUP BY 1)
SELECT k, n, round(sqrt(var), 6) AS sd, round(sqrt(greatest(var - noise, 0)), 6) AS sd_denoised, round((var - noise) / var, 6) AS rho, round(sqrt(greatest(vv, 0)) / (2 * sqrt(var)), 6) AS se, round(sqrt(greatest(vv, 0)) / (2 * sqrt(nullif(greatest(var - noise, 0), 0))), 6) AS se_denoised FROM v JOIN g USING (k)""")
def score_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of each criterion's scores, raw and without noise, with standard errors by the delta method over a covariance."""
    e = table(spark, sf_dir, "events")
    s = e.groupBy((F.col("user_id") % 30).alias("i"), F.col("event_type").alias("k")).agg((F.avg("value") / 50).alias("s"))
    one = W.partitionBy("k")
    m = s.select("i", "k", (F.col("s") - F.avg("s").over(one)).alias("c"), F.count("*").over(one).alias("n"))
    cov = m.join(m.select("k", F.col("i").alias("j"), F.col("c").alias("d")), "k").withColumn("cov", 0.0004 * F.exp(-F.abs(F.col("i") - F.col("j"))))
    return delta_spread(m.withColumn("noise", F.lit(0.0004)), cov)


def delta_spread(scores: DataFrame, cov: DataFrame) -> DataFrame:
    """``k, n, sd, sd_denoised, rho, se, se_denoised`` from centred scores (``i, k, c, n, noise``) and their covariances.

    ``cov``: ``k, i, j, c, d, n, cov`` for both items of every entry of a criterion's block. The variance of the spread is
    the quadratic form of its gradient; noise is taken as known, so the error of the denoised spread is a lower bound.
    """
    v = scores.groupBy("k").agg(F.first("n").alias("n"), (F.sum(F.col("c") * F.col("c")) / F.first("n")).alias("var"), F.avg("noise").alias("noise"))
    g = cov.groupBy("k").agg(F.sum(2 * F.col("c") / F.col("n") * 2 * F.col("d") / F.col("n") * F.col("cov")).alias("vv"))
    true = F.greatest(F.col("var") - F.col("noise"), F.lit(0.0))
    root = F.sqrt(F.greatest("vv", F.lit(0.0)))
    out = v.join(g, "k").select("k", "n", F.sqrt("var").alias("sd"), F.sqrt(true).alias("sd_denoised"), ((F.col("var") - F.col("noise")) / F.col("var")).alias("rho"), (root / (2 * F.sqrt("var"))).alias("se"), (root / (2 * F.sqrt(F.when(true > 0, true)))).alias("se_denoised"))
    return out.select("k", "n", *[F.round(c, 6).alias(c) for c in ("sd", "sd_denoised", "rho", "se", "se_denoised")])
