"""Queries over requests to judges, their answers and what they cost."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import judgments as J
from ..functions.numeric import md5_number
from ..operators import costs
from ..operators import requests as R
from .registry import query, table
from .stat_queries import PRICES
from .text_queries import NAMES, _answers

MD5 = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
SCHEMA = {"name": "verdict", "schema": {"type": "object", "properties": {"winner": {"type": "string", "enum": ["A", "B"]}, "why": {"type": "array", "items": {"type": "object", "properties": {"name": {"type": "string"}}, "additionalProperties": False}}}, "additionalProperties": False}}
KINDS = ("chat", "responses", "messages", "generate", "tool_chat")


def _raw(x) -> str:
    return json.dumps(x, separators=(",", ":"), ensure_ascii=False)


_S = _raw(SCHEMA["schema"])
_G = _raw({"type": "object", "properties": {"winner": {"type": "string", "enum": ["A", "B"]}, "why": {"type": "array", "items": {"type": "object", "properties": {"name": {"type": "string"}}, "propertyOrdering": ["name"]}}}, "propertyOrdering": ["winner", "why"]})
_TURNS = """[{"role":"system","content":"Judge."},{"role":"user","content":' || u || '}]"""


@query("q_request_bodies", f"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'gpt-4-x' ELSE 'other-5' END AS m, CAST(to_json(coalesce(text, '')) AS VARCHAR) AS u FROM documents),
b AS (
  SELECT doc_id, 'chat' AS kind, CASE WHEN m = 'gpt-4-x' THEN '{{"model":"' || m || '","messages":{_TURNS},"max_tokens":900,"temperature":0.0,"seed":7}}' ELSE '{{"model":"' || m || '","messages":{_TURNS},"max_completion_tokens":900,"reasoning_effort":"low"}}' END AS body FROM d
  UNION ALL SELECT doc_id, 'responses', '{{"model":"' || m || '","input":{_TURNS},"max_output_tokens":900,"reasoning":{{"effort":"low"}},"text":{{"format":{{"type":"json_schema","name":"verdict","schema":{_S},"strict":true}}}}}}' FROM d
  UNION ALL SELECT doc_id, 'messages', '{{"model":"' || m || '","system":"Judge.","messages":[{{"role":"user","content":' || u || '}}],"max_tokens":900,"temperature":0.0,"tools":[{{"name":"verdict","description":"{R.TOOL_NOTE}","input_schema":{_S}}}],"tool_choice":{{"type":"tool","name":"verdict"}}}}' FROM d
  UNION ALL SELECT doc_id, 'generate', '{{"model":"' || m || '","contents":[{{"role":"user","parts":[{{"text":' || u || '}}]}}],"systemInstruction":{{"parts":[{{"text":"Judge."}}]}},"generationConfig":{{"maxOutputTokens":900,"temperature":0.0,"responseMimeType":"application/json","responseSchema":{_G},"thinkingConfig":{{"thinkingLevel":"off"}}}}}}' FROM d
  UNION ALL SELECT doc_id, 'tool_chat', '{{"model":"' || m || '","messages":{_TURNS},"max_tokens":900,"temperature":0.0,"thinking":{{"type":"off"}},"tools":[{{"type":"function","function":{{"name":"verdict","description":"{R.TOOL_NOTE}","parameters":{_S},"strict":true}}}}],"tool_choice":{{"type":"function","function":{{"name":"verdict"}}}}}}' FROM d)
SELECT doc_id, kind, length(body) AS n, md5(body) AS digest FROM b""")
def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body of each document's request to each of five interfaces."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "gpt-4-x").otherwise("other-5").alias("m"), "text")
    bodies = [F.struct(F.lit(k).alias("kind"), R.body(k, F.col("m"), F.lit("Judge."), F.col("text"), 900, seed=7, schema=SCHEMA, effort="low", thinking="off").alias("body")) for k in KINDS]
    return d.select("doc_id", F.explode(F.array(*bodies)).alias("e")).select("doc_id", "e.kind", F.length("e.body").cast("long").alias("n"), F.md5("e.body").alias("digest"))


@query("q_response_texts", """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN lang WHEN 1 THEN source WHEN 2 THEN lang || source WHEN 3 THEN '{"winner":"A"}' WHEN 4 THEN lang || source ELSE '' END AS said FROM documents""")
def response_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts from answers of four shapes, a prose one and an empty one."""
    q = R.quoted
    i, lang, source = F.col("doc_id") % 6, F.col("lang"), F.col("source")
    t = lambda kind, text: R.fields(("type", f'"{kind}"'), ("text", q(text)))
    answer = (
        F.when(i == 0, R.fields(("choices", F.concat(F.lit("["), R.fields(("message", R.fields(("content", q(lang))))), F.lit("]")))))
        .when(i == 1, R.fields(("output_text", q(source))))
        .when(i == 2, F.concat(F.lit('{"output":[{"type":"reasoning"},{"content":['), t("output_text", lang), F.lit(","), t("refusal", lang), F.lit("]},{\"content\":["), t("text", source), F.lit("]}]}")))
        .when(i == 3, F.concat(F.lit('{"content":['), t("text", lang), F.lit(',{"type":"tool_use","input":{"winner":"A"}}]}')))
        .when(i == 4, F.concat(F.lit('{"content":['), t("text", lang), F.lit(","), t("text", source), F.lit("]}")))
        .otherwise(F.lit("{}"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", R.response_text(answer).alias("said"))


@query("q_score_fan_out", f"""
WITH e AS (SELECT doc_id, CAST(rep AS INTEGER) AS rep FROM documents, (SELECT unnest(range(3)) AS rep)),
n AS (SELECT doc_id, rep, name, {MD5.format("'f:' || doc_id || ':' || rep || ':' || name")} AS h FROM e, (SELECT unnest(['clarity', 'depth', 'tone']) AS name))
SELECT doc_id, rep, rep % 2 AS variant, string_agg(name, ',' ORDER BY h, name) AS criteria FROM n GROUP BY 1, 2""")
def score_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per item and replicate: alternating wording, criteria in an order of their own."""
    f = R.fan_out(table(spark, sf_dir, "documents"), "doc_id", ["clarity", "depth", "tone"], 3, 2, "f")
    return f.select("doc_id", "rep", "variant", F.array_join("criteria", ",").alias("criteria"))


@query("q_mirrored_pairs", f"""
WITH p AS (SELECT conv_id AS pair_id, count(*) FILTER (role = 'user') AS n_user, {MD5.format("'slot:' || conv_id")} % 2 = 0 AS front FROM conversations GROUP BY 1)
SELECT pair_id, CAST(o AS INTEGER) AS o, CASE WHEN front = (o = 1) THEN 'winner' ELSE 'loser' END AS first_shown, front = (o = 1) AS win_in_a FROM p, (SELECT unnest([1, 2]) AS o)""")
def mirrored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both orders of every pair; which comes first in order 1 is a seeded hash."""
    p = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pair_id")).distinct()
    front = md5_number(F.concat_ws(":", F.lit("slot"), F.col("pair_id").cast("string"))) % 2 == 0
    p = p.select("pair_id", front.alias("front"), F.explode(F.array(F.lit(1), F.lit(2))).alias("o")).withColumn("win_in_a", F.col("front") == (F.col("o") == 1))
    return p.select("pair_id", "o", F.when(F.col("win_in_a"), "winner").otherwise("loser").alias("first_shown"), "win_in_a")


@query("q_distinct_requests", """
WITH r AS (SELECT conv_id, turn, md5(role || ':' || coalesce(text, '')) AS h FROM conversations)
SELECT h, arg_min(conv_id, (conv_id, turn)) AS conv_id, arg_min(turn, (conv_id, turn)) AS turn, count(*) AS n FROM r GROUP BY 1""")
def distinct_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is submitted: the first of equal requests, with how many it stands for."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.concat_ws(":", "role", F.coalesce("text", F.lit("")))).alias("h"))
    return c.groupBy("h").agg(F.min(F.struct("conv_id", "turn")).alias("at"), F.count("*").alias("n")).select("h", "at.conv_id", "at.turn", "n")


@query("q_panel_audit", """
WITH a AS (SELECT doc_id, doc_id % 7 AS shape, CASE WHEN doc_id % 7 IN (0, 1) THEN doc_id % 23 ELSE 0 END AS s FROM documents),
d AS (SELECT shape, s, count(*) AS n FROM a GROUP BY 1, 2)
SELECT CASE WHEN shape IN (0, 1, 2) THEN 'missing' WHEN shape = 3 THEN 'unknown' WHEN shape = 6 THEN 'empty' ELSE 'malformed' END AS fault, count(*) AS n_distinct, CAST(sum(n) AS BIGINT) AS n_requests FROM d GROUP BY 1""")
def panel_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of panel answers, each distinct answer looked at once."""
    distinct = _answers(spark, sf_dir).groupBy("answer").agg(F.count("*").alias("n"))
    f = distinct.withColumn("fault", J.panel_fault(F.col("answer"), F.array(*map(F.lit, NAMES))))
    return f.filter("fault is not null").groupBy("fault").agg(F.count("*").alias("n_distinct"), F.sum("n").alias("n_requests"))


@query("q_bt_assembly", """
SELECT doc_id AS pair_index, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'anchor' END AS grp, f.name AS feature, CASE WHEN doc_id % 7 IN (0, 1) THEN f.a ELSE f.b END AS winner
FROM documents, (VALUES ('clarity', 'A', 'A'), ('tone', 'B', NULL), ('depth', NULL, 'B')) f(name, a, b) WHERE doc_id % 7 IN (0, 1, 3) AND CASE WHEN doc_id % 7 IN (0, 1) THEN f.a ELSE f.b END IS NOT NULL""")
def bt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per comparison and criterion that an answer decides; empty and malformed answers give none."""
    w = J.winners(F.col("answer"), F.array(*map(F.lit, NAMES)))
    a = _answers(spark, sf_dir).select(F.col("doc_id").alias("pair_index"), F.when(F.col("doc_id") % 5 == 0, "test").otherwise("anchor").alias("grp"), F.explode(w).alias("e"))
    return a.select("pair_index", "grp", F.col("e.name").alias("feature"), "e.winner")


@query("q_assembly_report", """
WITH s AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, CASE doc_id % 7 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 3 THEN 3 ELSE 0 END AS got, CASE WHEN doc_id % 7 = 6 THEN 1 ELSE 0 END AS empty, CASE WHEN doc_id % 7 IN (4, 5) THEN 1 ELSE 0 END AS bad FROM documents)
SELECT split, count(*) FILTER (empty + bad = 0) AS n_items, CAST(sum(empty) AS BIGINT) AS n_empty, CAST(sum(bad) AS BIGINT) AS n_malformed, count(*) FILTER (empty + bad = 0 AND got < 3) AS n_incomplete, round(sum(CASE WHEN empty + bad = 0 THEN got END) / (3.0 * count(*) FILTER (empty + bad = 0)), 6) AS coverage FROM s GROUP BY 1""")
def assembly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored items, empty, malformed and incomplete answers, and the share of scores there are, by split."""
    names, a = F.array(*map(F.lit, NAMES)), F.col("answer")
    fault = J.panel_fault(a, names)
    s = _answers(spark, sf_dir).select(F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"), F.size(J.pointwise(a, names)).alias("got"), fault.alias("fault"))
    ok = ~F.coalesce(F.col("fault").isin("empty", "malformed"), F.lit(False))
    out = s.groupBy("split").agg(F.count_if(ok).alias("n_items"), F.count_if(F.col("fault") == "empty").alias("n_empty"), F.count_if(F.col("fault") == "malformed").alias("n_malformed"), F.count_if(ok & (F.col("got") < len(NAMES))).alias("n_incomplete"), F.sum(F.when(ok, F.col("got"))).alias("got"))
    return out.select("split", "n_items", "n_empty", "n_malformed", "n_incomplete", F.round(F.col("got") / (float(len(NAMES)) * F.col("n_items")), 6).alias("coverage"))


@query("q_pointwise_panel", """
SELECT doc_id AS item, CAST(CASE WHEN doc_id % 7 IN (0, 1) THEN least(doc_id % 23, 10) WHEN doc_id % 7 = 3 THEN 0 END AS INTEGER) AS clarity, CAST(CASE WHEN doc_id % 7 IN (0, 1) THEN 2 WHEN doc_id % 7 = 3 THEN 4 END AS INTEGER) AS tone, CAST(CASE WHEN doc_id % 7 = 3 THEN 10 END AS INTEGER) AS depth FROM documents WHERE doc_id % 7 IN (0, 1, 3)""")
def pointwise_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every answered item, a column per criterion, null where the answer leaves one out."""
    p = J.pointwise(F.col("answer"), F.array(*map(F.lit, NAMES)))
    s = _answers(spark, sf_dir).select(F.col("doc_id").alias("item"), F.explode(p).alias("e"))
    return s.groupBy("item").pivot("e.name", list(NAMES)).agg(F.first("e.score"))


COST_SQL = f"""
WITH prices(name, pi, po) AS (VALUES {', '.join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE)" for n, a, b in PRICES)}),
u AS (SELECT event_id, user_id % 10 AS rep, 'judge' AS model, 1000 + event_id % 700 AS tin, 100 + event_id % 90 AS tout FROM events),
c AS (SELECT u.*, tin * CAST(round(pi * 10000) AS BIGINT) + tout * CAST(round(po * 10000) AS BIGINT) AS units FROM u JOIN prices ON name = model)"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch requests of ten replicates with tokens and price."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10).alias("rep"), F.lit("judge").alias("model"), (1000 + F.col("event_id") % 700).alias("tin"), (100 + F.col("event_id") % 90).alias("tout"))
    e = costs.priced(e, spark.createDataFrame(list(PRICES), "name string, price_in double, price_out double"))
    return e.withColumn("units", costs.cost_units(F.col("tin"), F.col("tout"), F.col("price_in"), F.col("price_out"), F.lit(True)))


@query("q_replicate_costs", COST_SQL + " SELECT rep, count(*) AS n, CAST(sum(tin) AS BIGINT) AS tokens_in, CAST(sum(tout) AS BIGINT) AS tokens_out, sum(units)::DOUBLE / 2e10::DOUBLE AS usd FROM c GROUP BY 1")
def replicate_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage(spark, sf_dir).groupBy("rep").agg(F.count("*").alias("n"), F.sum("tin").alias("tokens_in"), F.sum("tout").alias("tokens_out"), (F.sum("units") / costs.UNITS).alias("usd"))


@query("q_drawn_replicate_costs", COST_SQL + f""",
r AS (SELECT rep AS i, sum(units) AS units FROM c GROUP BY 1),
x AS (SELECT b, j, {MD5.format("'cost:' || b || ':' || j")} % 10 AS i FROM (SELECT unnest(range(50)) AS b), (SELECT unnest(range(4)) AS j))
SELECT CAST(b AS INTEGER) AS b, (sum(r.units) + 200000000 * b + 4000000000)::DOUBLE / 2e10::DOUBLE AS usd FROM x JOIN r USING (i) GROUP BY b""")
def drawn_replicate_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a replicate costs: four elicitations drawn with replacement, a fusion call of its own, and scoring."""
    r = usage(spark, sf_dir).groupBy(F.col("rep").alias("i")).agg(F.sum("units").alias("units"))
    x = spark.range(50).select(F.col("id").cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))
    x = x.withColumn("i", md5_number(F.concat_ws(":", F.lit("cost"), F.col("b").cast("string"), F.col("j").cast("string"))) % 10)
    return x.join(F.broadcast(r), "i").groupBy("b").agg(F.sum("units").alias("units")).select("b", ((F.col("units") + F.lit(200_000_000).cast("long") * F.col("b") + 4_000_000_000) / costs.UNITS).alias("usd"))


@query("q_cost_projection", COST_SQL + """,
m AS (SELECT avg(CASE WHEN event_id % 10 = 0 THEN tin END) AS tin, avg(CASE WHEN event_id % 10 = 0 THEN tout END) AS tout, count(*) AS n FROM c),
z AS (SELECT 'measured' AS basis, tin, tout, n FROM m UNION ALL SELECT 'none', NULL, NULL, n FROM m)
SELECT basis, round(n * (coalesce(tin, 2200) * 1.0 + coalesce(tout, 260) * 5.0) / 1e6 * 0.5, 6) AS usd FROM z""")
def cost_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all requests will cost, from the mean tokens of a trial tenth; fixed means stand in where there is no trial."""
    trial = F.col("event_id") % 10 == 0
    m = usage(spark, sf_dir).agg(F.avg(F.when(trial, F.col("tin"))).alias("tin"), F.avg(F.when(trial, F.col("tout"))).alias("tout"), F.count("*").alias("n"))
    none = F.lit(None).cast("double")
    z = m.select(F.explode(F.array(F.struct(F.lit("measured").alias("basis"), "tin", "tout", "n"), F.struct(F.lit("none").alias("basis"), none.alias("tin"), none.alias("tout"), "n"))).alias("e")).select("e.*")
    total = costs.usd(F.coalesce("tin", F.lit(2200)), F.coalesce("tout", F.lit(260)), F.lit(1.0), F.lit(5.0), F.lit(True))
    return z.select("basis", F.round(F.col("n") * total, 6).alias("usd"))


@query("q_ledger", """
SELECT 'documents.n' AS id, count(*) AS value FROM documents UNION ALL SELECT 'labels.toxic', CAST(sum(toxic) AS BIGINT) FROM labels UNION ALL SELECT 'pages.n', count(*) FROM pages""")
def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported numbers under ids of their own; an id that repeats is an error."""
    rows = [("documents.n", "documents", F.count("*")), ("labels.toxic", "labels", F.sum("toxic").cast("long")), ("pages.n", "pages", F.count("*"))]
    out = None
    for name, t, value in rows:
        one = table(spark, sf_dir, t).agg(value.alias("value")).select(F.lit(name).alias("id"), "value")
        out = one if out is None else out.unionByName(one)
    return R.ledger(out)
