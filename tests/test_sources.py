import json

import pytest
from pyspark.sql import functions as F

from loomline import streaming
from loomline.operators import costs
from loomline.sources import loaders


def test_loaders(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text,score\n1,"two\nlines",3.5\n2,,4\n3,x,bad\n')
    df = loaders.csv_items(spark, str(tmp_path / "a.csv"), {"id": "long", "text": "string", "score": "double"})
    assert [(r.id, r.text, r.score) for r in df.collect()] == [(1, "two\nlines", 3.5)]
    with pytest.raises(ValueError):
        loaders.csv_items(spark, str(tmp_path / "a.csv"), {"absent": "string"})
    spark.range(3).withColumn("prompt_name", F.lit("p")).write.parquet(str(tmp_path / "b.parquet"))
    assert loaders.table_items(spark, str(tmp_path / "b.parquet"), "p").count() == 3
    with pytest.raises(ValueError):
        loaders.table_items(spark, str(tmp_path / "b.parquet"), "q")
    (tmp_path / "u.jsonl").write_text('{"id": "a", "meta": {"pair_ids": ["p", "q"]}}\n{"id": "b", "meta": {}}\n')
    assert sorted((r.id, str(r.pair_id)) for r in loaders.utterances(spark, str(tmp_path / "u.jsonl")).collect()) == [("a", "p"), ("a", "q"), ("b", "None")]
    (tmp_path / "m.json").write_text('{"x": {"n": 1},\n "y": {"n": 2}}')
    assert sorted((r.key, r.n) for r in loaders.keyed_document(spark, str(tmp_path / "m.json"), "struct<n:int>").collect()) == [("x", 1), ("y", 2)]
    (tmp_path / "c/aa").mkdir(parents=True)
    (tmp_path / "c/aa/1.json").write_text('{"request_hash": "h", "text": "t",\n "usage": {"input_tokens": 5}}')
    (tmp_path / "c/aa/2.json").write_text("{broken")
    assert [(r.request_hash, r.usage.input_tokens) for r in loaders.cache_records(spark, str(tmp_path / "c")).collect()] == [("h", 5)]


def test_scores_are_found_wherever_a_batch_puts_them(spark, tmp_path):
    scores = [{"dimension": "tone", "score": 3}, {"dimension": "depth", "score": 4.5}]
    bodies = [{"output": [{"content": [{"text": json.dumps({"scores": scores})}]}]}, {"a": {"scores": "none"}, "b": [{"scores": scores[:1]}]}, {"text": '{"scores" broken'}, {}]
    lines = [{"custom_id": f"m:b00{i}:L{i}", "response": {"body": b}} for i, b in enumerate(bodies)] + [{"custom_id": "other", "response": {"body": bodies[0]}}, {"custom_id": "m:b7:L9"}]
    (tmp_path / "out.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = sorted(map(tuple, loaders.batch_scores(spark, str(tmp_path / "out.jsonl")).collect()))
    assert got == [(0, "L0", "depth", 4.5), (0, "L0", "tone", 3.0), (1, "L1", "tone", 3.0)]


def test_settings_are_layered():
    a, b = {"x": 1, "n": {"p": 1, "q": 2}}, {"n": {"q": 3}, "y": [1]}
    assert loaders.layered(a, b, {"y": []}) == {"x": 1, "n": {"p": 1, "q": 3}, "y": []} and a["n"]["q"] == 2


def test_lines_are_written_in_bounded_files(spark, tmp_path):
    df = spark.range(500).withColumn("body", F.repeat(F.lit("x"), 50))
    loaders.write_chunked_lines(df, str(tmp_path / "out"), "id", 5000)
    files = list((tmp_path / "out").glob("part-*"))
    assert len(files) > 5 and all(f.stat().st_size <= 5000 for f in files)
    assert sorted(json.loads(x)["id"] for f in files for x in f.read_text().splitlines()) == list(range(500))


def test_costs_and_cache(spark):
    prices = spark.createDataFrame([("m", 1.0, 2.0), ("m-mini", 0.1, 0.2)], "name string, price_in double, price_out double")
    r = costs.priced(spark.createDataFrame([("m",), ("m-mini-2026",), ("m-2026",), ("z",), (None,)], "model string"), prices)
    assert {(x.model, x.price_in) for x in r.collect()} == {("m", 1.0), ("m-mini-2026", 0.1), ("m-2026", 1.0), ("z", 2.5), (None, 2.5)}
    old = spark.createDataFrame([("a", None, "1"), ("b", "bad", "2")], "request_hash string, error string, text string")
    new = spark.createDataFrame([("a", None, "3"), ("b", None, "4")], "request_hash string, error string, text string")
    assert {(x.request_hash, x.text) for x in costs.merged_cache(old, new).collect()} == {("a", "1"), ("b", "4")}
    hit, miss = costs.cache_split(new, old)
    assert [x.request_hash for x in hit.collect()] == ["a"] and [x.request_hash for x in miss.collect()] == ["b"]
    u = spark.createDataFrame([('{"promptTokenCount": 3, "candidatesTokenCount": 4, "thoughtsTokenCount": 5}',), ("{}",), (None,)], "u string")
    assert [tuple(x) for x in u.select(*costs.tokens_used(F.col("u")).values()).collect()] == [(3, 9), (0, 0), (0, 0)]


def test_answers_stream_into_the_cache_once(spark, tmp_path):
    schema = "request_hash string, model string, text string, error string, received timestamp"
    rows = [("a", "m", "1", None, 0), ("a", "m", "2", None, 1), ("b", "m", None, "failed", 2), ("c", "n", "3", None, 3)]
    df = spark.createDataFrame(rows, "request_hash string, model string, text string, error string, s long").select("request_hash", "model", "text", "error", F.timestamp_seconds("s").alias("received"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = streaming.ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "cache"), str(tmp_path / "ckpt"))
        q.awaitTermination(120)
    assert sorted(x.request_hash for x in spark.read.parquet(str(tmp_path / "cache")).collect()) == ["a", "c"]


def test_word_list_serves_as_stop_words(spark, tmp_path):
    from loomline.functions import text as T

    (tmp_path / "stop.txt").write_text("The\n\n of \nthe\nzebra\n")
    stop = loaders.word_list(spark, str(tmp_path / "stop.txt"))
    assert stop == ("of", "the", "zebra")
    df = spark.createDataFrame([("the zebra runs", "a zebra of the plain runs")], "a string, o string")
    v = df.select(T.word_set_overlap(T.letter_tokens("a"), T.letter_tokens("o"), stop).alias("v")).first().v
    assert v[0] == 2.0 and v[4] == 1.0 and v[8] == 3.0
    with pytest.raises(ValueError):
        loaders.word_list(spark, str(tmp_path / "stop.txt"), 2)
