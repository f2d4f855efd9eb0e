"""Readers and writers of the corpora's file shapes."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

UTTERANCE = "id string, root string, user string, text string, timestamp double, meta struct<pair_ids:array<string>>"
RECORD = "request_hash string, custom_id string, model string, endpoint string, text string, usage struct<input_tokens:long,output_tokens:long>, source string, batch_id string, error string"


def csv_items(spark: SparkSession, path: str, required: dict[str, str]) -> DataFrame:
    """A CSV with a header; ``required`` maps columns to types; rows with a null in one go; a missing column is an error."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    typed = df.withColumns({c: F.col(c).try_cast(k) for c, k in required.items()})
    return typed.dropna(subset=list(required))


def table_items(spark: SparkSession, path: str, prompt: str | None = None, prompt_col: str = "prompt_name", **csv_options) -> DataFrame:
    """Parquet or CSV by suffix, one prompt's rows if asked for; an empty result is an error."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else csv_items(spark, path, csv_options.get("required", {}))
    df = df if prompt is None else df.filter(F.col(prompt_col) == prompt)
    if df.isEmpty():
        raise ValueError(f"no rows in {path}" + ("" if prompt is None else f" for {prompt}"))
    return df


def utterances(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited JSON, a row per utterance and pair it belongs to."""
    u = spark.read.schema(UTTERANCE).json(path)
    return u.withColumn("pair_id", F.explode_outer("meta.pair_ids")).drop("meta")


def keyed_document(spark: SparkSession, path: str, value: str) -> DataFrame:
    """One JSON document that maps keys to values of type ``value``: ``key, value`` rows."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string, {value}>"))).select("key", "value.*" if value.startswith("struct") else "value")


def cache_records(spark: SparkSession, path: str) -> DataFrame:
    """All cached answers under a folder; files that are not such JSON are skipped."""
    r = spark.read.schema(RECORD).option("recursiveFileLookup", True).option("mode", "DROPMALFORMED").option("multiLine", True).json(path)
    return r.filter("request_hash is not null")


def payload(body: Any, field: str) -> dict | None:
    """The first object with a list ``field`` in a parsed answer, in reading order, wherever it is nested or quoted as JSON."""
    todo = [body]
    while todo:
        x = todo.pop()
        if isinstance(x, str) and f'"{field}"' in x:
            try:
                x = json.loads(x)
            except ValueError:
                continue
        if isinstance(x, dict) and isinstance(x.get(field), list):
            return x
        if isinstance(x, dict | list):
            todo += reversed(list(x.values()) if isinstance(x, dict) else x)
    return None


def batch_scores(spark: SparkSession, path: str, field: str = "scores") -> DataFrame:
    """Scores of a batch's output lines: ``rep, item, name, score``, a row per score.

    ``custom_id`` has three parts, ``kind:b<rep>:<item>``; lines with another id, or without a payload, give no rows.
    """

    def found(bodies: pd.Series) -> pd.Series:
        out = []
        for b in bodies:
            try:
                got = payload(json.loads(b), field) if b else None
            except ValueError:
                got = None
            out.append(None if got is None else json.dumps(got[field]))
        return pd.Series(out, dtype=object)

    lines = spark.read.text(path).select(F.get_json_object("value", "$.custom_id").alias("id"), F.get_json_object("value", "$.response.body").alias("body"))
    parts = F.split("id", ":")
    lines = lines.filter(F.size(parts) == 3).select(F.substring(parts[1], 2, 9).try_cast("int").alias("rep"), parts[2].alias("item"), F.pandas_udf(found, "string")("body").alias("found"))
    e = F.explode(F.from_json("found", "array<struct<dimension:string,score:double>>")).alias("e")
    return lines.select("rep", "item", e).select("rep", "item", F.col("e.dimension").alias("name"), "e.score")


def layered(*settings: dict) -> dict:
    """Settings of which each layer (shared, corpus, run) overrides those before it, nested ones name by name."""
    out: dict = {}
    for layer in settings:
        for name, value in layer.items():
            both = isinstance(value, dict) and isinstance(out.get(name), dict)
            out[name] = layered(out[name], value) if both else value
    return out


def write_chunked_lines(df: DataFrame, path: str, order: str, max_bytes: int = 150_000_000) -> None:
    """JSON lines in files below ``max_bytes``, rows in ``order``.

    Rows are dealt by range into as many parts as their bytes need, with room to spare; a part above the limit would be
    an error of the estimate and fails the job rather than the upload.
    """
    lines = df.select(order, F.to_json(F.struct(*df.columns)).alias("value"))
    total = lines.agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0
    parts = max(1, -(-2 * total // max_bytes))
    dealt = lines.repartitionByRange(int(parts), order).sortWithinPartitions(order).withColumn("part", F.spark_partition_id())
    over = dealt.groupBy("part").agg(F.sum(F.octet_length("value") + 1).alias("n")).filter(F.col("n") > max_bytes)
    if not over.isEmpty():
        raise ValueError("a part is above the limit: deal rows by a finer order")
    dealt.select("value").write.text(path)


def word_list(spark: SparkSession, path: str, most: int = 10_000) -> tuple[str, ...]:
    """The distinct words of a file with one a line, lower-cased, in order: a stop list for ``word_set_overlap``.

    Blank lines are skipped; a list of more than ``most`` words is an error, as it becomes part of a plan.
    """
    words = spark.read.text(path).select(F.lower(F.trim("value")).alias("w")).filter("w <> ''").distinct().limit(most + 1).collect()
    if len(words) > most:
        raise ValueError(f"{path} has more than {most} words")
    return tuple(sorted(r.w for r in words))


def running_bytes(df: DataFrame, size: str, order: str, by: list[str]) -> DataFrame:
    """Cumulated bytes within ``by``, for request batches of bounded size."""
    return df.withColumn("running", F.sum(size).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """A vector store: ``key, vector`` Parquet, unit length up to rounding."""
    df = spark.read.parquet(path)
    if not isinstance(df.schema["vector"].dataType, T.ArrayType):
        raise ValueError("a column vector of type array is needed")
    return df
