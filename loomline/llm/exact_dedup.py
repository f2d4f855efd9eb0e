"""Exact deduplication by progressive refinement, in DataFrame functions alone.

Rows are grouped by the length of the normalised text, groups of two or more by a hash of its prefix, and what is
left of those by the SHA-256 of the whole. Only rows that share length and prefix hash with another take part in
the last grouping; the others are done after the second. The groupings shuffle numbers and hashes, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.marks import marked, without
from ..operators.skew import hot_safe_join
from ..sources.shared import keyed, written

#: Characters that normalisation deletes: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = True, row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, row_key, n_chars, keep_id, group_size, kept, text_sha256``.

    ``row_key`` is ``row_col``, a name for each row, or made here. Ids are whole numbers above the least 64-bit one.

    Of equal normalised texts the row with the most code points, then the smallest id, is kept; a null id counts as
    the largest. Null text counts as empty, so all blank texts form one group. Of rows that repeat with the same id
    and text all but one are dropped. Other columns of ``docs``, whatever their names, are not read. An empty table
    gives an empty result.

    ``hash_all=False`` leaves ``text_sha256`` null for rows without another row of the same length and prefix, and
    normalises and hashes only the surviving rows' whole texts; True takes the hash during the first scan, for
    results that ask for it in every row.
    """
    norm = normalised(F.col("__text"))
    named = docs if row_col else keyed(docs, row_col := "__row")
    base = named.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"), F.col(row_col).alias("row_key"))
    light = base.select(
        "doc_id",
        F.coalesce(F.length("__text"), F.lit(0)).cast("long").alias("n_chars"),
        F.length(norm).cast("long").alias("norm_len"),
        F.xxhash64(F.substring(norm, 1, PREFIX_CHARS)).alias("prefix_hash"),
        (F.sha2(norm, 256) if hash_all else F.lit(None).cast("string")).alias("sha"),
        "row_key",
    )
    light = written(light, "exact-light")
    total = light.count()

    by_prefix = light.groupBy("norm_len", "prefix_hash").agg(F.count("*").alias("n_prefix"))
    lengths = by_prefix.groupBy("norm_len").agg(F.sum("n_prefix").alias("n_len")).filter("n_len > 1")
    refined = written(by_prefix.filter("n_prefix > 1").join(lengths.select("norm_len"), "norm_len", "left_semi"), "exact-prefix")

    alive = hot_safe_join(light, refined, ["norm_len", "prefix_hash"], "n_prefix", total, "inner")
    if not hash_all:
        sha = written(marked(base, "row_key", alive, "__alive").filter("__alive").select("row_key", F.sha2(norm, 256).alias("sha")), "exact-sha")
        alive = alive.drop("sha").join(sha, "row_key")
        light = light.drop("sha").join(sha, "row_key", "left")
    best = F.struct(F.col("n_chars"), F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("minus_id"), F.col("row_key"))
    groups = alive.groupBy("norm_len", "prefix_hash", "sha").agg(F.count("*").alias("group_size"), F.max(best).alias("best"))
    groups = groups.filter("group_size > 1").withColumn("n_rows", F.col("group_size"))
    groups = written(groups, "exact-groups")
    keys = ["norm_len", "prefix_hash", "sha"]
    out = hot_safe_join(light, groups, keys, "n_rows", total)
    return out.select(
        "doc_id",
        "row_key",
        "n_chars",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(-F.col("best.minus_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best.row_key") == F.col("row_key"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` drops, with all its columns."""
    rows = keyed(docs, "__row")
    gone = exact_groups(rows, id_col, text_col, hash_all=False, row_col="__row").filter("not kept").select(F.col("row_key").alias("__row"))
    return without(rows, "__row", gone).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(length(text), 0) AS cp,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id)
"""
