"""Ranked lexical search as a blocked sparse matrix product.

The rows of a sparse matrix A are items (how often an item has each term), the columns of a sparse matrix B are
documents (a term's int64 impact in each document). Scores are A B. Items are dealt in blocks with a bounded number of
entries; documents come in blocks as Spark reads them. For a pair of blocks each item's scores are the merged rows of B
that its terms name (Gustavson), in one dense int64 row per item that numpy adds to, and only the best of each item
leave a block: within a task, then among tasks in two steps.

Rows of B that no item of a block names take no part in the product, so they are not built; document lengths, their
number and the terms' frequencies are those of all documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import dealt_by_weight, leading
from ..sources.shared import keyed, written
from .slices import slices

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A byte table that lower-cases A-Z and blanks what no term holds; bytes of longer characters all belong to terms.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Entries (item, term) of a block of items; a longer item is a block of its own.
BLOCK = 1 << 18


def terms_of(text: Column) -> Column:
    """The terms of a text, repeats kept; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), 0)


def _postings(vocabulary: dict[bytes, int]) -> Callable:
    """Document columns of B: number of terms, and the block's terms with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for b in batches:
            n, sizes, terms, times = [], [0], [], []
            for text in b.column(1):
                total, found = 0, []
                for part in slices((text.as_py() or "").encode("utf-8", "surrogatepass").translate(TABLE)):
                    words = part.split()
                    total += len(words)
                    found.append(np.fromiter(filter(None, map(get, words)), np.int32))
                t, k = np.unique(np.concatenate(found), return_counts=True)
                n.append(total)
                terms.append(t - 1)
                times.append(k)
                sizes.append(sizes[-1] + len(t))
            ends = pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, kind), *x]), kind)) for x, kind in ((terms, "int32"), (times, "int64"))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "times"])

    return run


def best_of(item: np.ndarray, score: np.ndarray, ids: pa.Array, k: int) -> np.ndarray:
    """Places of each item's ``k`` best: highest score, then smallest id (null last)."""
    order = np.lexsort((pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="min").to_numpy(), -score, item))
    grouped = item[order]
    first = np.searchsorted(grouped, grouped)
    return order[np.arange(len(order)) - first < k]


def product(rows: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, n_docs: int, n_terms: int, k: int, names: list[str]) -> Callable:
    """The product of a block of items (``rows``: terms and multiplicities of each) with the documents of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, item, score = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = np.ones(len(rows), np.int64)  # a score that an item's next document must reach
        for b in batches:
            size = b.num_rows
            n, lists = b.column(1).to_numpy(), b.column(2)
            term, tf = lists.flatten().to_numpy(), b.column(3).flatten().to_numpy()
            doc = np.repeat(np.arange(size), np.diff(lists.offsets.to_numpy()))
            m = 75 + 25 * n * n_docs // n_terms
            impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
            order = np.argsort(term, kind="stable")
            doc, impact = doc[order], impact[order]
            at = np.searchsorted(term[order], np.arange(len(weight) + 1))
            found = []
            for i, (columns, times) in enumerate(rows):
                total = np.zeros(size, np.int64)
                for c, x in zip(columns, times, strict=True):
                    a, z = at[c], at[c + 1]
                    if a < z:  # a document occurs once in a row of B, so plain indexing adds up
                        total[doc[a:z]] += x * impact[a:z]
                good = np.flatnonzero(total >= least[i])
                if len(good) > k:
                    good = good[total[good] >= np.partition(total[good], -k)[-k]]
                found.append((np.full(len(good), i), total[good], good))
            new = np.concatenate([g for *_, g in found]) if found else np.zeros(0, np.int64)
            mine = b.column(0).take(pa.array(new, pa.int64()))
            ids = mine if ids is None else pa.concat_arrays([ids, mine])
            item = np.concatenate([item, *[i for i, *_ in found]])
            score = np.concatenate([score, *[s for _, s, _ in found]])
            keep = best_of(item, score, ids, k)
            ids, item, score = ids.take(pa.array(keep, pa.int64())), item[keep], score[keep]
            full = np.flatnonzero(np.bincount(item, minlength=len(rows)) == k)
            least[full] = score[np.searchsorted(item, full, side="right") - 1]
        if ids is not None:
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in item], pa.string()), ids, pa.array(score)], ["item_key", "doc_id", "score"])

    return run


def search(items: DataFrame, docs: DataFrame, k: int = 20, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", doc_text: str = "text", block: int = BLOCK) -> DataFrame:
    """The ``k`` best documents of each item: ``item_id, rank, doc_id, score``.

    Terms are runs of ASCII letters, digits and any other characters from U+0080 on, A-Z lower-cased. With N documents
    that have a term, L terms in all, n terms of a document, df documents with a term and tf occurrences in one, a
    term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))), a document has m = 75 + 25 n N div L, and its score is the
    sum of w (10^9 tf div (1000 tf + 12 m)) over the item's terms, repeats included, in 64-bit integers. Documents
    with score 0 are not listed; equal scores go by id, null ids last.

    Every row of ``items`` is an item of its own, also where ids repeat or are null. Null and empty texts have no
    terms. Repeated documents count and are ranked one by one. Other columns are not read. An empty table on either
    side gives an empty result. A text is split in slices of 4 MB; a document's counts and an item's terms are held at
    once. Each block of items takes one scan of the documents; a block has ``block`` entries at most, or one item.
    """
    spark = docs.sparkSession
    named = keyed(items, "__item").select(F.col("__item").alias("item_key"), F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    entries = named.select("item_key", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("item_key", "term").agg(F.count("*").alias("times"))
    entries = written(entries, "lexical-items")
    blocks = dealt_by_weight(entries.groupBy("item_key").agg(F.count("*").alias("n")), ["item_key"], "n", block, "block")
    blocks = written(blocks.select("item_key", "block"), "lexical-blocks")
    kind = docs.schema[doc_id].dataType.simpleString()
    best = None
    for number in range(1 + (blocks.agg(F.max("block")).first()[0] if blocks.limit(1).count() else -1)):
        # at most ``block`` entries, or those of one item
        mine = entries.join(blocks.filter(F.col("block") == number), "item_key").select("item_key", "term", "times").toPandas().sort_values(["item_key", "term"])
        vocabulary = {t: i for i, t in enumerate(sorted(set(mine["term"])))}
        names, rows = [], []
        for name, g in mine.groupby("item_key", sort=True):
            names.append(name)
            rows.append((np.array([vocabulary[t] for t in g["term"]]), g["times"].to_numpy(np.int64)))
        text = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text"))
        columns = text.mapInArrow(_postings({t.encode(): i + 1 for t, i in vocabulary.items()}), f"doc_id {kind}, n long, terms array<int>, times array<long>")
        columns = written(columns.filter("n > 0"), "lexical-columns")
        n_docs, n_terms = columns.agg(F.count("*"), F.sum("n")).first()
        df = columns.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toPandas()  # one row per term of the block
        weight = np.zeros(len(vocabulary), np.int64)
        weight[df["t"]] = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df["df"].tolist()]
        part = columns.mapInArrow(product(rows, weight, n_docs, n_terms or 1, k, names), f"item_key string, doc_id {kind}, score long")
        best = part if best is None else best.unionByName(part)
    if best is None:
        best = spark.createDataFrame([], f"item_key string, doc_id {kind}, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    top = leading(best, ["item_key"], order, k, "rank", salt="doc_id")
    return top.join(named.select("item_key", "item_id"), "item_key").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark),
a AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(ts) AS term FROM i) GROUP BY ALL),
c AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM a) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
s AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM a JOIN p USING (term) JOIN w USING (term), c GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
