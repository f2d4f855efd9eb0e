"""Benchmark decontamination with an FM-index per training shard.

A task gathers the documents of its partition into shards of bounded size, indexes each shard and searches all test
phrases in it: backward search through wavelet-tree ranks, then sampled suffix positions. A shard's text keeps the
runs of words that the test phrases use at all and that are long enough for the shortest phrase; no phrase can occur
elsewhere, so nothing is lost and most text is never sorted. No document is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.marks import without
from ..operators.order import dealt_by_weight
from ..sources.shared import keyed, written
from .fm_index import FMIndex

WINDOW = 13
#: A shard ends at so many indexed words or so many words read, whichever comes first.
SHARD_INDEXED, SHARD_READ = 1 << 20, 1 << 22
#: Test texts of up to this many bytes go to the executors at once; more are searched in blocks of this size.
BLOCK_BYTES = 4 << 20
#: Phrases searched together.
SEARCH = 1 << 16

#: ASCII letters lower-cased, digits and all bytes of other characters kept, the rest blank.
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of the contamination rule: runs of ASCII letters (lower-cased), digits and non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


@dataclass
class Phrases:
    """Distinct windows by length, and which items (by number) each window belongs to."""

    vocabulary: dict[bytes, int]
    windows: list[np.ndarray]
    items: list[tuple[np.ndarray, np.ndarray]]  # by length: offsets per window, item numbers
    ids: list
    shortest: int
    #: The number of words that no phrase has; 0, which ends runs, if they are not to be indexed.
    unknown: int = 0


def phrases(rows: list[tuple], window: int = WINDOW, whole: bool = False) -> Phrases:
    """``rows``: (item_id, text). ``whole``: also words that no phrase has are to be indexed. Items with one id are one item; an item of fewer words, but not none, is one window."""
    vocabulary: dict[bytes, int] = {}
    numbers: dict = {}
    found: dict[int, dict[bytes, set[int]]] = defaultdict(lambda: defaultdict(set))
    for item_id, text in rows:
        number = numbers.setdefault(item_id, len(numbers))
        codes = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)], np.int32)
        k = min(window, len(codes))
        for i in range(len(codes) - k + 1 if k else 0):
            found[k][codes[i : i + k].tobytes()].add(number)
    by_length, items = [], []
    for k, table in sorted(found.items()):
        by_length.append(np.frombuffer(b"".join(table), np.int32).reshape(-1, k))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in table.values()])])
        items.append((offsets, np.array([n for x in table.values() for n in sorted(x)], np.int64)))
    unknown = len(vocabulary) + 1 if whole else 0
    return Phrases(vocabulary, by_length, items, list(numbers), 1 if whole else min(found, default=0), unknown)


def search_shard(codes: np.ndarray, n_words: np.ndarray, p: Phrases) -> tuple[list[list[tuple[int, int]]], list[list[int]]]:
    """Merged hit spans (word offsets, end exclusive) and item numbers of each document.

    ``codes``: the documents' words as vocabulary numbers, ``p.unknown`` where unknown, 0 after each document.
    """
    n_docs = len(n_words)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n_docs)]
    items: list[list[int]] = [[] for _ in range(n_docs)]
    inside = np.diff(np.concatenate([[0], (codes != 0).astype(np.int8), [0]]))
    begin, end = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
    long = end - begin >= p.shortest
    begin, end = begin[long], end[long]
    if not len(begin) or not p.windows:
        return spans, items
    width = end - begin + 1  # with the separator, which is the 0 behind each run
    seg_at = np.concatenate([[0], np.cumsum(width)])
    place = np.arange(seg_at[-1]) - np.repeat(seg_at[:-1], width) + np.repeat(begin, width)
    index = FMIndex(codes[place], max(len(p.vocabulary), p.unknown) + 1)
    doc_at = np.concatenate([[0], np.cumsum(n_words + 1)])
    cover = np.zeros(len(place) + 1, np.int32)
    pairs = []
    for patterns, (offsets, numbers) in zip(p.windows, p.items, strict=True):
        k = patterns.shape[1]
        for i in range(0, len(patterns), SEARCH):
            which, lo, hi = index.ranges(patterns[i : i + SEARCH])
            count = hi - lo
            if not len(which):
                continue
            rows = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            at = index.locate(rows)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + k, -1)
            doc = np.searchsorted(doc_at, place[at], side="right") - 1
            seen = np.unique(doc * len(patterns) + np.repeat(which + i, count))
            doc, win = seen // len(patterns), seen % len(patterns)
            n = offsets[win + 1] - offsets[win]
            each = np.repeat(offsets[win] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            pairs.append(np.unique(np.repeat(doc, n) * len(p.ids) + numbers[each]))
    hit = np.zeros(len(codes) + 1, np.int8)
    hit[place[np.cumsum(cover[:-1]) > 0]] = 1
    edge = np.diff(np.concatenate([[0], hit]))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    for a, b, d in zip(starts.tolist(), stops.tolist(), (np.searchsorted(doc_at, starts, side="right") - 1).tolist(), strict=True):
        spans[d].append((a - int(doc_at[d]), b - int(doc_at[d])))
    for x in np.unique(np.concatenate(pairs)).tolist() if pairs else ():
        items[x // len(p.ids)].append(x % len(p.ids))
    return spans, items


def _search(shared, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Phrases = shared.value
        get = p.vocabulary.get
        zero = np.zeros(1, np.int32)
        held: list[pa.Array] = []
        parts: list[np.ndarray] = []
        n_words: list[int] = []
        kept = read = 0

        def flush() -> pa.RecordBatch:
            spans, items = search_shard(np.concatenate(parts), np.array(n_words, np.int64), p)
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            out = [
                *batch.columns,
                pa.array(n_words, pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(items, pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(out, [*columns, "n_words", "spans", "items"])

        for batch in batches:
            at = 0
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                found = words(text.as_py())
                codes = np.fromiter((get(w, p.unknown) for w in found), np.int32, len(found))
                parts += [codes, zero]
                n_words.append(len(codes))
                kept += int((codes != 0).sum())
                read += len(codes)
                if kept >= SHARD_INDEXED or read >= SHARD_READ:
                    held.append(batch.slice(at, i + 1 - at).select(list(range(batch.num_columns - 1))))
                    at = i + 1
                    yield flush()
                    held, parts, n_words, kept, read = [], [], [], 0, 0
            if at < batch.num_rows:
                held.append(batch.slice(at).select(list(range(batch.num_columns - 1))))
        if n_words:
            yield flush()

    return run


def _scan(docs: DataFrame, columns: list[str], rows: list[tuple], window: int, whole: bool) -> tuple[DataFrame, list]:
    spark = docs.sparkSession
    p = phrases(rows, window, whole)
    ids, p.ids = p.ids, list(range(len(p.ids)))
    shared = spark.sparkContext.broadcast(p)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    out = docs.select(*columns, "__text").mapInArrow(_search(shared, columns), f"{kinds}, n_words long, spans array<struct<start:long,end:long>>, items array<long>")
    return out, ids


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, whole: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, spans, item_ids, n_items``.

    ``spans`` are the merged word ranges covered by occurrences of windows of the test texts, ``n_hit`` the words in
    them, ``item_ids`` the items whose windows occur, as strings in order. Null texts have no words; items without
    words have no window; items that share an id, or have none, are one item, and a null id is not listed. Repeated
    documents are judged one by one; an empty table on either side gives no hits. Other columns are not read.

    A shard's index holds the runs of words that the test phrases use, where alone they can occur; ``whole`` indexes all
    words, for the same result at more cost. A text is never cut, so a shard is as large as its longest text at least.

    Test texts above ``block_bytes`` are searched block by block against all documents and the spans merged.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    tests = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    size = tests.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0)))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    if n_blocks == 1:
        out, ids = _scan(base, ["doc_id"], [tuple(r) for r in tests.collect()], window, whole)
        out = _named(spark, out, ids, ["doc_id", "n_words", "spans"])
    else:
        base = written(base.withColumn("row_key", F.uuid()), "decontam-docs")
        # rows, not ids, are dealt: an id in several blocks, or none at all, is joined again below
        cut = tests.withColumn("n", F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("item"), F.lit(0)))
        cut = written(dealt_by_weight(cut, ["item", "text"], "n", block_bytes, "block"), "decontam-tests")
        merged = None
        for b in range(cut.agg(F.max("block")).first()[0] + 1):
            mine = [tuple(r) for r in cut.filter(F.col("block") == b).select("item", "text").collect()]
            if not mine:  # a text longer than a block takes the numbers of several
                continue
            out, ids = _scan(base, ["row_key", "doc_id"], mine, window, whole)
            out = _named(spark, out, ids, ["row_key", "doc_id", "n_words", "spans"])
            merged = out if merged is None else merged.unionByName(out)
        merged = merged.groupBy("row_key").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.bool_or(F.col("n_items") > F.size("item_ids")).alias("nameless"))
        merged = merged.withColumn("n_items", (F.size("item_ids") + F.col("nameless").cast("int")).cast("long"))
        join = """aggregate(spans, cast(array() as array<struct<start:bigint,end:bigint>>), (acc, x) ->
            if(size(acc) > 0 and element_at(acc, -1).end >= x.start,
               concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end)))),
               concat(acc, array(x))))"""
        out = merged.withColumn("spans", F.expr(join))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "item_ids", "n_items")


def _named(spark: SparkSession, out: DataFrame, ids: list, columns: list[str]) -> DataFrame:
    """Item numbers by their ids; the ids are part of a block of bounded size."""
    shared = spark.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        for b in batches:
            items = b.column("items").to_pylist()
            lists = [sorted((names[i] for i in x if names[i] is not None), key=lambda s: s.encode()) for x in items]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(lists, pa.list_(pa.string())), pa.array([len(x) for x in items], pa.int64())], [*columns, "item_ids", "n_items"])

    kinds = ", ".join(f"`{c}` {out.schema[c].dataType.simpleString()}" for c in columns)
    return out.mapInArrow(run, f"{kinds}, item_ids array<string>, n_items long")


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without contaminated rows, with all its columns."""
    rows = keyed(docs, "__row")
    gone = contamination(rows, benchmark, "__row", text_col, block_bytes=block_bytes).filter(contaminated()).select(F.col("doc_id").alias("__row"))
    return without(rows, "__row", gone).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS k
  FROM (SELECT item_id, w, least(len(w), 13) AS l, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
lens AS (SELECT DISTINCT l FROM wins),
pos AS (
  SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS k
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, lens WHERE len(w) >= l)),
hits AS (SELECT p.doc_id, p.i, p.l, v.item_id FROM pos p JOIN wins v ON p.k = v.k AND p.l = v.l),
hit_words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS j FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
