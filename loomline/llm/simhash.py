"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is cut into two segments of 32. Two fingerprints that differ in at most two bits differ in
at most one bit within one segment, so each fingerprint looks up the Hamming ball of radius one around each of its
segments in a table of segments; complete distances are verified inside the join. Of a pair one bit apart in a
segment, the one with the bit set finds the other by clearing it, so a ball takes 17 lookups on average, not 33.

Equal fingerprints are collapsed first. A segment value shared by more than BIG fingerprints is left out of the
table; its fingerprints look up the whole ball of radius two around themselves instead (2,080 exact lookups), so no
bucket is ever compared all against all and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.marks import without
from ..operators.skew import hot_safe_join
from ..sources.shared import keyed, written

RADIUS = 2
#: Above this many fingerprints in a segment's bucket the full ball (2,080 lookups) is cheaper than the bucket.
BIG = 2048
#: Shingles whose bits are counted at once.
BLOCK = 65_536


def fingerprint(text: str | None, words_per_shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of ``text`` (A-Z lower-cased, words between ASCII blanks), as an unsigned integer.

    A bit is set if it is set in over half of the shingles' XXH64 values, repeats included. A text of fewer words is
    one shingle; without words, or null, the fingerprint is 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    k = words_per_shingle
    if len(words) <= k:
        return h(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    stops = (ends[k - 1 :] - 1).tolist()
    values = np.fromiter((h(line[a:b], seed) for a, b in zip(begins, stops, strict=False)), np.uint64, len(stops))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(values), BLOCK):
        bits = np.unpackbits(values[i : i + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(values), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp.view(np.int64))], ["doc_id", "row_key", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``doc_id, row_key, fp`` with the fingerprint as a signed 64-bit integer, a row per row of ``docs``."""
    named = docs if row_col else keyed(docs, row_col := "__row")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = named.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(row_col).alias("row_key"))
    return rows.mapInArrow(_fingerprints, f"doc_id {kind}, row_key string, fp long")


def links(prints: DataFrame, big: int = BIG) -> DataFrame:
    """Pairs ``src, dst`` of distinct fingerprints (``prints``: distinct ``fp``) at distance RADIUS or less.

    Each pair appears at least once, in either order. ``big`` is the bucket size from which the full ball is used;
    the result's pairs do not depend on it.
    """
    seg = F.explode(F.array(F.struct(F.lit(0).alias("s"), F.shiftrightunsigned("fp", 32).alias("key")), F.struct(F.lit(1).alias("s"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("key")))).alias("e")
    table = written(prints.select("fp", seg).select("fp", "e.s", "e.key"), "simhash-table")
    crowded = written(table.groupBy("s", "key").agg(F.count("*").alias("n")).filter(F.col("n") > big).select("s", "key"), "simhash-crowded")
    some = crowded.limit(1).count() > 0
    rest = table.join(crowded, ["s", "key"], "left_anti") if some else table
    one_less = F.expr("transform(filter(sequence(0, 31), i -> (shiftright(key, i) & 1L) = 1L), i -> key ^ shiftleft(1L, i))")
    probes = table.select("s", F.col("fp").alias("a"), F.explode(F.concat(F.array("key"), one_less)).alias("key"), F.col("key").alias("own"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    met = probes.join(rest.withColumnRenamed("fp", "b"), ["s", "key"])
    found = met.filter(close & (F.col("a") != F.col("b")) & ((F.col("key") != F.col("own")) | (F.col("a") < F.col("b")))).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    if some:
        full = table.join(crowded, ["s", "key"], "left_semi").select("fp").distinct()
        pairs = [1 << i for i in range(64)] + [1 << i | 1 << j for i in range(64) for j in range(i)]
        masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in pairs])
        ball = full.select(F.col("fp").alias("src"), F.explode(masks).alias("mask")).select("src", F.col("src").bitwiseXOR(F.col("mask")).alias("dst"))
        found = found.unionByName(ball.join(prints.select(F.col("fp").alias("dst")), "dst").select("src", "dst"))
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, row_key, fp, component_id, first``.

    ``first`` marks the row of each component with the smallest id, null ids last, one of them where rows repeat.

    ``component_id`` is the smallest id among the documents whose fingerprints can be reached over links of two or
    fewer differing bits. Empty and null texts have fingerprint 0, which links as any other. Null ids are carried but
    never name a component (it is null if no id of the component is known). Repeated rows stay; other columns are
    not read. An empty table gives an empty result.
    """
    prints = written(fingerprints(docs, id_col, text_col, row_col), "simhash-docs")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_key")).alias("best")
    distinct = written(prints.groupBy("fp").agg(best, F.count("*").alias("n")), "simhash-distinct")
    parts = connected_components(links(distinct.select("fp")))
    named = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = written(named, "simhash-parts")
    lowest = named.groupBy("component").agg(F.min("best").alias("best"), F.count("*").alias("n_prints"))
    total = named.agg(F.count("*"), F.sum("n")).first()
    ids = hot_safe_join(named.drop("best"), lowest, ["component"], "n_prints", total[0]).select("fp", "best", "n")
    out = hot_safe_join(prints, written(ids, "simhash-ids"), ["fp"], "n", total[1] or 0)
    return out.select("doc_id", "row_key", "fp", F.col("best.doc_id").alias("component_id"), (F.col("row_key") == F.col("best.row_key")).alias("first"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the ``first`` row of each component, with all its columns."""
    rows = keyed(docs, "__row")
    gone = near_duplicates(rows, id_col, text_col, "__row").filter("not first").select(F.col("row_key").alias("__row"))
    return without(rows, "__row", gone).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
