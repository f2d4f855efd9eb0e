"""Phrase collocations: counts of all phrases of up to ``max_words`` words, scored by their weakest cut.

Phrases become rows (language, phrase, count) that Spark adds up by hash aggregation, one length after the other. A
phrase that occurs ``least`` times has parts that do too, so a phrase is only made a row where both of its parts of one
word less may be frequent: a bitmap of the frequent ones' hashes tells, whose false alarms cost rows and change nothing.
The rest is joins: counts of both sides of every cut, a decimal score, an anti-join with extensions by one word, and
ranks in windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import leading
from ..sources.shared import written
from .slices import slices

#: A byte table: A-Z lower-cased; what ends a piece becomes 0xFF, which UTF-8 never holds; a tab becomes a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else 255 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
#: Bits of the bitmap for each frequent phrase, and its largest size (32 MB).
BITS_EACH, MOST_BITS = 16, 1 << 28
#: Rows of a batch that a task gives back, and bytes of texts that it puts in one run.
MOST_ROWS, MOST_BYTES = 1 << 15, 7 << 19
#: Words that a task numbers before it starts anew.
MOST_NUMBERED = 1 << 18
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


class Numbers(dict):
    """Numbers of words in the order they are met (0 ends a piece), with the words and their hashes."""

    def __init__(self):
        super().__init__({b"\xff": 0})
        self.words, self.hashes = [b"\xff"], np.zeros(1, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n

    def hashed(self) -> np.ndarray:
        """The hash of every word numbered so far."""
        new = self.words[len(self.hashes) :]
        if new:
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))])
        return self.hashes


def mixed(lang: str, hashes: list[np.ndarray], bits: int) -> np.ndarray:
    """Places of phrases in a bitmap of ``bits`` (a power of two) bits, from the hashes of their words."""
    total = np.full(len(hashes[0]), xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 1), np.uint64)
    for h, odd in zip(hashes, MIX * (1 + len(hashes) // len(MIX)), strict=False):
        total = (total ^ h) * np.uint64(odd)
        total ^= total >> np.uint64(29)
    return (total & np.uint64(bits - 1)).astype(np.int64)


def _counted(lang: str, ids: np.ndarray, numbers: Numbers, n: int, bits: int, bitmap: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases of ``n`` words in a run of numbered words (where each is first), and how often each occurs."""
    starts = np.flatnonzero(ids[: len(ids) - n + 1] > 0) if len(ids) >= n else np.zeros(0, np.int64)
    for k in range(1, n):
        starts = starts[ids[starts + k] > 0]
    if n > 1 and bitmap is not None:
        h = numbers.hashed()
        for k in (0, 1):  # both parts of one word less
            at = mixed(lang, [h[ids[starts + k + j]] for j in range(n - 1)], bits)
            starts = starts[bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0]
    if not len(starts):
        return starts, np.zeros(0, np.int64)
    key = ids[starts].astype(np.int64)
    for k in range(1, n):  # pairs of numbers become numbers again, so keys stay exact
        if k > 1:
            _, key = np.unique(key, return_inverse=True)
        key = key * len(numbers.words) + ids[starts + k]
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return starts[first], count


def _runs(texts: Iterator[bytes]) -> Iterator[bytes]:
    """Texts one a line, in runs of about MOST_BYTES."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= MOST_BYTES:
            yield b"\n".join(run)
            run, size = [], 0
    if run:
        yield b"\n".join(run)


def _phrases(n: int, bits: int, bitmap) -> Callable:
    """Rows ``lang, phrase, a`` of a task: its phrases of ``n`` words, added up slice by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, table = Numbers(), None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)

        def rows(lang: str, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts, count = _counted(lang, ids, numbers, n, bits, table)
            words = numbers.words
            for i in range(0, len(starts), MOST_ROWS):  # the phrases themselves only a batch at a time
                phrases = [b" ".join([words[w] for w in row]) for row in ids[starts[i : i + MOST_ROWS, None] + np.arange(n)].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(count[i : i + MOST_ROWS])], ["lang", "phrase", "a"])

        for b in batches:
            of: dict[str, list[int]] = {}
            for i, lang in enumerate(b.column(0)):
                of.setdefault(lang.as_py(), []).append(i)
            for lang, own in of.items():
                texts = ((b.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass") for i in own)
                for part in (part for run in _runs(texts) for part in (None, *slices(run.translate(TABLE).replace(b"\xff", b" \xff ")))):
                    if part is None:  # a new text begins
                        carry = np.zeros(0, np.int64)
                        continue
                    words = part.split()
                    ids = np.concatenate([carry, np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))])
                    yield from rows(lang, ids)
                    carry = ids[max(0, len(ids) - n + 1) :]  # the next slice's phrases may begin here
                    if len(numbers.words) > MOST_NUMBERED:
                        kept, numbers = [numbers.words[i] for i in carry.tolist()], Numbers()
                        carry = np.fromiter(map(numbers.__getitem__, kept), np.int64, len(kept))

    return run


def _places(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [mixed(lang.as_py(), [np.array([xxhash.xxh64_intdigest(w)], np.uint64) for w in p.as_py().encode("utf-8", "surrogatepass").split(b" ")], bits)[0] for lang, p in zip(b.column(0), b.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64())], ["at"])

    return run


def _bitmap(frequent: DataFrame) -> tuple[int, object]:
    """A bitmap of the hashes of ``frequent`` (``lang, phrase``), of a size bounded by MOST_BITS, for all tasks."""
    spark, n = frequent.sparkSession, frequent.count()
    bits = 1 << max(16, min(MOST_BITS, BITS_EACH * n).bit_length())
    bits = min(bits, MOST_BITS)
    at = frequent.select("lang", "phrase").mapInArrow(_places(bits), "at long").select((F.col("at") + 1).alias("at"))
    blocks = at.groupBy(F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(-(-bits // 32768) * 4096, np.uint8)
    for r in blocks.toLocalIterator():
        part = np.frombuffer(r.bits, np.uint8)
        out[(r.block - 1) * 4096 : (r.block - 1) * 4096 + len(part)] = part
    return bits, spark.sparkContext.broadcast(out.tobytes())


def counts(docs: DataFrame, max_words: int, least: int, lang_col: str, text_col: str, prune: bool) -> tuple[DataFrame, DataFrame]:
    """``lang, words, phrase, a`` of all phrases that occur ``least`` times or more; ``lang, n`` with all words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    out, bits, bitmap = [], 0, None
    for n in range(1, max_words + 1):
        found = rows.mapInArrow(_phrases(n, bits, bitmap), "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
        if n == 1:
            found = written(found, "phrases-1")
            words = written(found.groupBy("lang").agg(F.sum("a").alias("n")), "phrases-words")
        frequent = written(found.filter(F.col("a") >= least).select("lang", F.lit(n).alias("words"), "phrase", "a"), f"phrases-{n}-frequent")
        out.append(frequent)
        if prune and n < max_words:
            if bitmap is not None:
                bitmap.unpersist()
            bits, bitmap = _bitmap(frequent)
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole, words


def collocations(docs: DataFrame, max_words: int = 4, least: int = 30, keep: int = 2000, share: int = 80, scale: int = 2_000_000, lang_col: str = "lang", text_col: str = "text", prune: bool = True) -> DataFrame:
    """Each language's first ``keep`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    Texts (null: empty) are lower-cased in A-Z and split at ``.,;:!?`` and U+000A to U+000D into pieces, and these at
    spaces and tabs into words. A candidate is a phrase of 2 to ``max_words`` words that occurs ``least`` times within
    pieces of its language (null: ``und``), overlaps included. Cut after its first k words, l and r are the counts of
    both sides, and the cut scores floor(scale a / (l + r)); the lowest cut counts, the smallest k of several. A
    candidate is dropped if it lies in a longer one with 100 times its count at least ``share`` times its own; a longer
    one that does so has one with a single word more that does so too. Ranks go by score, then a, both descending, then
    by the phrase's bytes. Repeated rows count as often as they come; other columns are not read; an empty table gives
    an empty result. Texts are split in slices of 4 MB. ``prune=False`` makes rows of all phrases, with the same result.
    """
    found, words = counts(docs, max_words, least, lang_col, text_col, prune)
    candidates = found.filter("words > 1")
    parts = candidates.withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    parts = parts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
    side = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    cuts = parts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    exact = F.expr(f"(cast(a as decimal(20, 0)) * cast({scale} as decimal(10, 0))) div (cast(l as decimal(20, 0)) + r)").cast("long")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    longer = found.filter("words > 2").withColumn("w", F.split("phrase", " "))
    inner = F.explode(F.array(F.slice("w", F.lit(1), F.col("words") - 1), F.slice("w", F.lit(2), F.col("words") - 1))).alias("inner")
    longer = longer.select("lang", "a", inner).groupBy("lang", F.array_join("inner", " ").alias("phrase")).agg(F.max("a").alias("around"))
    is_part = (scored.lang == longer.lang) & (scored.phrase == longer.phrase) & (F.lit(100).cast("decimal(10,0)") * longer.around >= F.lit(share).cast("decimal(10,0)") * scored.a)
    alone = scored.join(longer, is_part, "left_anti")
    top = leading(alone, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], keep, "rank", salt="phrase")
    return top.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (
  SELECT lang, words, array_to_string(list_slice(ws, i, i + words - 1), ' ') AS phrase
  FROM (SELECT lang, ws, words, unnest(range(1, len(ws) - words + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) t(words))),
f AS (SELECT lang, words, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, words, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE words > 1 AND a >= 30),
k AS (
  SELECT lang, phrase, a, k, array_to_string(list_slice(ws, 1, k), ' ') AS head, array_to_string(list_slice(ws, k + 1, words), ' ') AS rest
  FROM (SELECT *, unnest(range(1, words)) AS k FROM c)),
s AS (
  SELECT k.lang, k.phrase, k.a, k.k, x.a AS l, y.a AS r, ((2000000::HUGEINT * k.a) // (x.a + y.a))::BIGINT AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.head JOIN f y ON y.lang = k.lang AND y.phrase = k.rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (
  SELECT lang, unnest([array_to_string(list_slice(ws, i, i + m - 1), ' ') FOR i IN range(1, words - m + 2)]) AS phrase, a
  FROM (SELECT *, unnest(range(2, words)) AS m FROM c)),
d AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = b.lang AND o.phrase = b.phrase AND 100::HUGEINT * o.a >= 80::HUGEINT * b.a))
SELECT d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n, score
FROM d JOIN n ON n.lang = d.lang QUALIFY rank <= 2000
"""
