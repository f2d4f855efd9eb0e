"""Substring dedup: paragraphs that repeat, exactly or nearly, by MinHash banding.

Paragraphs are of two kinds. Lines are what the text itself sets apart. Blocks are windows of PASSAGE words of the whole
text, as one stream, that start where the content says so; they find passages inside longer lines or broken elsewhere.
Both go the same way: band keys tuned for recall are shuffled with the paragraph's name (a 64-bit hash of its words,
so equal paragraphs are one), paragraphs that share a key are verified by the exact Jaccard similarity of their word
shingles, links become components, and of each component the first paragraph stays. Blocks of one component that follow
each other are joined to runs.

No text is shuffled: the first pass over the texts gives keys, the second the places and shingles of paragraphs whose
names a bitmap of fixed size does not rule out. No bucket is joined with itself: buckets of up to CROWDED paragraphs
are compared in one place, larger ones first with one of their members, and what this leaves apart block by block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.components import connected_components
from ..operators.skew import hot_safe_join
from ..sources.shared import keyed, written

SIMILARITY, SHINGLE = 0.8, 5
#: Chance that a pair at SIMILARITY collides. A near copy of a passage shares several blocks, of which one must meet.
LINE_RECALL, BLOCK_RECALL = 0.995, 0.9
#: Pairs at half of SIMILARITY may collide with this chance; it costs comparisons, not results.
LOOSE = 0.45
#: Words of a block, and starts among which the least hash is one: a run of PASSAGE + STARTS - 1 = 51 words holds a block.
PASSAGE, STARTS = 24, 28
#: Buckets of more paragraphs are not compared at once, and of a larger one so many on each side.
CROWDED, BLOCK = 400, 400
#: Up to so many names that are linked to others (16 MB) are broadcast.
FEW_PARTS = 1_000_000
#: The filters of names have 2 ** FILTER_BITS bits (32 MB) at most.
FILTER_BITS = 28
#: Texts are worked on together up to so many bytes; a longer text alone, cut between words for hashing.
GROUP, SLICE = 1 << 17, 1 << 20
#: A task remembers so many names to emit repeated ones twice only.
REMEMBERED = 1 << 20

LINE, RUN = 0, 1
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_P, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_TOP = np.uint64((1 << 64) - 1)
_POWERS: dict[int, np.ndarray] = {}


def bands_of(similarity: float, recall: float, loose: float = LOOSE) -> tuple[int, int]:
    """Bands and rows per band: pairs at ``similarity`` collide with chance ``recall``, at half of it at most ``loose``."""
    rows = 1
    while True:
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if 1 - (1 - (similarity / 2) ** rows) ** bands <= loose:
            return bands, rows
        rows += 1


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2 ** 64 for i below ``n`` at least."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = _POWERS[base] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(1 << 18, n) - 1, base, np.uint64)]), dtype=np.uint64)
    return have


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * _MIX
    return x ^ x >> np.uint64(29)


def spans_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of spans from the running sums of values times powers of ``base``; equal spans are equal wherever they lie."""
    raw = (sums[end] - sums[begin]) * powers(inverse(base), int(begin.max()) + 1 if len(begin) else 1)[begin]
    return mixed(raw + (end - begin).astype(np.uint64) * _MIX)


def running(values: np.ndarray, base: int) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[: len(values)], out=sums[1:])
    return sums


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word between ASCII blanks (A-Z lower-cased) and the byte it starts at."""
    if len(buf) > SLICE:
        cut = np.flatnonzero(_BLANK[buf[SLICE:]])
        if len(cut):
            at = SLICE + int(cut[0])
            parts, offset = [], 0
            while offset < len(buf):
                parts.append((offset, word_hashes(buf[offset:at])))
                offset = at
                cut = np.flatnonzero(_BLANK[buf[at + SLICE :][: 4 * SLICE]])
                at = at + SLICE + int(cut[0]) if len(cut) else len(buf)
            return np.concatenate([h for _, (h, _) in parts]), np.concatenate([s + o for o, (_, s) in parts])
    blank = _BLANK[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    return spans_hash(running(_VALUE[buf], _P), begin, end, _P), begin


def slide_min(x: np.ndarray, k: int) -> np.ndarray:
    """The least of every ``k`` neighbours."""
    span = 1
    while span * 2 <= k:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (k - span)], x[k - span :]) if span < k else x


def coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64)


class MinHash:
    """Band keys of sets of shingles."""

    def __init__(self, similarity: float, recall: float, seed: int):
        self.bands, self.rows = bands_of(similarity, recall)
        self.a, self.b = coefficients(self.bands * self.rows, seed)
        self.seed = seed

    def keys(self, least: Callable[[np.uint64, np.uint64], np.ndarray]) -> np.ndarray:
        """A row of keys per set; ``least(a, b)`` gives each set's minimum of ``a * shingle + b``."""
        out = []
        for band in range(self.bands):
            key = np.uint64(self.seed * 1_000_003 + band)
            for i in range(band * self.rows, (band + 1) * self.rows):
                key = mixed((key ^ least(self.a[i], self.b[i])) * np.uint64(_P))
            out.append(key)
        return np.stack(out, axis=1).view(np.int64)


@dataclass
class Stream:
    """Words of several texts in a row, with their lines and blocks."""

    shingle: np.ndarray  # of the SHINGLE words from each word on; of no use where these cross a line or text
    first: np.ndarray  # the first word of each text
    doc: np.ndarray  # by word
    line: np.ndarray  # by word, counted over all texts
    line_zero: np.ndarray  # by text: the count at its first line
    begin: np.ndarray  # lines: first word
    end: np.ndarray
    line_name: np.ndarray
    at: np.ndarray  # blocks: first word
    block_name: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Stream:
        buf = np.frombuffer(b"\n".join(texts), np.uint8)
        h, start = word_hashes(buf)
        bytes_at = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
        doc = np.searchsorted(bytes_at, start, side="right") - 1
        breaks = np.concatenate([[0], np.cumsum(buf == 10, dtype=np.int32)])
        line = breaks[start]
        n = len(h)
        begin = np.flatnonzero(np.diff(line, prepend=-1))
        end = np.append(begin[1:], n)
        sums = running(h, _Q)
        shingle = spans_hash(sums, np.arange(max(0, n - SHINGLE + 1)), np.arange(SHINGLE, n + 1) if n >= SHINGLE else np.zeros(0, np.int64), _Q)
        at = block_starts(shingle, doc)
        line_name = spans_hash(sums, begin, end, _Q)
        block_name = mixed(spans_hash(sums, at, at + PASSAGE, _Q) + np.uint64(RUN))
        return cls(shingle, np.searchsorted(doc, np.arange(len(texts))), doc, line, breaks[bytes_at], begin, end, line_name, at, block_name)

    def line_keys(self, mh: MinHash) -> tuple[np.ndarray, np.ndarray]:
        """Which lines have SHINGLE words or more, and their keys."""
        which = np.flatnonzero(self.end - self.begin >= SHINGLE)
        if not len(which):
            return which, np.zeros((0, mh.bands), np.int64)
        sets = self.shingle[self.line[: len(self.shingle)] == self.line[SHINGLE - 1 :]]
        size = self.end[which] - self.begin[which] - (SHINGLE - 1)
        offset = np.concatenate([[0], np.cumsum(size)[:-1]])
        return which, mh.keys(lambda a, b: np.minimum.reduceat(sets * a + b, offset))

    def block_keys(self, mh: MinHash) -> tuple[np.ndarray, np.ndarray]:
        """Keys of blocks, and which of them say anything new: a block overlaps the one before, and shares keys with it."""
        if not len(self.at):
            return np.zeros((0, mh.bands), np.int64), np.zeros((0, mh.bands), bool)
        keys = mh.keys(lambda a, b: slide_min(self.shingle * a + b, PASSAGE - SHINGLE + 1)[self.at])
        new = np.ones(keys.shape, bool)
        apart = (np.diff(self.at) >= PASSAGE) | (np.diff(self.doc[self.at]) != 0)
        new[1:] = apart[:, None] | (keys[1:] != keys[:-1])
        return keys, new

    def line_set(self, i: int) -> np.ndarray:
        return np.unique(self.shingle[self.begin[i] : self.end[i] - (SHINGLE - 1)])

    def block_set(self, i: int) -> np.ndarray:
        return np.unique(self.shingle[self.at[i] : self.at[i] + PASSAGE - (SHINGLE - 1)])


def block_starts(shingle: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """First words of blocks: of any STARTS places in a row where a block fits, the first with the least shingle is one.

    The choice looks at the words of a run only, so equal runs of PASSAGE + STARTS - 1 words or more share a block. A
    text with fewer places has the least of them.
    """
    n = len(doc) - PASSAGE + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    fits = doc[:n] == doc[PASSAGE - 1 :]
    bits = max(1, int(n).bit_length())
    mask = np.uint64((1 << bits) - 1)
    packed = np.where(fits, shingle[:n] & ~mask | np.arange(n, dtype=np.uint64), _TOP)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], fits, [False]]).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    found = []
    if n >= STARTS:
        whole = fits[: n - STARTS + 1] & fits[STARTS - 1 :] & (doc[: n - STARTS + 1] == doc[STARTS - 1 : n])
        found.append(slide_min(packed, STARTS)[whole])
    few = end - begin < STARTS
    if few.any():
        pairs = np.stack([begin[few], np.minimum(end[few], n - 1)], axis=1).reshape(-1)
        found.append(np.minimum.reduceat(packed, pairs)[::2] if end[few][-1] < n else np.array([packed[a:b].min() for a, b in zip(begin[few], end[few], strict=True)], np.uint64))
    return np.unique(np.concatenate(found) & mask).astype(np.int64) if found else np.zeros(0, np.int64)


def streams(column: pa.Array) -> Iterator[tuple[int, Stream]]:
    """Texts of a column in groups: the number of the first, and their words."""
    texts, first, size = [], 0, 0
    for i, t in enumerate(column.cast(pa.binary())):
        t = t.as_py() or b""
        if texts and size + len(t) > GROUP:
            yield first, Stream.of(texts)
            texts, first, size = [], i, 0
        texts.append(t)
        size += len(t) + 1
    if texts:
        yield first, Stream.of(texts)


def _keys(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``key, name``: a paragraph's name as its own key and its band keys the first time a task meets it, its name again
        the second time."""
        by_line, by_block = MinHash(similarity, LINE_RECALL, 1), MinHash(similarity, BLOCK_RECALL, 2)
        once: set[int] = set()
        twice: set[int] = set()

        def fresh(names: list[int]) -> tuple[list[int], list[int]]:
            first, second = [], []
            for i, x in enumerate(names):
                if x not in once:
                    once.add(x)
                    first.append(i)
                elif x not in twice:
                    twice.add(x)
                    second.append(i)
            return first, second

        for batch in batches:
            key, name = [], []
            for _, s in streams(batch.column(0)):
                which, keys = s.line_keys(by_line)
                short = np.setdiff1d(np.arange(len(s.begin)), which)
                none = np.zeros((len(short), 0), np.int64)
                for names, k, new in ((s.line_name[which], keys, np.ones(keys.shape, bool)), (s.block_name, *s.block_keys(by_block)), (s.line_name[short], none, none.astype(bool))):
                    names = names.view(np.int64)
                    first, second = fresh(names.tolist())
                    new = new[first]
                    key += [names[first], names[second], k[first][new]]
                    name += [names[first], names[second], np.repeat(names[first], new.sum(axis=1))]
                if len(once) > REMEMBERED:
                    once, twice = set(), set()
            if key:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key)), pa.array(np.concatenate(name))], ["key", "name"])

    return run


def name_filter(names: DataFrame) -> np.ndarray:
    """A bitmap of the first bits of ``names`` (column ``name``, random numbers), of a size that grows to a fixed one."""
    n = names.count()
    bits = min(FILTER_BITS, max(15, (16 * n).bit_length()))
    at = F.shiftrightunsigned("name", 64 - bits) + 1
    found = names.select(F.bitmap_bucket_number(at).alias("block"), F.bitmap_bit_position(at).alias("bit"))
    found = found.repartition("block").groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in found.toLocalIterator():
        out[(r.block - 1) * 4096 : r.block * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def passes(names: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = names >> np.uint64(64 - (len(bitmap) * 8).bit_length() + 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _places(filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places of paragraphs that pass the first filter, and once a task the shingles of those that pass the second."""
        every, near = filters.value
        told: set[int] = set()
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            sets, of = [], []
            for first, s in streams(batch.column(3)):
                lines, blocks = np.flatnonzero(passes(s.line_name, every)), np.flatnonzero(passes(s.block_name, every))
                for kind, at, size, name in ((LINE, s.begin[lines], (s.end - s.begin)[lines], s.line_name[lines]), (RUN, s.at[blocks], np.full(len(blocks), PASSAGE), s.block_name[blocks])):
                    doc = s.doc[at]
                    new = (doc + first, np.full(len(at), kind, np.int8), s.line[at] - s.line_zero[doc], at - s.first[doc], size, name.view(np.int64))
                    for c, x in zip(cols, new, strict=True):
                        c.append(x)
                for names, one in ((s.line_name, s.line_set), (s.block_name, s.block_set)):
                    for i in np.flatnonzero(passes(names, near)).tolist():
                        x = int(names[i])
                        if x not in told and (one == s.block_set or s.end[i] - s.begin[i] >= SHINGLE):
                            told.add(x)
                            of.append(x)
                            sets.append(one(i).view(np.int64))
                if len(told) > REMEMBERED:
                    told = set()
            doc, kind, line, at, size, name = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)
            take = pa.array(doc, pa.int64())
            none = lambda k, t: pa.nulls(k, t)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in range(3)], pa.array(kind, pa.int8()), pa.array(line, pa.int32()), pa.array(at, pa.int32()), pa.array(size, pa.int32()), pa.array(name, pa.int64()), none(len(doc), pa.list_(pa.int64()))], PLACE)
            if of:
                k, flat = len(of), pa.array(np.concatenate(sets))
                sets = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*[none(k, batch.column(c).type) for c in range(3)], none(k, pa.int8()), none(k, pa.int32()), none(k, pa.int32()), none(k, pa.int32()), pa.array(np.array(of, np.uint64).view(np.int64)), sets], PLACE)

    return run


PLACE = ["doc_id", "row", "row_key", "kind", "line", "at", "n_words", "name", "shingles"]


def forest(names: list[int], sets: list[np.ndarray], first: int, similarity: float) -> list[tuple[int, int]]:
    """Edges that join what the links among the first ``first`` members and from them to the others join.

    Each edge leads to the least member of its tree, so that buckets that share members give the same edges.
    """
    if len(names) == 2:
        common = len(set(sets[0].tolist()).intersection(sets[1].tolist()))
        return [(names[0], names[1])] if first and common >= similarity * (len(sets[0]) + len(sets[1]) - common) - 1e-9 else []
    parent = list(range(len(names)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    values, inv = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    by_value = owner[np.argsort(inv, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(inv, minlength=len(values)))])
    sizes = np.array([len(s) for s in sets])
    place = np.concatenate([[0], np.cumsum(sizes)])
    for i in range(first):
        mine = inv[place[i] : place[i + 1]]
        common = np.bincount(np.concatenate([by_value[starts[v] : starts[v + 1]] for v in mine]), minlength=len(sets))
        for j in np.flatnonzero(common >= similarity * (sizes + sizes[i] - common) - 1e-9).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b, key=names.__getitem__)] = min(a, b, key=names.__getitem__)
    return [(names[r], names[i]) for i in range(len(names)) if (r := root(i)) != i]


def _forests(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows ``key, lo, hi, own, name, shingles`` sorted by the first three: links of each group, own members first."""
        group, names, sets, own = None, [], [], []

        def links() -> list[tuple[int, int]]:
            order = sorted(range(len(names)), key=lambda i: -own[i])
            return forest([names[i] for i in order], [sets[i] for i in order], sum(own), similarity) if len(names) > 1 else []

        for batch in batches:
            out = []
            key, lo, hi, mine, name = (batch.column(i).to_pylist() for i in range(5))
            lists = batch.column(5)
            flat, offset = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i in range(batch.num_rows):
                if (key[i], lo[i], hi[i]) != group:
                    out += links()
                    group, names, sets, own = (key[i], lo[i], hi[i]), [], [], []
                names.append(name[i])
                own.append(mine[i])
                sets.append(flat[offset[i] : offset[i + 1]])
            yield _pairs(out)
        yield _pairs(links())

    return run


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["src", "dst"])


def grouped_links(rows: DataFrame, similarity: float) -> DataFrame:
    """Links within groups of bounded size; ``rows``: ``key, lo, hi, own, name, shingles``."""
    dealt = rows.select("key", "lo", "hi", "own", "name", "shingles").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return dealt.mapInArrow(_forests(similarity), "src long, dst long")


def similar(near: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, crowded: int = CROWDED) -> DataFrame:
    """Links ``src, dst``: a path of links joins any two names that share a key and are similar.

    ``near``: ``key, name, n`` (paragraphs of the key); ``sets``: ``name, shingles``. Buckets above ``crowded`` are
    compared with their least name first, in one row per member. Members that this and all smaller buckets leave
    outside their bucket's largest component are then compared with the bucket's other members, block by block.
    """
    full = near.join(sets, "name")
    small = full.filter(F.col("n") <= crowded).withColumns({"lo": F.lit(0), "hi": F.lit(0), "own": F.lit(1)})
    links = written(grouped_links(small, similarity), "para-links")
    big = near.filter(F.col("n") > crowded)
    if not big.limit(1).count():
        return links
    big = written(big.join(sets, "name"), "para-crowded")
    total = big.count()
    pivot = big.groupBy("key").agg(F.min_by("shingles", "name").alias("p_shingles"), F.min("name").alias("p_name"), F.max("n").alias("n_rows"))
    met = hot_safe_join(big, written(pivot, "para-pivots"), ["key"], "n_rows", total, "inner")
    common = F.size(F.array_intersect("shingles", "p_shingles"))
    star = met.filter((F.col("name") != F.col("p_name")) & (common >= similarity * (F.size("shingles") + F.size("p_shingles") - common) - 1e-9))
    links = written(links.unionByName(star.select(F.col("p_name").alias("src"), F.col("name").alias("dst"))), "para-stars")
    parts = connected_components(links).withColumnRenamed("node", "name")
    big = written(big.join(parts, "name", "left").withColumn("part", F.coalesce("component", "name")).drop("component"), "para-parts")
    by_part = big.groupBy("key", "part").agg(F.count("*").alias("m"))
    most = by_part.groupBy("key").agg(F.max(F.struct("m", "part")).alias("top"), F.sum("m").alias("n_rows"))
    most = written(most.filter("n_rows > top.m").select("key", F.col("top.part").alias("top"), (F.col("n_rows") - F.col("top.m")).alias("left"), "n_rows"), "para-left")
    if not most.limit(1).count():
        return links
    # both sides are dealt to blocks: those outside the largest part to `lo`, all members to `hi`
    met = hot_safe_join(big.drop("n"), most.withColumn("n", F.col("n_rows")), ["key"], "n_rows", total, "inner")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    deal = lambda c: F.pmod(F.xxhash64("name"), blocks(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    outside = met.filter("part <> top").select("key", deal("left").alias("lo"), every("n").alias("hi"), F.lit(1).alias("own"), "name", "shingles")
    others = met.select("key", every("left").alias("lo"), deal("n").alias("hi"), F.lit(0).alias("own"), "name", "shingles")
    return links.unionByName(grouped_links(outside.unionByName(others), similarity))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, crowded: int = CROWDED, with_rows: bool = True) -> DataFrame:
    """Paragraphs that repeat: ``doc_id, row_key, paragraph, first_word, n_words, keep_doc_id, keep_paragraph,
    keep_first_word, kept, class_size``, a row per line or run. ``with_rows=False`` leaves ``row_key`` null.

    Lines hold a word between ASCII blanks; A-Z are lower-cased and blanks collapsed for the comparison; their
    ``first_word`` is null. Lines of fewer than SHINGLE words are one shingle, so they repeat by exact text only.

    Runs are blocks that follow each other alike in the same kept text; ``first_word`` is the first's place among
    the words of the text, ``paragraph`` the line it starts in, ``class_size`` the places of its commonest block.
    Every run of PASSAGE + STARTS - 1 = 51 words that occurs twice word by word is found, its row up to STARTS - 1 words
    short at either end; shorter and edited ones by chance. A block that overlaps the place it would repeat is left
    out; a word repeated on end repeats itself beyond that.

    Of each class the place of the smallest id (null last), then row and position, is kept; the others can be removed.
    Null and empty texts have no paragraph; repeated rows repeat their paragraphs; other columns are not read; an
    empty table gives an empty result. Names are 64-bit hashes. Working on a text takes some 100 bytes a word of it.
    """
    rows = keyed(docs, "__row").select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), (F.col("__row") if with_rows else F.lit(None).cast("string")).alias("row_key"), F.col(text_col).alias("text"))
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    keys = rows.select("text").mapInArrow(_keys(similarity), "key long, name long").repartition("key")
    shared = keys.groupBy("key", "name").agg(F.count("*").alias("times")).withColumn("n", F.count("*").over(W.partitionBy("key")))
    shared = written(shared.filter("n > 1 or (times > 1 and key = name)"), "para-shared")
    # buckets of the same names, whatever their band, are one
    sign = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("name")).alias("x"), F.sum(F.shiftright(F.xxhash64("name", F.lit(1)), 20)).alias("y"), F.min("name").alias("a"), F.max("name").alias("b")]
    buckets = shared.filter("n > 1").groupBy("key").agg(*sign).groupBy("n", "x", "y", "a", "b").agg(F.min("key").alias("key"))
    near = written(shared.filter("n > 1").join(buckets.select("key"), "key", "left_semi").select("key", "name", "n"), "para-near")
    filters = spark.sparkContext.broadcast((name_filter(shared.select("name").distinct()), name_filter(near.select("name").distinct())))
    # the places are written once, so the row numbers of that one job name their rows
    found = rows.mapInArrow(_places(filters), f"doc_id {kind}, row long, row_key string, kind byte, line int, at int, n_words int, name long, shingles array<long>")
    found = written(found, "para-places")
    sets = found.filter("kind is null").groupBy("name").agg(F.first("shingles").alias("shingles"))
    parts = written(connected_components(similar(near, sets, similarity, crowded)).withColumnRenamed("node", "name"), "para-parts")

    places = found.filter("kind is not null").drop("shingles")
    total = places.count()
    if parts.limit(FEW_PARTS + 1).count() <= FEW_PARTS:
        met = places.join(F.broadcast(parts), "name", "left")
    else:
        linked = places.groupBy("name").agg(F.count("*").alias("n"))
        met = hot_safe_join(places, written(parts.join(linked, "name"), "para-linked"), ["name"], "n", total, "left")
    met = written(met.select("*", F.coalesce("component", "name").alias("part")).drop("component", "name"), "para-met")
    at = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row", "at", "line")
    classes = met.groupBy("part").agg(F.min(at).alias("keep"), F.count("*").alias("class_size"), F.max("row").alias("last"), F.max("at").alias("far"), F.min("at").alias("near"), F.max("kind").alias("k"))
    lone = (F.col("k") == RUN) & (F.col("keep.row") == F.col("last")) & (F.col("far") - F.col("near") < PASSAGE)
    classes = classes.filter((F.col("class_size") > 1) & ~lone).select("part", "keep", "class_size", F.col("class_size").alias("n"))
    met = hot_safe_join(met, written(classes, "para-classes"), ["part"], "n", total, "inner")
    same, off = F.col("row") == F.col("keep.row"), F.col("at") - F.col("keep.at")
    met = met.filter(~(same & (F.col("kind") == RUN) & (off != 0) & (F.abs(off) < PASSAGE)))
    lines = met.filter(f"kind = {LINE}").select("doc_id", "row_key", F.col("line").alias("paragraph"), F.lit(None).cast("int").alias("first_word"), "n_words", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.line").alias("keep_paragraph"), F.lit(None).cast("int").alias("keep_first_word"), (same & (off == 0)).alias("kept"), "class_size")
    return lines.unionByName(runs(met.filter(f"kind = {RUN}")))


def runs(blocks: DataFrame) -> DataFrame:
    """Blocks of one text that lie alike in one kept text, at most STARTS words apart, as one row.

    Of blocks of one class that overlap in a text the first stands for the others.
    """
    b = blocks.select("row", "part", "doc_id", "row_key", "line", "at", "class_size", F.col("keep.row").alias("keep_row"), F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.line").alias("keep_line"), F.col("keep.at").alias("keep_at"))
    b = b.withColumn("shift", F.col("at") - F.col("keep_at")).repartition("row", "keep_row")  # serves all that follows
    before = F.col("at") - F.lag("at").over(W.partitionBy("row", "keep_row", "part").orderBy("at"))
    b = b.withColumn("before", before).filter(F.coalesce(F.col("before") >= PASSAGE, F.lit(True))).drop("before", "part")
    alike = W.partitionBy("row", "keep_row", "shift").orderBy("at")
    b = b.withColumn("new", F.coalesce(F.col("at") - F.lag("at").over(alike) > STARTS, F.lit(True)).cast("int"))
    b = b.withColumn("run", F.sum("new").over(alike))
    out = b.groupBy("row", "keep_row", "shift", "run").agg(
        F.first("doc_id").alias("doc_id"), F.first("row_key").alias("row_key"), F.min("line").alias("paragraph"), F.min("at").alias("first_word"), (F.max("at") - F.min("at") + PASSAGE).alias("n_words"),
        F.first("keep_doc_id").alias("keep_doc_id"), F.min("keep_line").alias("keep_paragraph"), F.min("keep_at").alias("keep_first_word"), F.max("class_size").alias("class_size"),
    )
    kept = (F.col("row") == F.col("keep_row")) & (F.col("shift") == 0)
    return out.select("doc_id", "row_key", "paragraph", "first_word", "n_words", "keep_doc_id", "keep_paragraph", "keep_first_word", kept.alias("kept"), "class_size")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that repeat (``first_word`` is null) and runs of words that repeat across line breaks or inside lines."""
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_rows=False).drop("row_key")
