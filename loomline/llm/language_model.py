"""Language-model scores from an Elias-Fano n-gram trie that is built and queried in shards.

The model is a bigram model with a Dirichlet prior around the add-one unigram model: with c the training counts,
p(w | v) = (c(v, w) + m p(w)) / (c(v) + m). p(w) = (c(w) + 1) / (N + V + 1) gives unknown words one share. Both sum to
one over the known words and the unknown. m is the value of a grid with the best leave-one-out likelihood, summed over
all chunks of training text, each by its own counts: it is needed before bigrams are counted over chunks.

Texts are cut into chunks of bounded size whose words are kept as numbers in files of the shared folder. Chunks and
shards exchange packed arrays: each chunk asks every word shard for the counts of its distinct words, then every
bigram shard about its distinct bigrams. A bigram shard adds up the counts, writes its trie (contexts with quantised
backoff weights, then words relative to their context with quantised log probabilities), maps the file and answers
from it: the probability of a bigram it holds, else the backoff weight of its context. Equal words and
bigrams are counted within a chunk before they travel, and a context with much of the text is dealt to several
shards by its next word, so no shard holds more than its share. Counts cover all training text.
"""

from __future__ import annotations

import mmap
import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import Ranges, local_path, put
from ..sources.shared import shared_dir, written
from .elias_fano import NgramTrie

#: A chunk is closed at so many tokens; a task holds one.
CHUNK_TOKENS = 1 << 20
#: One word shard and one bigram shard for so many bytes of text.
SHARD_BYTES = 20 << 20
#: Prior masses that are tried.
GRID = tuple(float(10 ** (k / 2)) for k in range(0, 13))
#: A context goes to more than one shard if it has more than this share of a shard's mean number of tokens.
HOT = 0.25
BEGIN, END = b"\t", b"\n"  # no word holds these
ABSENT, BEGIN_ID = -1, 0


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays with their bytes dealt by significance, so that small numbers compress well."""
    z = zstandard.ZstdCompressor(level=1)
    out = [struct.pack("<I", len(arrays))]
    for a in arrays:
        raw = z.compress(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes())
        out.append(struct.pack("<4sQQ", a.dtype.str.encode().ljust(4), len(a), len(raw)) + raw)
    return b"".join(out)


def unpack(data) -> list[np.ndarray]:
    data, at, out = memoryview(data), 4, []
    z = zstandard.ZstdDecompressor()
    for _ in range(struct.unpack_from("<I", data, 0)[0]):
        kind, n, size = struct.unpack_from("<4sQQ", data, at)
        kind = np.dtype(kind.strip().decode())
        raw = np.frombuffer(z.decompress(data[at + 20 : at + 20 + size], max_output_size=max(1, n * kind.itemsize)), np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).reshape(-1).view(kind))
        at += 20 + size
    return out


def by_shard(shard: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """A permutation that sorts by shard, then ``order`` (first key first), and where each shard lies in it."""
    at = np.lexsort((*order[::-1], shard))
    begin = np.flatnonzero(np.diff(shard[at], prepend=-1)).tolist()
    return at, list(zip(begin, [*begin[1:], len(at)], strict=False))


def prior_fit(pairs: np.ndarray, n: np.ndarray, context: np.ndarray, p1: np.ndarray) -> np.ndarray:
    """Leave-one-out log likelihood for each mass of the grid. Counts of bigrams, of their contexts, unigram odds."""
    keep = n > 0
    n, context, p1 = n[keep].astype(float), context[keep].astype(float), p1[keep]
    return np.array([float((n * np.log((n - 1 + m * p1) / (context - 1 + m))).sum()) for m in GRID])


def _cut(folder: str, n_shards: int, chunk_tokens: int):
    """Chunks of documents (columns doc_id, train, text) to files; their distinct words to word shards."""

    def run(batches):
        part = TaskContext.get().partitionId()
        state = {"k": 0}

        def fresh():
            return {END: 0, BEGIN: 1}, [], [], [], []

        local, tokens, sizes, train, held = fresh()
        count = 0

        def close():
            name = f"{part}-{state['k']}"
            state["k"] += 1
            text = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
            n, is_train = np.array(sizes, np.int64), np.array(train, bool)
            of = np.repeat(is_train, n)
            words = np.fromiter((xxhash.xxh64_intdigest(w) for w in local), np.uint64, len(local))
            c = np.bincount(text[of], minlength=len(local))
            v = previous(text, n)
            key, inverse = np.unique(v.astype(np.int64) * len(local) + text, return_inverse=True)
            pair = np.bincount(inverse, of, len(key)).astype(np.int64)
            context = np.bincount(v[of], minlength=len(local))
            known = int((c > 0).sum())
            fit = prior_fit(key, pair, context[key // len(local)], (c[key % len(local)] + 1) / (c.sum() + known + 1))
            ids = pa.BufferOutputStream()
            with pa.ipc.new_stream(ids, held[0].schema) as to:
                to.write_table(pa.Table.from_batches(held))
            put(f"{folder}/chunks/{name}", [pack(text, n.astype(np.int32), is_train.astype(np.uint8), words, np.frombuffer(ids.getvalue(), np.uint8))])
            asked = np.delete(np.arange(len(local)), 1)
            shard = (words[asked] % np.uint64(n_shards)).astype(np.int64)
            at, places = by_shard(shard, words[asked])
            rows = [(int(shard[at[i]]), name, pack(words[asked][at[i:j]], c[asked][at[i:j]].astype(np.uint32))) for i, j in places]
            rows.append((-1 - xxhash.xxh64_intdigest(name) % n_shards, name, pack(fit)))
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.binary()), strict=True)], ["shard", "chunk", "blob"])

        for b in batches:
            at = 0
            for i, (flag, text) in enumerate(zip(b.column(1), b.column(2), strict=True)):
                found = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                put_in = local.setdefault
                codes = [put_in(w, len(local)) for w in found]
                codes.append(0)
                tokens.append(np.array(codes, np.int32))
                sizes.append(len(codes))
                train.append(flag.as_py())
                count += len(codes)
                if count >= chunk_tokens:
                    held.append(b.slice(at, i + 1 - at).select([0]))
                    at = i + 1
                    yield close()
                    local, tokens, sizes, train, held = fresh()
                    count = 0
            if at < b.num_rows:
                held.append(b.slice(at).select([0]))
        if sizes:
            yield close()

    return run


def previous(text: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each, BEGIN's number (1) at the start of a document."""
    v = np.empty_like(text)
    v[1:] = text[:-1]
    v[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = 1
    return v


def _curves(batches):
    """Likelihood curves as rows ``k, value``."""
    for b in batches:
        found = [unpack(x.as_buffer())[0] for x in b.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(len(GRID), dtype=np.int32), len(found))), pa.array(np.concatenate(found) if found else np.zeros(0))], ["k", "value"])


REPLY = "chunk string, shard long, blob binary, n long, v long"


def _count_words(n_shards: int):
    """A word shard: total counts and numbers of its words, told to every chunk that asked."""

    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        chunks = table["chunk"].to_pylist()
        asked = [unpack(x.as_buffer()) for x in table["blob"]]
        if shard < 0:
            total = np.sum([x[0] for x in asked], axis=0)
            return pa.table([[None], [shard], [pack(total)], [0], [0]], schema=_schema())
        words, inverse = np.unique(np.concatenate([x[0] for x in asked]), return_inverse=True)
        c = np.bincount(inverse, np.concatenate([x[1] for x in asked]), len(words)).astype(np.int64)
        number = np.where(c > 0, (np.cumsum(c > 0) - 1) * n_shards + shard + 1, ABSENT)
        rows, at = [], 0
        for name, x in zip(chunks, asked, strict=True):
            mine = inverse[at : at + len(x[0])]
            at += len(x[0])
            rows.append((name, shard, pack(number[mine], c[mine]), 0, 0))
        rows[0] = (*rows[0][:3], int(c.sum()), int((c > 0).sum()))
        return pa.table([list(x) for x in zip(*rows, strict=True)], schema=_schema())

    return run


def _schema() -> pa.Schema:
    return pa.schema([("chunk", pa.string()), ("shard", pa.int64()), ("blob", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])


def _get(uri: str) -> list[np.ndarray]:
    src = Ranges(uri)
    data = src.read(0, src.size)
    src.close()
    return unpack(data)


def pair_shard(v: np.ndarray, w: np.ndarray, context: np.ndarray, total: int, n_shards: int) -> np.ndarray:
    """Where a bigram is counted: by its context, and also by its word if the context holds much of the text."""
    mix = lambda x: ((x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    spread = np.maximum(1, np.ceil(context * (n_shards / (HOT * max(1, total))))).astype(np.uint64)
    spread = np.minimum(spread, np.uint64(n_shards))
    return ((mix(v) + mix(w) % spread) % np.uint64(n_shards)).astype(np.int64)


def _pairs(text, sizes, is_train, number, c):
    """Distinct bigrams of a chunk whose words are both known, by the chunk's own numbers; training counts; where each token's is."""
    size = len(number)
    v = previous(text, sizes)
    key = v.astype(np.int64) * size + text
    ask = (number[v] >= 0) & (number[text] >= 0)
    distinct, inverse = np.unique(key[ask], return_inverse=True)
    n = np.bincount(inverse, np.repeat(is_train, sizes)[ask], len(distinct)).astype(np.int64)
    return v, ask, distinct // size, distinct % size, n, inverse


def _ask_pairs(folder: str, n_shards: int, total: int):
    """A chunk with its replies from the word shards: asks the bigram shards, and notes numbers and counts in a file."""

    def run(table: pa.Table) -> pa.Table:
        name = table["chunk"][0].as_py()
        text, sizes, is_train, words, _ = _get(f"{folder}/chunks/{name}")
        number, c = np.full(len(words), ABSENT, np.int64), np.zeros(len(words), np.int64)
        asked = np.delete(np.arange(len(words)), 1)
        shard = (words[asked] % np.uint64(table["v"][0].as_py())).astype(np.int64)
        at, places = by_shard(shard, words[asked])
        replies = {s.as_py(): b for s, b in zip(table["shard"], table["blob"], strict=True)}
        for i, j in places:
            number[asked[at[i:j]]], c[asked[at[i:j]]] = unpack(replies[int(shard[at[i]])].as_buffer())
        number[1], c[1] = BEGIN_ID, c[0]
        put(f"{folder}/numbers/{name}", [pack(number, c)])
        _, _, v, w, n, _ = _pairs(text, sizes, is_train.astype(bool), number, c)
        shard = pair_shard(number[v], number[w], c[v], total, n_shards)
        at, places = by_shard(shard, number[v], number[w])
        rows = []
        for i, j in places:
            mine = at[i:j]
            heads = np.flatnonzero(np.diff(number[v[mine]], prepend=-1))
            of = v[mine][heads]
            rows.append((int(shard[mine[0]]), name, pack(np.diff(number[of], prepend=0), np.diff(np.append(heads, len(mine))).astype(np.uint32), c[of], number[w[mine]], n[mine].astype(np.uint32), c[w[mine]])))
        return pa.table([list(x) for x in zip(*rows, strict=True)] if rows else [[], [], []], schema=pa.schema([("shard", pa.int64()), ("chunk", pa.string()), ("blob", pa.binary())]))

    return run


def _answer_pairs(folder: str, total: int, known: int, mass: float):
    """A bigram shard: adds up counts, writes its trie, and answers every chunk from the mapped file."""

    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        chunks = table["chunk"].to_pylist()
        sizes, vs, ws, ns, cvs, cws = [], [], [], [], [], []
        for x in table["blob"]:
            head, times, cv, w, n, cw = unpack(x.as_buffer())
            vs.append(np.repeat(np.cumsum(head), times))
            cvs.append(np.repeat(cv, times))
            ws.append(w)
            ns.append(n)
            cws.append(cw)
            sizes.append(len(w))
        v, w, n, cv, cw = (np.concatenate(x) for x in (vs, ws, ns, cvs, cws))
        del vs, ws, ns, cvs, cws
        small = len(v) and max(v.max(), w.max()) < 1 << 31
        order = np.argsort(v << 32 | w, kind="stable") if small else np.lexsort((w, v))
        first = np.ones(len(order), bool)
        first[1:] = (np.diff(v[order]) != 0) | (np.diff(w[order]) != 0)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(first) - 1
        lead = order[first]
        count = np.bincount(group, n, len(lead))
        v, w, cv, cw = v[lead], w[lead], cv[lead].astype(float), cw[lead].astype(float)
        seen = count > 0
        p1 = (cw + 1) / (total + known + 1)
        value = np.log10((count + mass * p1) / (cv + mass))[seen]
        contexts, parent = np.unique(v[seen], return_inverse=True)
        rest = np.log10(mass / (cv[seen][np.unique(parent, return_index=True)[1]] + mass))
        trie = NgramTrie.build([(np.zeros(len(contexts), np.int64), contexts, rest), (parent, w[seen], value)])
        uri = f"{folder}/trie/{shard}.ngt"
        put(uri, trie.to_bytes())
        with mapped(uri) as trie:
            context = trie.child(0, np.zeros(len(v), np.int64), v)
            at = trie.child(1, context, w)
            code = lambda level, i: np.where(i >= 0, trie.codes[level][np.maximum(i, 0)].astype(np.int16) if len(trie.codes[level]) else 0, 0)
            # a bigram's code, or a backoff's below -1, or -1 for a context that no training text of this shard has
            found = np.where(at >= 0, code(1, at), np.where(context >= 0, -2 - code(0, context), -1)).astype(np.int16)
            books = np.array(trie.books[1]), np.array(trie.books[0])
        rows = [(name, pack(found[g], *books)) for name, g in zip(chunks, np.split(group, np.cumsum(sizes)[:-1]), strict=True)]
        return pa.table([[x for x, _ in rows], [shard] * len(rows), [x for _, x in rows]], schema=pa.schema([("chunk", pa.string()), ("shard", pa.int64()), ("blob", pa.binary())]))

    return run


class mapped:  # noqa: N801
    """A trie's file as a memory map (or, in a store that cannot be mapped, as its bytes)."""

    def __init__(self, uri: str):
        self.uri = uri

    def __enter__(self) -> NgramTrie:
        path = local_path(self.uri)
        if path is None:
            src = Ranges(self.uri)
            return NgramTrie.mapped(src.read(0, src.size))
        with open(path, "rb") as f:
            return NgramTrie.mapped(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def __exit__(self, *_) -> None:
        return None


def _score(folder: str, n_shards: int, total: int, known: int, mass: float):
    """A chunk with its answers: the scores of its documents."""

    def run(table: pa.Table) -> pa.Table:
        name = table["chunk"][0].as_py()
        text, sizes, is_train, _, ids = _get(f"{folder}/chunks/{name}")
        number, c = _get(f"{folder}/numbers/{name}")
        v, ask, pv, pw, _, inverse = _pairs(text, sizes, is_train.astype(bool), number, c)
        shard = pair_shard(number[pv], number[pw], c[pv], total, n_shards)
        at, places = by_shard(shard, number[pv], number[pw])
        replies = {s.as_py(): b for s, b in zip(table["shard"], table["blob"], strict=True)}
        base = np.log10((c[text] + 1.0) / (total + known + 1))
        # by pair: a known bigram's value, or the weight of its context that its word's own odds are added to
        value, whole = np.log10(mass / (c[pv] + mass)), np.zeros(len(pv), bool)
        for i, j in places:
            code, book, weights = unpack(replies[int(shard[at[i]])].as_buffer())
            mine = at[i:j]
            whole[mine] = code >= 0
            value[mine] = np.where(code >= 0, book[np.maximum(code, 0)], np.where(code < -1, weights[np.maximum(-2 - code, 0)], value[mine]))
        # unknown words are asked of no shard; their contexts' weights follow from the counts
        token = base + np.where(number[v] >= 0, np.log10(mass / (c[v] + mass)), 0.0)
        token[ask] = value[inverse] + np.where(whole[inverse], 0.0, base[ask])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        out = [pa.ipc.open_stream(pa.py_buffer(ids.tobytes())).read_all().column(0), pa.array(~is_train.astype(bool)), pa.array(sizes.astype(np.int64)), pa.array(np.add.reduceat((c[text] > 0).astype(np.int64), starts)), pa.array(np.full(len(sizes), total, np.int64)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(token, starts))]
        return pa.Table.from_arrays(out, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def language_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = CHUNK_TOKENS, n_shards: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from rows where ``train`` is true (null: false). Tokens are the words between ASCII blanks, A-Z
    lower-cased, and one end; null and empty texts have the end alone. ``base_score`` is the add-one unigram log10
    probability, ``score`` the bigram model's. Null ids and repeated rows are scored and counted as they come; other
    columns are not read; an empty table gives an empty result, and without training rows every token is unknown.
    The trie's files stay in the shared folder with the table.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "lm")
    if n_shards is None:
        n_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        n_shards = max(8, -(-n_bytes // SHARD_BYTES))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_shards)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    asked = rows.mapInArrow(_cut(folder, n_shards, chunk_tokens), "shard long, chunk string, blob binary")
    replies = written(asked.repartition(parts, "shard").groupBy("shard").applyInArrow(_count_words(n_shards), REPLY), "lm-words")
    total, known = replies.agg(F.sum("n"), F.sum("v")).first()
    total, known = total or 0, known or 0
    fits = replies.filter("chunk is null").select("blob").mapInArrow(_curves, "k int, value double").groupBy("k").agg(F.sum("value").alias("value")).collect()
    mass = GRID[max(fits, key=lambda r: (r.value, -r.k)).k] if fits else GRID[0]
    told = replies.filter("chunk is not null").select("chunk", "shard", "blob", F.lit(n_shards).cast("long").alias("v"))
    pairs = told.repartition(parts, "chunk").groupBy("chunk").applyInArrow(_ask_pairs(folder, n_shards, total), "shard long, chunk string, blob binary")
    answers = pairs.repartition(parts, "shard").groupBy("shard").applyInArrow(_answer_pairs(folder, total, known, mass), "chunk string, shard long, blob binary")
    # a chunk without known bigrams still has its documents: its first word reply stands in
    every = replies.filter("chunk is not null").groupBy("chunk").agg(F.lit(-1).cast("long").alias("shard"), F.lit(b"").alias("blob"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    answers = written(answers, "lm-answers").unionByName(every)
    return answers.repartition(parts, "chunk").groupBy("chunk").applyInArrow(_score(folder, n_shards, total, known, mass), out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return language_scores(docs, ~held_out)
