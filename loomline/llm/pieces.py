"""SentencePiece encoding by a table of distinct marked words, and decoding.

In a model whose pieces hold the whitespace marker only in front, no piece and no merge crosses from a word into the
next marker, so a text's pieces are those of its marked words one after the other. Every block of rows names its
distinct marked words; these meet in one table in the order of the words, where each distinct word is segmented once,
and the ids go back to the blocks that have the word, as files in the shared folder. A task that reads the texts looks
up its block's words and joins the ids by position. A word has one row a block, so none is a hot key, and texts are not
shuffled.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import sentencepiece
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from ..sources.files import store
from ..sources.shared import keyed, shared_dir
from .slices import slices

MARK = "▁"
#: Bytes of text of a block of rows, on average; its distinct words are held in one task.
BLOCK_BYTES = 1 << 26
#: Distinct words that a task gathers before it hands them on.
MOST_GATHERED = 1 << 20
MARKED = re.compile(rb" +[^ ]*")


@functools.lru_cache(2)
def processor(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def separable(model: bytes) -> bool:
    """Can texts be segmented marked word by marked word? Else whole texts are."""
    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(model)
    rules = m.normalizer_spec
    plain = not rules.precompiled_charsmap and not rules.remove_extra_whitespaces
    marks = rules.add_dummy_prefix and rules.escape_whitespaces and not m.trainer_spec.treat_whitespace_as_suffix
    cut_first = sentencepiece_model_pb2.ModelProto.SentencePiece.USER_DEFINED
    crossing = any(MARK in p.piece.lstrip(MARK) or p.type == cut_first for p in m.pieces)
    return bool(plain and marks and not crossing and any(p.piece == MARK for p in m.pieces))


def marked_words(text: str | None) -> Iterator[list[bytes]]:
    """A text's marked words in order, in lists of bounded size, each without its first marker; spaces are markers.

    The first word takes the marker that every text is given; a run of markers belongs to the word after it, and one
    at the end of the text stands alone. An empty text has none.
    """
    data = (text or "").encode("utf-8", "surrogatepass").replace(MARK.encode(), b" ")
    for i, part in enumerate(slices(data) if data else ()):
        part = part if i else b" " + part
        yield [w[1:] for w in MARKED.findall(part)] if b"  " in part else part[1:].split(b" ")


def _place(key: pa.Scalar, rows: int) -> tuple[int, int]:
    """The file (its hash as a signed number) and the block of a row's name."""
    file, _, row = key.as_py().rpartition(":")
    n = int(file, 16)
    return n - (1 << 64) if n >> 63 else n, int(row) // rows


def _words(rows: int) -> Callable:
    """The distinct marked words of every block of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        at = None

        def handed_on() -> pa.RecordBatch:
            words = pa.array(seen, pa.binary()).cast(pa.string())
            file, block = (pa.array(np.full(len(seen), x, np.int64)) for x in (at or (0, 0)))
            seen.clear()
            return pa.RecordBatch.from_arrays([words, file, block], ["word", "file", "block"])

        for b in batches:
            for text, key in zip(b.column(0), b.column(1), strict=True):
                if at != (place := _place(key, rows)):
                    yield handed_on()
                    at = place
                for words in marked_words(text.as_py()):
                    seen.update(words)
                    if len(seen) > MOST_GATHERED:
                        yield handed_on()
        yield handed_on()

    return run


def _segment(model: bytes) -> Callable:
    """From rows in the order of words and blocks: a row for each block of a batch with its words and their ids.

    Every word is segmented once. ``words`` are joined by 0xFF, which UTF-8 never holds; ``sizes`` are numbers of ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        alone = [sp.piece_to_id(MARK)]
        last, last_ids, last_row = None, b"", None
        for b in batches:
            words = b.column(0).to_pylist()
            new = [w for w, before in zip(words, [last, *words[:-1]], strict=True) if w != before] if words else []
            found = iter([np.array(x if w else alone, id_type(sp)).tobytes() for w, x in zip(new, sp.encode(new, num_threads=1), strict=True)])
            blocks: dict[tuple[int, int], tuple[list, list]] = {}
            for row in zip(words, b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if row[0] != last:
                    last, last_ids = row[0], next(found)
                if row != last_row:  # a block that two tasks read names a word twice
                    own = blocks.setdefault(row[1:], ([], []))
                    own[0].append(last.encode())
                    own[1].append(last_ids)
                last_row = row
            width = np.dtype(id_type(sp)).itemsize
            out = [(*at, b"\xff".join(w), (np.array(list(map(len, ids)), "<u4") // width).astype("<u4").tobytes(), b"".join(ids)) for at, (w, ids) in blocks.items()]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["file", "block", "words", "sizes", "ids"])

    return run


def id_type(sp: sentencepiece.SentencePieceProcessor) -> str:
    return "<u2" if sp.vocab_size() <= 1 << 16 else "<u4"


class Lookup:
    """A block's words and their ids."""

    def __init__(self, path: str, file: int, block: int, kind: str):
        where, top = store(f"{path}/file={file}/block={block}")
        words, sizes, ids = [], [np.zeros(0, "<u4")], [np.zeros(0, kind)]
        if where.get_file_info(top).type != fs.FileType.NotFound:
            for x in ds.dataset(top, filesystem=where, format="parquet").to_table(columns=["words", "sizes", "ids"]).to_pylist():
                words += x["words"].split(b"\xff")
                sizes.append(np.frombuffer(x["sizes"], "<u4"))
                ids.append(np.frombuffer(x["ids"], kind))
        self.of = {w: i for i, w in enumerate(words)}
        self.ids, self.size = np.concatenate(ids), np.concatenate(sizes).astype(np.int64)
        self.begin = np.cumsum(self.size) - self.size

    def __call__(self, text: str | None) -> np.ndarray:
        """The ids of a text, word by word."""
        out = [np.zeros(0, np.int32)]
        for words in marked_words(text):
            at = np.fromiter(map(self.of.__getitem__, words), np.int64, len(words))
            size = self.size[at]
            ends = np.cumsum(size)
            place = np.arange(ends[-1]) + np.repeat(self.begin[at] - (ends - size), size)
            out.append(self.ids[place].astype(np.int32))
        return np.concatenate(out)


def _join_back(model: bytes, path: str, rows: int) -> Callable:
    """Every text's ids by position, and the text that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, at, lookup = processor(model), None, None
        for b in batches:
            ids, decoded = [], []
            for text, key in zip(b.column(1), b.column(2), strict=True):
                if at != (place := _place(key, rows)):
                    lookup = None  # the block before goes first
                    at, lookup = place, Lookup(path, *place, id_type(sp))
                ids.append(lookup(text.as_py()))
                decoded.append(sp.decode(ids[-1].tolist()))
            sizes = np.cumsum([0, *map(len, ids)])
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), lists, pa.array(decoded, pa.string())], ["doc_id", "row_key", "ids", "decoded"])

    return run


def _whole(model: bytes) -> Callable:
    """For models that cannot be cut at markers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        for b in batches:
            ids = [sp.encode(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ids, pa.list_(pa.int32())), pa.array([sp.decode(x) for x in ids], pa.string())], ["doc_id", "row_key", "ids", "decoded"])

    return run


def encoded(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, row_key, ids, decoded``.

    ``ids`` are those that the sentencepiece library gives for the whole text under ``model`` (a model file's bytes),
    without begin or end; ``decoded`` is what it makes of them again. Null and empty texts have no ids and decode to an
    empty text. Null ids and repeated rows are carried as they come; other columns are not read; an empty table gives
    an empty result. A text is split in slices of 4 MB; its ids are held at once, and so are the distinct words of a
    block of rows (``block_bytes`` of text on average, one row at least). The blocks' words stay in the shared folder.
    """
    spark = docs.sparkSession
    named = keyed(docs, "__row").select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col("__row").alias("row_key"))
    out = f"doc_id {docs.schema[id_col].dataType.simpleString()}, row_key string, ids array<int>, decoded string"
    if not separable(model):
        return named.mapInArrow(_whole(model), out)
    n, size = named.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    rows = max(1, block_bytes * n // max(1, size or 0)) if n else 1
    words = named.select("text", "row_key").mapInArrow(_words(rows), "word string, file long, block long")
    table = words.repartition("word").sortWithinPartitions("word", "file", "block").mapInArrow(_segment(model), "file long, block long, words binary, sizes binary, ids binary")
    path = shared_dir(spark, "pieces")
    table.repartition("file", "block").write.option("compression", "zstd").partitionBy("file", "block").parquet(path)
    return named.mapInArrow(_join_back(model, path, rows), out)


def query(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    with open(model_path, "rb") as f:
        out = encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), f.read())
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
