import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from loomline.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
BITS = ["a", "b ", "  c", "\n", "▁", "é", "x" * 50, "<s>", "\t", "word", "   ", " ", "😀", "\x00", "7", "ﬁ", "　", ".", "The", " the"]


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return f.read()


def made(seed, n):
    r = random.Random(seed)
    return [(i, "".join(r.choice(BITS) for _ in range(r.randrange(0, 30)))) for i in range(n)]


def test_ids_and_texts_are_the_library_s(spark, model):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = made(1, 1500) + [(None, None), (5000, ""), (5001, " "), (5002, "x" * 200_000), (5003, ("ab  " * 30 + " ") * 90_000), (5004, "same"), (5004, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as ids", "2 as word", "'f' as file").repartition(3)
    for most in (pieces.BLOCK_BYTES, 20_000, 1):  # one block of rows, several, one a row
        out = pieces.encoded(df, model, block_bytes=most).collect()
        assert len(out) == len(rows)
        got = {x.doc_id: x for x in out}
        for i, t in rows:
            want = sp.encode(t or "")
            assert list(got[i].ids) == want and got[i].decoded == sp.decode(want), (most, i)


def test_query_digests(spark, tmp_path):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = made(2, 50)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted((i, len(ids), digest(",".join(map(str, ids))), digest(sp.decode(ids))) for i, t in rows for ids in [sp.encode(t)])
    assert sorted(tuple(x) for x in pieces.query(spark, str(tmp_path)).collect()) == want


def test_models_that_cross_markers_take_whole_texts(spark, model):
    assert pieces.separable(model)
    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(model)
    m.pieces[300].piece = "a▁b"
    crossing = m.SerializeToString()
    m.ParseFromString(model)
    m.normalizer_spec.remove_extra_whitespaces = True
    stripped = m.SerializeToString()
    rows = made(3, 60)
    for own in (crossing, stripped):
        assert not pieces.separable(own)
        sp = sentencepiece.SentencePieceProcessor(model_proto=own)
        out = pieces.encoded(spark.createDataFrame(rows, "doc_id long, text string"), own).collect()
        assert all(list(x.ids) == sp.encode(dict(rows)[x.doc_id]) for x in out) and len(out) == len(rows)


def test_each_word_is_segmented_once(spark, model, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(pieces, "MOST_GATHERED", 3)
    texts = ["a b c a d e", "a", None, "a f  "]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["F:1", "F:2", "F:3", "F:4"])], ["text", "key"])
    rows = [tuple(x.values()) for b in pieces._words(3)(iter([batch])) for x in b.to_pylist()]
    assert set(rows) == {(w, 15, 0) for w in "abcde"} | {(w, 15, 1) for w in ("a", "f", " ")}
    asked = []

    class Spy:
        sp = pieces.processor(model)
        piece_to_id, vocab_size = sp.piece_to_id, sp.vocab_size

        def encode(self, words, **kw):
            asked.extend(words)
            return self.sp.encode(words, **kw)

    monkeypatch.setattr(pieces, "processor", lambda m: Spy())
    rows = sorted([*rows, ("a", 15, 0), ("", 15, 1)])
    parts = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in p], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["word", "file", "block"]) for p in (rows[:3], rows[3:5], [], rows[5:])]
    out = [x for b in pieces._segment(model)(iter(parts)) for x in b.to_pylist()]
    found = [(w.decode(), x["file"], x["block"]) for x in out for w in x["words"].split(b"\xff")]
    assert sorted(asked) == sorted({r[0] for r in rows}) and sorted(found) == sorted(set(rows))
    assert all(2 * sum(np.frombuffer(x["sizes"], "<u4")) == len(x["ids"]) and len(x["sizes"]) == 4 * len(x["words"].split(b"\xff")) for x in out)


def test_encoding_of_nothing(spark, model):
    out = pieces.encoded(spark.createDataFrame([], "doc_id string, text string"), model)
    assert out.columns == ["doc_id", "row_key", "ids", "decoded"] and out.count() == 0
