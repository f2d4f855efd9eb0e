"""Web archive records in ZIP containers: written by tasks, read back by ranges.

An archive is a ZIP file of stored members: ``archive/data.warc.gz``, one gzip member per record, and
``indexes/index.cdxj``, a sorted line per record with its offset and length. A reader takes the ZIP directory from the
end of the file, then the index, then the records, each by ranges of the container; nothing is extracted.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import hot_safe_join
from ..sources.files import Ranges, put
from ..sources.shared import shared_dir, written
from .zip_archive import data_offset, directory, write_zip

#: Equal payloads of at least so many bytes are written once.
LEAST_BYTES = 1000
#: An archive is closed at so many compressed bytes; a task holds one archive at a time.
ARCHIVE_BYTES = 16 << 20
#: Records read in one row of work, and bytes fetched at once.
CHUNK_RECORDS, FETCH_BYTES = 512, 4 << 20
#: Up to so many digests of repeated payloads are broadcast; more are met in a shuffled join.
FEW_DIGESTS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def record(page_id, url: str | None, payload: bytes, digest: bytes, size: int, refers_to, date: str) -> bytes:
    """A record, gzipped on its own. ``digest``: SHA-1 of the full payload; a revisit holds no payload."""
    safe = lambda s: s.replace("\r", "%0D").replace("\n", "%0A")
    body = payload if refers_to is None else b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        *([] if url is None else [f"WARC-Target-URI: {safe(url)}"]),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"WARC-X-Payload-Length: {size}",
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + len(body)}",
    ]
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + http) + z.compress(body) + z.compress(b"\r\n\r\n") + z.flush()


def parse(data: bytes) -> dict:
    """Headers (lower-case names) of one gzipped record, its type, payload and whether the payload's digest holds."""
    raw = zlib.decompress(data, 31)
    at = raw.index(b"\r\n\r\n")
    lines = raw[:at].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = raw[at + 4 : at + 4 + int(head["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
    kind, _, value = head.get("warc-payload-digest", "").partition(":")
    digest = base64.b32decode(value) if kind == "sha1" else None
    if head["warc-type"] == "response" and digest is not None and hashlib.sha1(payload).digest() != digest:
        raise ValueError(f"the payload of {head.get('warc-record-id')} does not match its digest")
    return {"head": head, "payload": payload, "digest": digest}


def sort_key(url: str | None) -> str:
    """An address with the host's labels turned round, as index lines are sorted by."""
    rest = (url or "").split("://", 1)[-1]
    host, slash, path = rest.partition("/")
    return f"{','.join(reversed(host.lower().split('.')))}){slash}{path}".replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D")


def _writer(folder: str, archive_bytes: int, zip64: bool, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        lines: list[str] = []
        size = 0

        def close() -> pa.RecordBatch:
            uri = f"{folder}/{uuid.uuid4().hex}.zip"
            put(uri, write_zip([(DATA, parts), (INDEX, ["".join(sorted(lines)).encode()])], zip64))
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([len(lines)], pa.int64())], ["archive", "n_records"])

        stamp = "".join(c for c in date if c.isdigit())
        for b in batches:
            for page_id, url, payload, digest, n, refers_to in zip(*(c for c in b.columns), strict=True):
                key, url, sha = page_id.as_py(), url.as_py(), bytes.fromhex(digest.as_py())
                data = record(key, url, payload.as_py() or b"", sha, n.as_py(), refers_to.as_py(), date)
                lines.append(f"{sort_key(url)} {stamp} {json.dumps({'url': url, 'digest': 'sha1:' + base64.b32encode(sha).decode(), 'length': len(data), 'offset': size, 'filename': DATA})}\n")
                parts.append(data)
                size += len(data)
                if size >= archive_bytes:
                    yield close()
                    parts, lines, size = [], [], 0
        if lines:
            yield close()

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES, zip64: bool = False, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of ``pages`` to archives in ``folder`` and return their list ``archive, n_records``.

    The payload is the html in UTF-8 (null: empty). Of equal payloads of at least ``least`` bytes, rows with the
    largest id (a whole number) are responses and the others revisits of it; smaller payloads, and those whose ids are all null, are
    responses. Null urls give no target; other columns are not read; an empty table gives no archive. Archives have
    new names in each attempt of a task; the returned list names those of the attempts that counted.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload").cast("long")})
    light = rows.select("page_id", "digest", "n")
    same = light.filter(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n_same"))
    same = written(same.filter((F.col("n_same") > 1) & F.col("first_id").isNotNull()), "warc-same")
    n_same, covered = same.agg(F.count("*"), F.sum("n_same")).first()
    if n_same <= FEW_DIGESTS:
        rows = rows.join(F.broadcast(same.drop("n_same")), "digest", "left")
    else:
        rows = hot_safe_join(rows, same, ["digest"], "n_same", covered)
    other = F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id"))
    rows = rows.select("page_id", "url", F.when(other.isNull(), F.col("payload")).alias("payload"), "digest", "n", other.alias("refers_to"))
    done = rows.mapInArrow(_writer(folder, archive_bytes, zip64, date), "archive string, n_records long")
    return written(done, "warc-list")


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for uri in b.column(0).to_pylist():
            src = Ranges(uri)
            members = {m.name: m for m in directory(src)}
            index = members[INDEX]
            lines = src.read(data_offset(src, index), index.size).decode().split("\n")[:-1]
            at = {}
            spans = []
            for line in lines:
                x = json.loads(line[line.index("{") :])
                name = x["filename"]
                if name not in at:
                    at[name] = data_offset(src, members[name])
                spans.append((at[name] + int(x["offset"]), int(x["length"])))
            src.close()
            spans.sort()
            for i in range(0, len(spans), CHUNK_RECORDS):
                part = spans[i : i + CHUNK_RECORDS]
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([[o for o, _ in part]], pa.list_(pa.int64())), pa.array([[n for _, n in part]], pa.list_(pa.int64()))], ["archive", "offsets", "lengths"])


def _reader(with_payload: bool):
    def ident(value: str | None) -> int | None:
        inner = (value or "").strip("<>").rpartition(":")[2]
        return int(inner) if inner else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, offsets, lengths in zip(*(c.to_pylist() for c in b.columns), strict=True):
                src, rows = Ranges(uri), []
                i = 0
                while i < len(offsets):
                    j, begin = i, offsets[i]
                    while j < len(offsets) and (j == i or offsets[j] + lengths[j] - begin <= FETCH_BYTES):
                        j += 1
                    data = src.read(begin, offsets[j - 1] + lengths[j - 1] - begin)
                    for o, n in zip(offsets[i:j], lengths[i:j], strict=True):
                        r = parse(data[o - begin : o - begin + n])
                        h = r["head"]
                        whole = len(r["payload"]) if h["warc-type"] == "response" else int(h["warc-x-payload-length"])
                        rows.append((ident(h["warc-record-id"]), h.get("warc-target-uri"), whole, r["digest"].hex(), h["warc-type"], ident(h.get("warc-refers-to")), r["payload"] if with_payload else None))
                    i = j
                src.close()
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return run


def read_archives(archives: DataFrame, with_payload: bool = False, partitions: int | None = None) -> DataFrame:
    """Records of the archives whose addresses are in the first column of ``archives``.

    Columns ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload`` (null unless asked for;
    empty for revisits). A response whose payload does not match its digest, or a damaged directory, is an error.
    Work is dealt out by index chunks, so one large archive is read by many tasks.
    """
    spark = archives.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = archives.select(F.col(archives.columns[0]).alias("archive")).repartition(n).mapInArrow(_index, "archive string, offsets array<long>, lengths array<long>")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return chunks.repartition(n).mapInArrow(_reader(with_payload), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_dir(spark, "warc"))
    return read_archives(archives).drop("url", "payload")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(encode(h)) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last_id FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
FROM m
"""
