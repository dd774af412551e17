"""Web archives as a chunked record table.

The archive is a table whose rows are pieces of WARC/1.1 records: ``record_id``,
``chunk_no``, ``data``, the digest state after this chunk (``running_sha1``, of
the payload so far) and ``last``.  The chunks of a record put together in order
are the record's bytes as a WARC file holds them.  A record of ordinary size is
one row; an oversized payload is streamed as rows of at most ``CHUNK_BYTES``,
so neither writing nor reading ever builds the whole record, and Spark's own
writer and committer put the rows into any store.

Of records with equal payloads of ``REVISIT_BYTES`` or more, the one with the
largest id keeps the payload as a ``response``; the others become ``revisit``
records that name it.  Only digests are grouped; the payloads stay where they
are, as the revisits are attached by a broadcast while they are proven few and
by a hash join beyond that.

Reading checks the digest after each chunk.  Records of one row are read in
place; only the rows of oversized ones are dealt by record and put in order.

Defined results: null html is an empty payload; a null url is written as
``urn:page:<id>``; a url is written as it is, but for line breaks, which are
percent-encoded and make a further header keep the exact url; rows that repeat an id with other html are separate records;
a row with a null id is a record too and the first choice of no group; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import tidied

CHUNK_BYTES = 256 << 10
REVISIT_BYTES = 1000
#: Rows of the revisit table (40 bytes each) that are broadcast at most.
BROADCAST_ROWS = 1_000_000
#: Encoded bytes handed back to Spark at once.
BATCH_BYTES = 4 << 20

ARCHIVE = "record_id string, chunk_no int, data binary, running_sha1 string, last boolean"
_FIELDS = [("record_id", pa.string()), ("chunk_no", pa.int32()), ("data", pa.binary()), ("running_sha1", pa.string()), ("last", pa.bool_())]
_RECORD = "page_id long, record_type string, refers_to long, target_uri string, payload_bytes long, payload_digest string"
_RECORD_FIELDS = [
    ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
]
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _line(value: str) -> str:
    """A url in one line: CR and LF are percent-encoded, all else is left alone."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _header(page_id: int | None, url: str | None, kind: str, refers_to: int | None, length: int, sha1: str) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Target-URI: {_line(url) if url is not None else _urn(page_id)[1:-1]}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}", f"X-Payload-Length: {length}"]
    if url is not None and (_line(url) != url or url != url.strip(" ")):
        lines.append(f"X-Exact-Target: {base64.b64encode(url.encode()).decode()}")
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if kind == 'revisit' else length}"]
    return "\r\n".join(lines).encode() + _END


def _chunks(head: bytes, payload: memoryview) -> Iterator[tuple[int, bytes, str, bool]]:
    state, n = hashlib.sha1(), 0
    if len(payload) <= CHUNK_BYTES:
        state.update(payload)
        yield 0, head + bytes(payload) + _END, state.hexdigest(), True
        return
    yield n, head, state.hexdigest(), False
    for at in range(0, len(payload), CHUNK_BYTES):
        part = payload[at : at + CHUNK_BYTES]
        state.update(part)
        n, last = n + 1, at + CHUNK_BYTES >= len(payload)
        yield n, bytes(part) + (_END if last else b""), state.hexdigest(), last


def _batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, size = [], 0
        for i in range(batch.num_rows):
            page_id, url, digest, refers_to, length = (batch.column(k)[i].as_py() for k in (0, 1, 3, 4, 5))
            kind = "response" if refers_to is None else "revisit"
            payload = batch.column(2)[i].as_buffer() if kind == "response" else None
            body = memoryview(payload) if payload is not None else memoryview(b"")
            # Rows of an oversized record find each other by a name that no repeated id shares.
            name = _urn(page_id) + (f"#{uuid.uuid4().hex}" if len(body) > CHUNK_BYTES else "")
            for n, data, sha1, last in _chunks(_header(page_id, url, kind, refers_to, length, digest), body):
                rows.append((name, n, data, sha1, last))
                size += len(data)
                if size >= BATCH_BYTES:
                    yield _batch(rows, _FIELDS)
                    rows, size = [], 0
        yield _batch(rows, _FIELDS)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The chunk rows of one record per page; write them as a table with Spark."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    digests = rows.select("page_id", F.sha1("payload").alias("digest"), F.length("payload").cast("long").alias("length"))
    large = digests.where((F.col("length") >= REVISIT_BYTES) & F.col("page_id").isNotNull())
    groups = large.groupBy("digest", "length").agg(F.max("page_id").alias("holder"), F.min("page_id").alias("least")).where("least < holder")
    revisits = (
        large.join(groups, ["digest", "length"]).where("page_id < holder").select("page_id", F.col("digest").alias("own"), F.col("holder").alias("refers_to")).distinct()
    )
    # Counting stops as soon as the bound is passed.
    few = revisits.limit(broadcast_rows + 1).count() <= broadcast_rows
    # The digest is part of the key: an id may come again with other html.
    keyed = rows.withColumn("digest", F.sha1("payload"))
    joined = keyed.join(
        F.broadcast(revisits) if few else revisits.hint("shuffle_hash"),
        (keyed["page_id"] == revisits["page_id"]) & (keyed["digest"] == revisits["own"]),
        "left",
    )
    return joined.select(keyed["page_id"], "url", "payload", "digest", "refers_to", F.length("payload").cast("long").alias("length")).mapInArrow(tidied(_write), ARCHIVE)


class _Reader:
    """Takes the chunks of one record in turn."""

    def __init__(self, record_id: str):
        self.record_id, self.pending, self.head, self.seen, self.state, self.next = record_id, b"", None, 0, hashlib.sha1(), 0

    def add(self, chunk_no: int, data: bytes, running: str, last: bool) -> tuple | None:
        if chunk_no != self.next:
            raise ValueError(f"{self.record_id}: chunk {self.next} is missing")
        self.next += 1
        if self.head is None:
            head, mark, data = (self.pending + data).partition(_END)
            if not mark:
                raise ValueError(f"{self.record_id}: no end of header in the first chunk")
            self.head = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            self.left = int(self.head["Content-Length"])
        body = memoryview(data)[: self.left - self.seen]
        self.state.update(body)
        self.seen += len(body)
        if self.state.hexdigest() != running or last and (self.seen != self.left or bytes(data[len(body) :]) != _END):
            raise ValueError(f"{self.record_id}: chunk {chunk_no} is damaged")
        return self.record() if last else None

    def record(self) -> tuple:
        h = self.head
        number = lambda s: None if s is None or "null" in s else int(s.strip("<>").rpartition(":")[2])
        sha1 = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        if h["WARC-Type"] == "response" and sha1 != self.state.hexdigest():
            raise ValueError(f"{self.record_id}: the payload doesn't have its digest")
        size = int(h.get("X-Payload-Length", h["Content-Length"]))
        url = base64.b64decode(h["X-Exact-Target"]).decode() if "X-Exact-Target" in h else h["WARC-Target-URI"]
        return number(h["WARC-Record-ID"]), h["WARC-Type"], number(h.get("WARC-Refers-To")), url, size, sha1


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, rows = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            record_id, chunk_no, running, last = (batch.column(k)[i].as_py() for k in (0, 1, 3, 4))
            if chunk_no == 0:
                reader = _Reader(record_id)
            if reader is None or reader.record_id != record_id:
                raise ValueError(f"{record_id}: its first chunk is missing")
            if (record := reader.add(chunk_no, batch.column(2)[i].as_py(), running, last)) is not None:
                rows.append(record)
                reader = None
        yield _batch(rows, _RECORD_FIELDS)
        rows = []
    if reader is not None:
        raise ValueError(f"{reader.record_id}: its last chunk is missing")


def read_archive(chunks: DataFrame) -> DataFrame:
    """The records of an archive table, verified: page_id, record_type, refers_to, target_uri, payload_bytes, payload_digest."""
    single = (F.col("chunk_no") == 0) & F.col("last")
    whole = chunks.where(single).mapInArrow(tidied(_read), _RECORD)
    streamed = chunks.where(~single).repartition("record_id").sortWithinPartitions("record_id", "chunk_no").mapInArrow(tidied(_read), _RECORD)
    return whole.unionAll(streamed)
