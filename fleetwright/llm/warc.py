"""WARC archives as a table of chunks.

Writing: payloads come as rows (record, chunk number, bytes), in order, and are streamed into
archives record by record; a writer holds one chunk at a time. Reading: archives are read back
as rows (record, chunk number, bytes or only their count), each with the digest of the payload
up to there, so that no record is held as a whole. Of records with equal payloads, one is a
`response`, the others are `revisit` records that refer to it and carry only its HTTP headers.

A task writes archives under names of its own and lists them in its output rows. Only archives
listed in the stored manifest count; what a lost or repeated attempt left is never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwright.llm.common import store
from fleetwright.session import new_scratch_path

CHUNK = 1 << 20
ARCHIVE_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records bigint"
CHUNKS = (
    "page_id {kind}, record_type string, refers_to {kind}, target_uri string, chunk_no bigint, "
    "chunk_bytes bigint, payload_bytes bigint, payload_digest string, last boolean, data binary"
)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, size, response_id, is_response for every row.

    Of equal payloads of at least `min_bytes`, the row with the largest page_id is the response;
    smaller ones are all responses. Rows that repeat page_id and payload share their role. Null
    html is an empty payload. A null page_id comes below all others.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    keyed = pages.select("page_id", "url", payload.alias("payload"))
    keyed = keyed.select(
        "*", F.octet_length("payload").cast("bigint").alias("size"), F.sha2("payload", 256).alias("key")
    )
    small = keyed.select("page_id", "size", "key")
    tops = small.where(F.col("size") >= min_bytes).groupBy("key").agg(F.max("page_id").alias("top"))
    roles = store(
        small.join(tops, "key").select("page_id", "key", "top").distinct(), "roles"
    ).withColumnRenamed("page_id", "_id").withColumnRenamed("key", "_key")
    same = keyed["page_id"].eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    first = F.coalesce(F.col("page_id").eqNullSafe(F.col("top")), F.lit(True)) | F.col("_key").isNull()
    return keyed.join(roles, same, "left").select(
        "page_id", "url", "payload", "size", F.col("top").alias("response_id"), first.alias("is_response")
    )


def chunked(recs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per chunk of a response's payload; one row without data for a revisit."""
    last = F.when(F.col("is_response"), F.greatest(F.ceil(F.col("size") / chunk) - 1, F.lit(0))).otherwise(F.lit(0))
    parts = F.transform(
        F.sequence(F.lit(0).cast("bigint"), last.cast("bigint")),
        lambda i: F.struct(
            i.alias("chunk_no"),
            F.when(
                F.col("is_response"),
                F.substring(F.col("payload"), (i * chunk + 1).cast("int"), F.lit(chunk)),
            ).alias("data"),
        ),
    )
    sha = F.unhex(F.sha1("payload"))
    return recs.select(
        "page_id", "url", "size", "response_id", "is_response", sha.alias("sha"), F.explode(parts).alias("c")
    ).select("page_id", "url", "size", "response_id", "is_response", "sha", "c.chunk_no", "c.data")


def _crlf(*lines: str) -> bytes:
    return "".join(f"{line}\r\n" for line in lines).encode("utf-8") + b"\r\n"


def _one_line(text: str | None) -> str:
    """A header value: line breaks would end it, so they are escaped."""
    return (text or "").replace("%0D", "%250D").replace("%0A", "%250A").replace("\r", "%0D").replace("\n", "%0A")


def _unescaped(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%250A", "%0A").replace("%250D", "%0D")


def _head(row: dict) -> bytes:
    """WARC and HTTP headers of a record."""
    size, digest = row["size"], base32(row["sha"])
    http = _crlf("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {size}")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if row['is_response'] else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if row['page_id'] is None else row['page_id']}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {_one_line(row['url'])}")
    if not row["is_response"]:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{row['response_id']}>"]
    body = size if row["is_response"] else 0
    lines.append(f"Content-Length: {len(http) + body}")
    return _crlf(*lines) + http


def write_archives(chunks: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Stream chunk rows into gzip archives (one member per record) below `path`; the manifest.

    The chunks of a record must be neighbours in their partition and in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store_, base = fs.FileSystem.from_uri(path)
        store_.create_dir(base, recursive=True)
        out = member = None
        name, count, digest, done = "", 0, None, []
        for row in (r for b in batches for at in range(0, b.num_rows, 64) for r in b.slice(at, 64).to_pylist()):
            if row["chunk_no"] == 0:
                if out is not None and out.tell() >= archive_bytes:
                    out.close()
                    done.append((name, count))
                    out = None
                if out is None:
                    name, count = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store_.open_output_stream(f"{base}/{name}", compression=None)
                member = gzip.GzipFile(fileobj=out, mode="wb", compresslevel=2, mtime=0)
                member.write(_head(row))
                digest, left, count = hashlib.sha1(), row["size"], count + 1
            if row["is_response"]:
                data = row["data"] or b""
                digest.update(data)
                member.write(data)
                left -= len(data)
            else:
                left = 0
            if left == 0:
                if row["is_response"] and digest.digest() != row["sha"]:
                    raise ValueError(f"payload of {row['page_id']} changed on its way")
                member.write(b"\r\n\r\n")
                member.close()
        if out is not None:
            out.close()
            done.append((name, count))
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{path}/{d[0]}" for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())],
            ["path", "records"],
        )

    return chunks.mapInArrow(run, MANIFEST)


def _headers(stream: io.BufferedIOBase) -> tuple[str, dict[str, str], int] | None:
    """First line, fields and length of a header block; None at the end."""
    first = stream.readline()
    if not first:
        return None
    fields, size = {}, len(first)
    while True:
        line = stream.readline()
        size += len(line)
        if line in (b"\r\n", b""):
            return first.decode().strip(), fields, size
        key, _, value = line.decode("utf-8").partition(":")
        fields[key.lower()] = value.strip()


def read_chunks(stream: io.BufferedIOBase, chunk: int, with_data: bool) -> Iterator[dict]:
    """The records of an archive as chunk rows; `payload_digest` covers the payload so far.

    A revisit has no payload of its own: its row tells the length and digest of the full one.
    """
    while True:
        found = _headers(stream)
        if found is None:
            return
        line, fields, _ = found
        if not line:
            continue  # between records
        if not line.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        _, http, size = _headers(stream)
        left = int(fields["content-length"]) - size
        kind, ref = fields["warc-type"], fields.get("warc-refers-to", "")
        uri = fields.get("warc-target-uri")
        base = {
            "page_id": fields["warc-record-id"][len("<urn:page:") : -1] or None,
            "record_type": kind,
            "refers_to": ref[len("<urn:page:") : -1] or None,
            "target_uri": None if uri is None else _unescaped(uri),
        }
        stated = fields["warc-payload-digest"].partition(":")[2]
        if kind == "revisit":
            yield base | {
                "chunk_no": 0, "chunk_bytes": 0, "payload_bytes": int(http["content-length"]),
                "payload_digest": stated, "last": True, "data": None,
            }
            continue
        digest, seen, number = hashlib.sha1(), 0, 0
        while True:
            data = stream.read(min(chunk, left))
            if not data and left:
                raise ValueError("archive ends inside a record")
            digest.update(data)
            left -= len(data)
            seen += len(data)
            so_far = base32(digest.digest())
            if not left and so_far != stated:
                raise ValueError(f"digest of {base['page_id']} differs")
            yield base | {
                "chunk_no": number, "chunk_bytes": len(data), "payload_bytes": seen,
                "payload_digest": so_far, "last": not left, "data": data if with_data else None,
            }
            number += 1
            if not left:
                break


def read_archives(
    manifest: DataFrame, kind: str = "bigint", chunk: int = CHUNK, with_data: bool = True
) -> DataFrame:
    """The chunk table of the listed archives; `kind` is the type of page_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store_, base = fs.FileSystem.from_uri(path)
                with store_.open_input_stream(base, compression=None) as raw:
                    with gzip.GzipFile(fileobj=io.BufferedReader(raw)) as stream:
                        held, rows = 0, []
                        for row in read_chunks(io.BufferedReader(stream, 1 << 16), chunk, with_data):
                            rows.append(row)
                            held += len(row["data"] or b"") + 200
                            if held > 4 * chunk:
                                yield batch_of(rows)
                                held, rows = 0, []
                        if rows:
                            yield batch_of(rows)

    types = {"chunk_no": pa.int64(), "chunk_bytes": pa.int64(), "payload_bytes": pa.int64(), "last": pa.bool_(), "data": pa.binary()}
    names = ["page_id", "record_type", "refers_to", "target_uri", "chunk_no", "chunk_bytes", "payload_bytes", "payload_digest", "last", "data"]
    schema = ", ".join(f"{n} {'string' if n not in types else {'last': 'boolean', 'data': 'binary'}.get(n, 'bigint')}" for n in names)

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names], names
        )

    out = manifest.select("path").repartition("path").mapInArrow(run, schema)
    return out.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def archive(pages: DataFrame, *, min_bytes: int = 0, chunk: int = CHUNK, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for every row of `pages` (page_id, url, html) below the shared folder; the
    stored manifest. Other columns are ignored; an empty table gives no archive."""
    path = new_scratch_path(pages.sparkSession, "warc")
    rows = chunked(records(pages, min_bytes), chunk)
    return store(write_archives(rows, path, archive_bytes), "manifest")


def summary(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, chunks: one row a record."""
    return chunks.where("last").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
        (F.col("chunk_no") + 1).alias("chunks"),
    )
