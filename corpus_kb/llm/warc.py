"""WARC archives: write, normalise a monolithic gzip into one member a record, read back by the sidecar index.

``write_archives`` lets every task write its rows as archives that are one gzip stream each, the layout that cannot be entered in the
middle. ``normalise`` inflates each such file once, front to back, holding one record at a time, writes every record again as its
own gzip member and an index (offset, length, id, type) beside it. ``read_archives`` goes to the members by that index.
Files lie below the shared folder and are reached through ``pyarrow.fs``, so any store that it knows will do. Names carry the task
attempt and only the names that a successful attempt returns are used, so lost executors leave no half-written archive behind.

Of records with equal payloads of at least ``least`` bytes the one with the largest page_id is the response and the others
revisit it. Rows: null html is an empty payload; a null page_id never becomes the response of others; rows that repeat the largest
page_id of their payload are responses too; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_kb.llm.common import materialize
from corpus_kb.session import shared_dir

ARCHIVE_BYTES, CHUNK, LEVEL = 64 << 20, 1 << 20, 2
DATE = "2020-01-01T00:00:00Z"
ROWS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def with_duplicates(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload, digest and the page whose response the row revisits (null for responses)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    same = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1").drop("n")
    refers = F.when(~F.col("newest").eqNullSafe(F.col("page_id")), F.col("newest"))
    return rows.join(same, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def _uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page(uri: str) -> int | None:
    text = uri.strip("<>").rpartition(":")[2]
    return int(text) if text else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One response or revisit record; a revisit keeps the HTTP head, with the length of the payload it stands for."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}"] if url is not None else []),
        *([f"WARC-Refers-To: {_uri(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to is not None else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(lines: bytes) -> dict[str, str]:
    return {k.decode().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines.split(b"\r\n")[1:])}


def inflate(stream) -> Iterator[bytes]:
    """Bytes of a gzip file in chunks, however many members it has."""
    machine = zlib.decompressobj(31)
    while chunk := stream.read(CHUNK):
        while chunk:
            yield machine.decompress(chunk)
            chunk = machine.unused_data
            if machine.eof:
                machine = zlib.decompressobj(31)
                if not chunk:
                    break


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and raw bytes of each record of an inflated archive; holds one record and one chunk."""
    held = bytearray()
    end, need = -1, 0
    for chunk in chunks:
        held += chunk
        while True:
            if end < 0:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                fields = headers(bytes(held[:end]))
                need = end + 4 + int(fields["content-length"]) + 4
            if len(held) < need:
                break
            yield fields, bytes(held[:need])
            del held[:need]
            end = -1
    if held:
        raise ValueError("the archive ends inside a record")


def write_archives(rows: DataFrame, root: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of the rows of ``with_duplicates``, one gzip stream each; (path, records) of all that were written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = store(root)
        where.create_dir(base, recursive=True)
        name = f"{base}/part-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}"
        out, machine, size, n, files = None, None, 0, 0, []

        def close() -> None:
            out.write(machine.flush())
            out.close()
            files.append((f"{name}-{len(files):04d}.warc.gz", n))

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(i) for i in range(5)), strict=True):
                if out is None:
                    out, machine, size, n = where.open_output_stream(f"{name}-{len(files):04d}.warc.gz", compression=None), zlib.compressobj(LEVEL, wbits=31), 0, 0
                data = record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py())
                out.write(machine.compress(data))
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in files], pa.string()), pa.array([k for _, k in files], pa.int64())], names=["path", "records"])

    return materialize(rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, records long"), "warc_manifest")


def _spread(manifest: DataFrame, most: int = 20_000) -> DataFrame:
    """One archive a task, as far as that is sensible."""
    return manifest.repartition(max(1, min(manifest.count(), most)))


def normalise(manifest: DataFrame, root: str) -> DataFrame:
    """Each archive again with a member a record (``*.normal.warc.gz``) and its index (``*.idx``); (path, index, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = store(root)
        done = []
        for batch in batches:
            for path in batch["path"].to_pylist():
                stem, offset, index = f"{path.removesuffix('.warc.gz')}-{TaskContext.get().taskAttemptId()}.normal", 0, []
                with where.open_input_stream(path, compression=None) as source, where.open_output_stream(f"{stem}.warc.gz", compression=None) as out:
                    for fields, raw in records(inflate(source)):
                        machine = zlib.compressobj(LEVEL, wbits=31)
                        member = machine.compress(raw) + machine.flush()
                        out.write(member)
                        index.append(json.dumps({"id": fields["warc-record-id"], "type": fields["warc-type"], "offset": offset, "length": len(member)}))
                        offset += len(member)
                with where.open_output_stream(f"{stem}.idx", compression=None) as out:
                    out.write("\n".join(index).encode())
                done.append((f"{stem}.warc.gz", f"{stem}.idx", len(index)))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["path", "index", "records"])

    return materialize(_spread(manifest).mapInArrow(run, "path string, index string, records long"), "warc_normal")


def parsed(raw: bytes) -> tuple:
    """A row of ``ROWS`` from one record; a response's payload is held against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = headers(head)
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    size, digest = int(headers(http)["content-length"]), base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
    return (_page(fields["warc-record-id"]), fields.get("warc-target-uri"), size, digest, fields["warc-type"], _page(fields["warc-refers-to"]) if revisit else None)


def read_archives(normal: DataFrame, root: str) -> DataFrame:
    """Rows of all records, each member reached by its index entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = store(root)
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for path, index in zip(batch["path"].to_pylist(), batch["index"].to_pylist(), strict=True):
                with where.open_input_stream(index, compression=None) as source:
                    entries = [json.loads(x) for x in source.read().splitlines()]
                with where.open_input_file(path) as archive:
                    for first in range(0, len(entries), 5000):
                        rows = [parsed(zlib.decompress(archive.read_at(e["length"], e["offset"]), 31)) for e in entries[first : first + 5000]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return _spread(normal).mapInArrow(run, ROWS)


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write, normalise and read back all pages."""
    root = shared_dir(pages.sparkSession, "warc")
    return read_archives(normalise(write_archives(with_duplicates(pages, least), root), root), root)
