"""WARC archives through a chunked record table.

A record is one or more rows (record, chunk number): a payload longer than ``chunk`` bytes is cut by the scan into pieces of
that size, and each is a row of its own from there on: Python holds one Arrow batch of them, which
``spark.sql.execution.arrow.maxBytesPerBatch`` bounds, however large the record (the JVM holds a row's html while it cuts it). The writer streams chunks into gzip
members, one member a record, under a running SHA-1 that must match the digest in the record's header when its last chunk
is in; the reader streams archives back into chunk rows that carry the running digest and length.

Of records with equal payloads of at least ``least`` bytes, the one with the largest page_id is a response and the others are
revisits that refer to it; a null page_id is never the largest. Rows with that same largest page_id (repeated rows) are
all responses. If all page_ids of a group are null, all are responses. A null html counts as empty, a null url is left out
of the header. Other columns are ignored; an empty table gives no archives and no rows.

Each task writes one archive under a name of its own attempt; only archives that a finished task has reported are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwave.llm.common import new_path, small, written
from pairwave.sources.shared import file_system

CHUNK, LEAST = 1 << 18, 1000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORDS = "page_id long, url string, digest string, n long, record_type string, refers_to long, chunk_no int, last boolean, payload binary"
CHUNKS = "page_id long, url string, record_type string, refers_to long, chunk_no int, last boolean, running_sha1 string, running_bytes long, payload_digest string, payload_bytes long, payload binary"


def record_table(pages: DataFrame, chunk: int = CHUNK, least: int = LEAST) -> DataFrame:
    """The rows (record, chunk) to write, chunks of a record one after the other."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("payload")).select("page_id", "url", "payload", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("n"))
    same = rows.where(F.col("n") >= least).groupBy("digest", "n").agg(F.max("page_id").alias("best"), F.count("*").alias("copies")).where("copies > 1 and best is not null")
    best = small(written(same.select("digest", "n", "best"), "copies"))
    typed = rows.join(best, ["digest", "n"], "left").withColumn("revisit", F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best")))
    last = F.when(F.col("revisit") | (F.col("n") == 0), F.lit(0)).otherwise(F.floor((F.col("n") - 1) / chunk).cast("int"))
    each = typed.withColumn("last_no", last).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("last_no"))))
    piece = F.when(~F.col("revisit"), F.substring(F.col("payload"), F.col("chunk_no") * chunk + 1, F.lit(chunk)))
    kind = F.when(F.col("revisit"), "revisit").otherwise("response")
    return each.select("page_id", "url", "digest", "n", kind.alias("record_type"), F.when(F.col("revisit"), F.col("best")).alias("refers_to"), "chunk_no", (F.col("chunk_no") == F.col("last_no")).alias("last"), piece.alias("payload"))


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def header(page_id: int | None, url: str | None, digest: str, n: int, kind: str, refers_to: int | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        f"X-Payload-Length: {n}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(HTTP) + (n if kind == 'response' else 0)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + HTTP


def write_archives(pages: DataFrame, folder: str, chunk: int = CHUNK, least: int = LEAST) -> DataFrame:
    """Write the archives; returns the manifest (file, records), one row an archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = file_system(folder)
        context = TaskContext.get()
        name = f"pages-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        out, records, pack, running = None, 0, None, None
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if out is None:
                    store.create_dir(where, recursive=True)
                    out = store.open_output_stream(f"{where}/{name}", compression=None)
                if row["chunk_no"] == 0:
                    pack, running = zlib.compressobj(4, wbits=31), hashlib.sha1()
                    out.write(pack.compress(header(row["page_id"], row["url"], row["digest"], row["n"], row["record_type"], row["refers_to"])))
                if row["payload"] is not None:
                    running.update(row["payload"])
                    out.write(pack.compress(row["payload"]))
                if row["last"]:
                    if row["record_type"] == "response" and running.hexdigest() != row["digest"]:
                        raise ValueError(f"page {row['page_id']}: the chunks don't make up the payload")
                    out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                    records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records], pa.int64())], names=["file", "records"])

    return written(record_table(pages, chunk, least).mapInArrow(run, "file string, records long"), "manifest")


def page_of(identifier: str) -> int | None:
    value = identifier.strip("<>").rpartition(":")[2]
    return None if value == "none" else int(value)


def read_records(f: BinaryIO, chunk: int, with_payload: bool) -> Iterator[tuple]:
    """Chunk rows of an archive, in the order of CHUNKS; holds one chunk at a time."""
    while True:
        line = f.readline()
        if not line:
            return
        if line.strip() != b"WARC/1.1":
            raise ValueError("not at the start of a WARC record")
        fields = {}
        while (line := f.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(": ")
            fields[name.lower()] = value
        url = fields.get("warc-target-uri")
        if url is not None:
            url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
        left, kind = int(fields["content-length"]), fields["warc-type"]
        while (line := f.readline()) != b"\r\n":  # the HTTP head
            left -= len(line)
        left -= 2
        digest, declared = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex(), int(fields["x-payload-length"])
        refers = page_of(fields["warc-refers-to"]) if kind == "revisit" else None
        running, size, no = hashlib.sha1(), 0, 0
        while True:
            data = f.read(min(chunk, left))
            if len(data) < min(chunk, left):
                raise ValueError("a WARC record is cut short")
            left -= len(data)
            size += len(data)
            running.update(data)
            yield page_of(fields["warc-record-id"]), url, kind, refers, no, not left, running.hexdigest(), size, digest, declared, data if with_payload else None
            no += 1
            if not left:
                break
        if f.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record doesn't end where its length says")


def read_archives(manifest: DataFrame, chunk: int = CHUNK, with_payload: bool = True) -> DataFrame:
    """The chunk table of the archives of a manifest."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("running_sha1", pa.string()), ("running_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
    most = 1 << 23 if with_payload else 1 << 40

    def rows(file: str) -> Iterator[tuple]:
        store, where = file_system(file)
        with store.open_input_stream(where, compression=None) as raw, gzip.GzipFile(fileobj=raw) as f:
            yield from read_records(f, chunk, with_payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda held: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                held, size = [], 0
                for r in rows(file):
                    held.append(r)
                    size += len(r[-1] or b"")
                    if len(held) >= 4096 or size >= most:
                        yield pack(held)
                        held, size = [], 0
                if held:
                    yield pack(held)

    files = manifest.select("file")
    return files.repartitionByRange(max(1, files.count()), "file").mapInArrow(run, CHUNKS)


def round_trip(pages: DataFrame, chunk: int = CHUNK, least: int = LEAST) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from archives written and read back."""
    manifest = write_archives(pages, new_path(pages.sparkSession, "warc"), chunk, least)
    rows = read_archives(manifest, chunk, with_payload=False).where("last")
    whole = F.col("record_type") == "response"
    return rows.select(
        "page_id",
        F.when(whole, F.col("running_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, F.col("running_sha1")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
