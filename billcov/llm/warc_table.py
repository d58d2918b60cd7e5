"""WARC archives through a chunked record table (operator 5).

Method: payloads travel as rows (record, chunk number, chunk), so no task holds an oversized record:
the writer appends chunks to its archive as they come, the reader emits chunk rows that carry the
digest and the length of the payload up to there.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest page
identifier is written in full, the others as revisit records that name it.

Scale: equal payloads are found by digest, with partial minima; only digests that occur twice or
more are joined back, by broadcast if few, else by a join that Spark can split at a hot digest.
Every task writes archives of its own, with the attempt in the name; the manifest, a table that
Spark commits, lists what successful attempts wrote, in segments that begin and end between records,
so that readers share large archives.

Defined cases: null html is an empty payload; a null URL is written as ``urn:unknown``; line breaks
in URLs are percent-encoded; rows repeated with their identifier are all written as responses; a
null identifier is never referred to; extra columns are ignored; an empty table gives no archives.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billcov.functions.sizing import sized_broadcast
from billcov.llm.common import written

CHUNK_BYTES = 64 << 10
#: A task begins a new archive at this size, and a new segment of an archive at that.
ARCHIVE_BYTES = 1 << 30
SEGMENT_BYTES = 8 << 20
MIN_REVISIT = 100
MAX_BROADCAST = 1_000_000
DATE = "2023-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, begin long, end long, records long"
CHUNKS = (
    "page_id long, url string, record_type string, refers_to long, declared_bytes long, declared_digest string, "
    "chunk_no long, chunk binary, bytes_so_far long, digest_so_far string, is_last boolean"
)


def records(pages: DataFrame, *, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, n_bytes, digest, record_type, refers_to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    again = rows.where(F.col("n_bytes") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    first = sized_broadcast(again.select(F.col("digest").alias("d"), "first"), MAX_BROADCAST)
    both = rows.join(first, F.col("digest") == F.col("d"), "left").drop("d")
    revisit = (F.col("n_bytes") >= min_revisit) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return both.select("page_id", "url", "payload", "n_bytes", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def record_chunks(rows: DataFrame, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of a record in order of chunk_no; revisits have one row without a chunk."""
    stored = F.col("record_type") == "response"
    last = F.when(stored, F.greatest(F.ceil(F.col("n_bytes") / chunk_bytes).cast("int") - 1, F.lit(0))).otherwise(F.lit(0))
    return rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last))).select(
        "page_id", "url", "record_type", "refers_to", "n_bytes", "digest", "chunk_no",
        F.when(stored, F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))).alias("chunk"),
    )


def _name(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _page(name: str) -> int | None:
    tail = name.strip("<>").rpartition(":")[2]
    return None if tail == "none" else int(tail)


def _header(page: int | None, url: str | None, kind: str, refers: int | None, n: int, digest: str) -> bytes:
    """WARC header and HTTP header of a record, up to where its stored payload begins."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    url = (url or "urn:unknown").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers)}"]
    size = len(http) + (n if kind == "response" else 0)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {size}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_archives(chunks: DataFrame, folder: str, *, archive_bytes: int = ARCHIVE_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write the chunk rows as WARC archives below ``folder`` (a URI or path that all executors share); the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        out, path, files, at, begin, count = None, "", 0, 0, 0, 0
        found: list[tuple[str, int, int, int]] = []
        for batch in batches:
            for page, url, kind, refers, n, digest, chunk_no, chunk in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk_no == 0:
                    if count:
                        out.write(b"\r\n\r\n")
                        at += 4
                    if count and at - begin >= segment_bytes:
                        found.append((path, begin, at, count))
                        begin, count = at, 0
                    if out is not None and at >= archive_bytes:
                        if count:
                            found.append((path, begin, at, count))
                        out.close()
                        out, at, begin, count = None, 0, 0, 0
                    if out is None:
                        path = f"{base}/{task.partitionId():06d}-{task.taskAttemptId()}-{files:04d}.warc"
                        out, files = system.open_output_stream(path), files + 1
                    head = _header(page, url, kind, refers, n, digest)
                    out.write(head)
                    at += len(head)
                    count += 1
                if chunk:
                    out.write(chunk)
                    at += len(chunk)
        if out is not None:
            out.write(b"\r\n\r\n")
            found.append((path, begin, at + 4, count))
            out.close()
        if found:
            yield pa.record_batch([pa.array(c) for c in zip(*found)], names=["path", "begin", "end", "records"])

    return written(chunks.mapInArrow(run, MANIFEST), "warc-manifest")


def _fields(f: io.BufferedReader) -> dict[str, str]:
    out = {}
    while (line := f.readline()) not in (b"\r\n", b""):
        key, _, value = line.decode().partition(":")
        out[key.strip().lower()] = value.strip()
    return out


def read_archives(manifest: DataFrame, folder: str, *, chunk_bytes: int = CHUNK_BYTES, with_chunks: bool = True) -> DataFrame:
    """The chunked record table of the archives in ``manifest``.

    bytes_so_far and digest_so_far cover the payload up to and with the row's chunk; a record's last
    row (is_last) has those of the whole payload.  Revisits have one row, with what they declare.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("declared_bytes", pa.int64()), ("declared_digest", pa.string()),
             ("chunk_no", pa.int64()), ("chunk", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("is_last", pa.bool_())]
        )
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            out = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
            rows.clear()
            held = 0
            return out

        for batch in batches:
            for path, begin, end in zip(*(c.to_pylist() for c in batch.columns[:3])):
                with system.open_input_file(path) as raw:
                    raw.seek(begin)
                    f = io.BufferedReader(raw, 256 << 10)
                    while f.tell() < end:
                        version = f.readline()
                        if version != b"WARC/1.1\r\n":
                            raise ValueError(f"no WARC record at {f.tell()} of {path}: {version[:40]!r}")
                        head = _fields(f)
                        block = f.tell()
                        status = f.readline()
                        http = _fields(f)
                        if not status.startswith(b"HTTP/"):
                            raise ValueError(f"no HTTP message in {head['warc-record-id']}")
                        rest = int(head["content-length"]) - (f.tell() - block)
                        page, n, kind = _page(head["warc-record-id"]), int(http["content-length"]), head["warc-type"]
                        declared = head["warc-payload-digest"].partition(":")[2]
                        refers = _page(head["warc-refers-to"]) if "warc-refers-to" in head else None
                        fixed = (page, head["warc-target-uri"], kind, refers, n, declared)
                        if kind == "revisit":
                            rows.append((*fixed, 0, None, n, declared, True))
                        else:
                            sha, done, k = hashlib.sha256(), 0, 0
                            while True:
                                chunk = f.read(min(chunk_bytes, rest - done))
                                if len(chunk) < min(chunk_bytes, rest - done):
                                    raise ValueError(f"{head['warc-record-id']} ends early")
                                sha.update(chunk)
                                done += len(chunk)
                                rows.append((*fixed, k, chunk if with_chunks else None, done, sha.hexdigest(), done == rest))
                                held += len(chunk) if with_chunks else 0
                                k += 1
                                if held >= 8 << 20:
                                    yield flush()
                                if done == rest:
                                    break
                        if f.read(4) != b"\r\n\r\n":
                            raise ValueError(f"{head['warc-record-id']} is longer than it says")
                        if len(rows) >= 4096:
                            yield flush()
        if rows:
            yield flush()

    spread = manifest.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism), F.xxhash64("path", "begin"))
    return spread.mapInArrow(run, CHUNKS)


def archived(pages: DataFrame, folder: str, **options: int) -> DataFrame:
    """Write a record per page, read the archives back: the chunk table without chunks."""
    manifest = write_archives(record_chunks(records(pages)), folder, **options)
    return read_archives(manifest, folder, with_chunks=False)


def digest(table: DataFrame) -> DataFrame:
    """One row per record; intact: what was read agrees with what the header says."""
    return table.where("is_last").select(
        "page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to",
        ((F.col("bytes_so_far") == F.col("declared_bytes")) & (F.col("digest_so_far") == F.col("declared_digest"))).alias("intact"),
    )
