"""WARC archives: a writer that leaves copies out as revisits, and a sequential reader.

Every record is a gzip member of its own. The reader takes the file a chunk at a time, inflates
incrementally, frames each record by its content length and verifies the payload digest.

Writing: one record for each row, payload the html in UTF-8 (null: empty). Who refers to whom is decided from
identifiers, digests and lengths alone and written down as a narrow table; the payloads are joined to it once, revisits
go on without theirs, and each task writes one archive straight behind that join: into the shared folder under a
temporary name, then moved into place, so a task that is repeated leaves whole files only. Of the records with equal payloads
of at least ``min_bytes``, the one with the largest identifier is the response and the others are
revisits that name it; a revisit keeps the HTTP header with the payload's length and digest, not the
payload. Rows that repeat both identifier and payload are all written as the response; where every
copy has a null identifier there is none to refer to, and all are responses. Empty tables give no
archive and an empty result; other columns are not read. A very long payload is one record in the memory of one task.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fs_of, put_file, shared_dir, tidy, written

CHUNK = 1 << 16
LEVEL = 4


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id: int | None, uri: str | None, payload: bytes | None, length: int, digest: str, refers_to: int | None) -> bytes:
    """A record's bytes before compression. A revisit needs no payload, only its length and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {' '.join((uri or '').split())}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{b32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


class WarcError(ValueError):
    """The archive breaks its own framing or a digest does not fit."""


def read_members(stream) -> Iterator[bytes]:
    """The inflated members of an archive, one at a time, read in chunks."""
    left = b""
    while True:
        left = left or stream.read(CHUNK)
        if not left:
            return
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not left:
                left = stream.read(CHUNK)
                if not left:
                    raise WarcError("the last member is cut off")
            parts.append(z.decompress(left))
            left = z.unused_data if z.eof else b""
        yield b"".join(parts)


def parse(data: bytes) -> dict:
    """One record: its header fields, payload and the facts about it, verified."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"WARC/1."):
        raise WarcError("no record header")
    h = fields(head)
    if missing := [k for k in ("content-length", "warc-type", "warc-target-uri", "warc-block-digest", "warc-payload-digest") if k not in h]:
        raise WarcError(f"the header has no {missing[0]}")
    n = int(h["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise WarcError("the content length does not frame the block")
    if h["warc-block-digest"] != f"sha1:{b32(hashlib.sha1(block).digest())}":
        raise WarcError("the block digest differs")
    http, sep, payload = block.partition(b"\r\n\r\n")
    if not sep:
        raise WarcError("no HTTP header")
    length, digest = int(fields(http)["content-length"]), h["warc-payload-digest"].removeprefix("sha1:")
    if h["warc-type"] == "response" and (len(payload) != length or b32(hashlib.sha1(payload).digest()) != digest):
        raise WarcError("the payload digest differs")
    ident = lambda k: int(x) if (x := h.get(k, "").removeprefix("<urn:page:").removesuffix(">")) else None
    return {"page_id": ident("warc-record-id"), "url": h["warc-target-uri"], "payload": payload, "payload_bytes": length, "payload_digest": digest, "record_type": h["warc-type"], "refers_to": ident("warc-refers-to")}


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, files: int | None = None) -> DataFrame:
    """Writes the archives and returns their manifest (path, records)."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(html_col, F.lit("")), "UTF-8").alias("payload"))
    keyed = rows.withColumns({"digest": F.sha1("payload"), "n": F.length("payload")})
    facts = keyed.select("page_id", "digest", "n")
    # one row for each page and payload, so that a repeated row meets one answer and not as many as it has copies
    each = facts.where(F.col("n") >= min_bytes).groupBy("page_id", "digest").agg(F.lit(1).alias("one"))
    last = each.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    refs = each.select("page_id", "digest").join(last, "digest").where(~F.col("page_id").eqNullSafe(F.col("last")) & F.col("last").isNotNull())
    # written down, so its size is known: a small one is joined where the payloads are read, else they are dealt out once
    refs = written(spark, refs.select(F.col("page_id").alias("of"), F.col("digest").alias("ref_digest"), F.col("last").alias("refers_to")), "warc-revisits")
    dealt = keyed.join(refs, keyed["page_id"].eqNullSafe(refs["of"]) & (keyed["digest"] == refs["ref_digest"]), "left")
    dealt = dealt.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "n", "digest", "refers_to")
    if files:
        dealt = dealt.repartition(files, "page_id", "digest")

    @tidy
    def run(batches):
        from pyspark import TaskContext

        uri, n = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0
        first = next(batches, None)
        if first is None:
            return

        def write(out):
            nonlocal n

            def every():
                yield first
                yield from batches

            for b in every():
                for at in range(0, b.num_rows, 256):
                    for page, url, payload, length, digest, ref in zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True):
                        out.write(member(record(page, url, payload, length, b32(bytes.fromhex(digest)), ref)))
                        n += 1

        put_file(uri, write)
        yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64())], names=["path", "records"])

    return dealt.mapInArrow(run, "path string, records long")


def read_archives(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """Every record of the archives named in ``path``, verified; a broken archive raises ``WarcError``."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload

    @tidy
    def run(batches):
        schema = pa.schema([(k, {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}.get(k, pa.string())) for k in names])
        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, path = fs_of(uri)
                with fs.open_input_stream(path, compression=None) as f:
                    out, size = [], 0
                    for data in read_members(f):
                        r = parse(data)
                        out.append({k: r[k] for k in names})
                        size += len(r["payload"]) if payload else 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out, size = [], 0
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema)

    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    return manifest.select("path").repartition(n).mapInArrow(run, kinds)


def round_trip(pages: DataFrame, payload: bool = False, **options) -> DataFrame:
    """Write all rows as archives below the shared folder and read them back."""
    spark = pages.sparkSession
    folder = shared_dir(spark, f"warc-{uuid.uuid4().hex[:6]}")
    manifest = written(spark, write_archives(pages, folder, **options), "warc-manifest")
    return read_archives(manifest, payload)
