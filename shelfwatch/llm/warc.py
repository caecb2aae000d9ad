"""WARC archives: written as gzip members, one per record, and read back by byte ranges.

A reading task gets (file, first byte, last byte). It looks for the gzip magic from its first byte on, takes a place for a member
only if decoding it yields a WARC header, and owns the records whose member starts inside its range; the last of them may
end beyond it. Archives are opened with `pyarrow.fs` by URI, so any store known there serves. A writing task names its file at
random and the manifest has only the files of tasks that succeeded; it is written to a table before anything is read.

Defined cases: a null payload is an empty one; a null page_id is written as no number and read as null; a null url is left out; rows
with equal page_id are records of their own; rows that share a group's largest page_id are all responses; a group without any
page_id has only responses; no rows give no archive and no records. The magic of a gzip member cannot occur in UTF-8 text, so a
stored copy of an archive inside a payload could only mislead a reader of binary payloads.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.llm.common import table
from shelfwatch.session import cut_lineage, scratch_path

RECORD_FIELDS = "page_id long, record_type string, refers_to long, target_uri string, payload_bytes long, payload_digest string"
MAGIC = b"\x1f\x8b\x08"
HEADER_LIMIT = 1 << 16


def mark_revisits(pages: DataFrame, least_bytes: int = 1000, salts: int = 16) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is the page that a revisit repeats, null for a response.

    Groups are found on digests only. The join that tells the members repeats each group's row `salts` times, so a payload that
    a third of all pages share is spread over as many tasks.
    """
    plain = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    plain = plain.withColumn("digest", F.sha1("payload")).withColumn("large", F.length("payload") >= least_bytes)
    groups = plain.where("large").groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1")
    groups = groups.select("digest", "head", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = plain.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    joined = salted.join(groups, ["digest", "salt"], "left")
    revisit = F.col("large") & F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("head")).alias("refers_to"))


def encode_record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record with its HTTP head; a revisit has the head only, whose Content-Length still is the payload's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(data: bytes) -> tuple[dict, bytes, bytes]:
    """Header fields, HTTP head and payload of a decompressed record."""
    end = data.index(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in data[:end].decode().split("\r\n")[1:])
    block = data[end + 4 : end + 4 + int(fields["Content-Length"])]
    cut = block.index(b"\r\n\r\n") + 4
    return fields, block[:cut], block[cut:]


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """The manifest (path, n_records, n_bytes) of the archives that hold `records` (page_id, url, payload, digest, refers_to)."""

    def write(batches):
        out, path, n, size = None, "", 0, 0
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                if out is None:
                    store, base = fs.FileSystem.from_uri(folder)
                    store.create_dir(base, recursive=True)
                    path = f"{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{base}/{path}", compression=None)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(encode_record(page_id, url, payload, digest, refers_to, date)) + packer.flush()
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "n_records": [n], "n_bytes": [size]})

    return cut_lineage(records.mapInArrow(write, "path string, n_records long, n_bytes long"))


def member_at(buffer: bytes, at: int) -> bool:
    """Whether decoding from here gives the head of a WARC record."""
    try:
        return zlib.decompressobj(31).decompress(buffer[at : at + HEADER_LIMIT], 5) == b"WARC/"
    except zlib.error:
        return False


def records_in(source, size: int, first: int, last: int, step: int = 1 << 20):
    """Decompressed records of the members that start in [first, last] of an open file."""
    base, buffer = first, b""

    def more() -> bool:
        nonlocal buffer
        got = source.read_at(min(step, size - base - len(buffer)), base + len(buffer)) if base + len(buffer) < size else b""
        buffer += got
        return bool(got)

    at, known = 0, False  # place in the buffer; whether a member is known to start here
    while base + at <= last:
        if not known:
            found = buffer.find(MAGIC, at)
            if found < 0:
                base, buffer, at = base + max(at, len(buffer) - 2), buffer[max(at, len(buffer) - 2) :], 0
                if not more():
                    return
                continue
            if base + found > last:
                return
            while len(buffer) - found < HEADER_LIMIT and more():
                pass
            if not member_at(buffer, found):
                at = found + 1
                continue
            at = found
        unpacker, parts = zlib.decompressobj(31), []
        rest = buffer[at:]
        while True:
            parts.append(unpacker.decompress(rest))
            if unpacker.eof:
                break
            base, buffer, at = base + len(buffer), b"", 0
            if not more():
                raise EOFError("the archive ends inside a record")
            rest = buffer
        at = len(buffer) - len(unpacker.unused_data)
        yield b"".join(parts)
        base, buffer, at = base + at, buffer[at:], 0
        if not buffer and not more():
            return
        while len(buffer) < HEADER_LIMIT and more():
            pass
        known = member_at(buffer, 0)


def read_archives(manifest: DataFrame, split_bytes: int = 8 << 20, payloads: bool = True) -> DataFrame:
    """The records of the archives named in `manifest`; with `payloads` also the payload (empty for a revisit)."""
    schema = RECORD_FIELDS + (", payload binary" if payloads else "")
    names = [f.split()[0] for f in schema.split(", ")]
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(split_bytes).cast("long")))
    ranges = manifest.where("n_bytes > 0").select("path", "n_bytes", starts.alias("first"))
    session = manifest.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)

    def number(text):
        digits = (text or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def read(batches):
        for batch in batches:
            for path, size, first in zip(*(batch.column(c).to_pylist() for c in ("path", "n_bytes", "first"))):
                store, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(name) as source:
                    for data in records_in(source, size, first, min(first + split_bytes, size) - 1):
                        fields, head, payload = decode_record(data)
                        full = fields["WARC-Type"] == "response"
                        digest = hashlib.sha1(payload).hexdigest() if full else fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if full and f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
                            raise ValueError(f"{path}: the payload of {fields['WARC-Record-ID']} doesn't have its digest")
                        length = len(payload) if full else int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
                        row = (number(fields["WARC-Record-ID"]), fields["WARC-Type"], number(fields.get("WARC-Refers-To")), fields.get("WARC-Target-URI"), length, digest)
                        rows.append(row + (payload,) if payloads else row)
                        held += len(payload)
                        if held > 16 << 20 or len(rows) >= 4096:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return ranges.repartition(tasks, "path", "first").mapInArrow(read, schema)


def store_uri(spark: SparkSession, path: str) -> str:
    """`path` as a URI with its scheme, as `pyarrow.fs` wants it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    records = mark_revisits(table(spark, folder, "pages"))
    manifest = write_archives(records, store_uri(spark, scratch_path(spark, "warc")))
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
q as (select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, sha1(html) as payload_digest from p),
g as (select payload_digest, max(page_id) as head from q where payload_bytes >= 1000 group by payload_digest)
select q.page_id, q.payload_bytes, q.payload_digest,
  case when g.head is not null and q.page_id is distinct from g.head then 'revisit' else 'response' end as record_type,
  case when g.head is not null and q.page_id is distinct from g.head then g.head end as refers_to
from q left join g on q.payload_bytes >= 1000 and q.payload_digest = g.payload_digest
"""
