"""WARC archives: written by tasks into the shared folder, indexed first, read by coalesced byte ranges."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = "page_id long, url string, file string, offset long, length long, record_type string, payload_digest string, refers_to long"
RECORD = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long"


#: Up to this many digests (100 bytes each) go to every task.
BROADCAST_DIGESTS = 500_000


def store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1) if folder.startswith("file:") else f"file://{folder}")


def with_record_types(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type, refers_to: one row for each row of pages.

    Of rows with equal html of at least `least` bytes, that with the smallest page_id is a response and others revisit
    it; of repeated rows with that page_id all are responses. A null page_id comes last; where all are null, all are
    responses. Null html is an empty payload. Only digests are shuffled, counted before; those of two or more pages are
    joined back by broadcast up to BROADCAST_DIGESTS of them, so payloads stay where they are, beyond that by shuffle.
    Html of any length is one payload; other columns play no part.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("payload_digest", F.sha2("payload", 256))
    groups = p.filter(F.octet_length("payload") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = cut(groups.filter("n > 1").drop("n"), "repeated")
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_DIGESTS else groups
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return p.join(groups, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to")
    )


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, date: str) -> bytes:
    """One record, compressed as a gzip member of its own."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    block = HTTP + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write_archives(typed: DataFrame, folder: str | None = None, roll: int = 64 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the rows of with_record_types() as .warc.gz files and return the index: INDEX.

    A task writes files of its own (their names hold partition and attempt) and rolls over at `roll` bytes; the index is
    written too and names only files of tasks that succeeded, so a task that ran twice leaves an unread file, no error.
    """
    folder = folder or f"{shared_dir(typed.sparkSession)}/warc-{uuid.uuid4().hex}"

    def run(batches):
        where, root = store(folder)
        where.create_dir(root, recursive=True)
        task = TaskContext.get()
        out, rows, at, n = None, [], 0, 0
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    name, at = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}.warc.gz", 0
                    out, n = where.open_output_stream(f"{root}/{name}", compression=None), n + 1
                data = record(r["page_id"], r["url"], r["payload"], r["payload_digest"], r["record_type"], r["refers_to"], date)
                out.write(data)
                rows.append((r["page_id"], r["url"], name, at, len(data), r["record_type"], r["payload_digest"], r["refers_to"]))
                at += len(data)
                if at >= roll:
                    out.close()
                    out = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=[x.split()[0] for x in INDEX.split(", ")])
                rows = []
        if out is not None:
            out.close()

    index = typed.select(F.col("page_id").cast("long"), "url", "payload", "payload_digest", "record_type", F.col("refers_to").cast("long"))
    return cut(index.mapInArrow(run, INDEX), "warc-index").withColumn("folder", F.lit(folder))


def parse(data: bytes) -> tuple:
    """(page_id, type, payload bytes, digest, refers_to) of one uncompressed record; a revisit's bytes are null."""
    head, _, rest = data.partition(b"\r\n\r\n")
    h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(h["Content-Length"])]
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x)) else None
    if h["WARC-Type"] == "revisit":
        return number(h["WARC-Record-ID"]), "revisit", None, h["WARC-Payload-Digest"].removeprefix("sha256:"), number(h["WARC-Refers-To"])
    payload = block.partition(b"\r\n\r\n")[2]
    return number(h["WARC-Record-ID"]), h["WARC-Type"], len(payload), hashlib.sha256(payload).hexdigest(), None


def read_records(selected: DataFrame, gap: int = 64 << 10, most: int = 4 << 20) -> DataFrame:
    """Read the records of index rows back: RECORD, payload length and digest computed from the bytes read.

    Rows of one file are sorted by offset; neighbours closer than `gap` bytes in the same stretch of `most` bytes become
    one read, so a task holds `most` bytes and one record beyond. Stretches are dealt out by the bytes to read. A revisit's length is that of the response it refers to.
    """
    n = max(1, -(-(selected.agg(F.sum("length")).first()[0] or 0) // (2 * most)))  # tasks by the bytes they will read
    stretch = selected.withColumn("stretch", F.floor(F.col("offset") / most)).groupBy("folder", "file", "stretch").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("ranges")).repartition(n)

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                where, root = store(r["folder"])
                with where.open_input_file(f"{root}/{r['file']}") as f:
                    todo = [(x["offset"], x["length"]) for x in r["ranges"]]
                    k = 0
                    while k < len(todo):
                        first = k
                        while k + 1 < len(todo) and todo[k + 1][0] - sum(todo[k]) <= gap:
                            k += 1
                        k, start = k + 1, todo[first][0]
                        data = memoryview(f.read_at(sum(todo[k - 1]) - start, start))
                        rows += [parse(zlib.decompress(data[o - start : o - start + n], 31)) for o, n in todo[first:k]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=[x.split()[0] for x in RECORD.split(", ")])

    read = cut(stretch.mapInArrow(run, RECORD), "warc-records")
    lengths = read.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("known")).distinct()
    revisits = read.filter("record_type = 'revisit'").join(lengths, ["refers_to", "payload_digest"], "left").withColumn("payload_bytes", F.col("known"))
    return read.filter("record_type <> 'revisit'").unionByName(revisits.select(read.columns))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back through the index."""
    return read_records(write_archives(with_record_types(spark.read.parquet(f"{sf_dir}/pages.parquet"))))


ORACLE = """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id <> f THEN f END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY sha256(coalesce(html, ''))) AS f FROM pages)
"""
