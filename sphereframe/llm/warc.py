"""WARC archives through a chunked record table.

A record is a run of rows ``(record_id, chunk_no, ...)``; oversized payloads become several rows, each with the digest of the
payload up to its end, so no step after the read of the page holds a whole record.  On disk every row is one WARC 1.1
record: chunk 0 is the response or revisit, the others are its continuation segments.  Spark's text writer and reader do
the input and output: ``\\r\\n\\r\\nWARC/1.1\\r\\n`` separates rows, and chunks are cut so that no payload can contain it.
"""
from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of

CHUNK_BYTES = 1 << 20
REVISIT_BYTES = 1000
VERSION = "WARC/1.1"
BREAK = f"\r\n\r\n{VERSION}\r\n"

CHUNKS = ("record_id string, chunk_no int, page_id bigint, url string, record_type string, refers_to bigint, "
          "payload_bytes bigint, payload_digest string, running_digest string, last boolean, payload string")
RECORDS = ("record_id string, page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, "
           "payload_digest string, verified boolean")


def _sha1_base32(hexdigest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexdigest)).decode()


def _sha1_hex(text: str) -> str:
    return base64.b32decode(text.removeprefix("sha1:")).hex()


def cuts(data: memoryview, size: int) -> Iterator[tuple[int, int]]:
    """Chunks of at most ``size`` bytes: never within a code point, never with the version line inside."""
    n, at, mark = len(data), 0, VERSION.encode()
    while True:
        end = min(n, at + size)
        while end < n and end > at and (data[end] & 0xC0) == 0x80:
            end -= 1
        found = bytes(data[at:end]).find(mark)
        if found >= 0:
            end = at + found + 4
        yield at, end
        at = end
        if at >= n:
            return


def chunk_table(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, id_col: str = "page_id", url_col: str = "url",
                payload_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """The chunk rows of all pages.

    Of pages with equal payloads of at least ``revisit_bytes`` bytes the one with the largest id is the response and the
    others revisit it, without a payload; rows that share that id and payload are all responses.  Smaller payloads are
    responses.  A null payload is empty; a null id is below every other; a null address has no target line.
    """
    body = F.coalesce(pages[payload_col].cast("string"), F.lit(""))
    rows = pages.select(pages[id_col].cast("bigint").alias("page_id"), pages[url_col].cast("string").alias("url"),
                        body.alias("payload"), F.sha1(body.cast("binary")).alias("digest"),
                        F.octet_length(body).cast("bigint").alias("size"))
    # Ids of payloads that occur under several ids; partial aggregation meets large groups of copies first.
    first = (rows.where(F.col("size") >= revisit_bytes).groupBy("digest", "size")
             .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1")
             .select("digest", "size", "keeper"))
    typed = rows.join(first, ["digest", "size"], "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    typed = typed.select("page_id", "url", "digest", "size", F.when(revisit, F.col("keeper")).alias("refers_to"),
                         F.when(revisit, F.lit("")).otherwise(F.col("payload")).alias("payload"))

    schema = arrow_schema(CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        out, held = [], 0
        for batch in batches:
            page, url, digest, size, refers, payload = batch.columns
            for i in range(batch.num_rows):
                count += 1
                name = hashlib.sha1(f"{part}/{count}/{page[i]}/{digest[i]}".encode()).hexdigest()[:32]
                kind = "revisit" if refers[i].is_valid else "response"
                data = memoryview(payload[i].as_buffer() or b"").cast("B")
                running = hashlib.sha1()
                for k, (a, b) in enumerate(cuts(data, chunk_bytes)):
                    running.update(data[a:b])
                    out.append((name, k, page[i].as_py(), url[i].as_py(), kind, refers[i].as_py(), size[i].as_py(),
                                digest[i].as_py(), running.hexdigest(), b == len(data), bytes(data[a:b]).decode()))
                    held += b - a
                    if held >= 8 * CHUNK_BYTES or len(out) >= 2000:
                        yield batch_of(out, schema)
                        out, held = [], 0
        if out:
            yield batch_of(out, schema)
    return typed.mapInArrow(run, CHUNKS)


def _header(record_id, chunk_no, page_id, url, record_type, refers_to, size, digest, running, last, payload, date) -> str:
    lines = [f"WARC-Type: {'continuation' if chunk_no else record_type}",
             f"WARC-Record-ID: <urn:warc:{record_id}:{chunk_no}>", f"WARC-Date: {date}",
             f"WARC-Segment-Number: {chunk_no + 1}"]
    if chunk_no:
        lines.append(f"WARC-Segment-Origin-ID: <urn:warc:{record_id}:0>")
    if chunk_no and last:
        lines.append(f"WARC-Segment-Total-Length: {size}")
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if record_type == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: {_sha1_base32(digest)}", f"X-Payload-Length: {size}",
              f"X-Running-Digest: {_sha1_base32(running)}", f"X-Last-Segment: {'yes' if last else 'no'}",
              "Content-Type: text/html", f"Content-Length: {len(payload.encode())}"]
    return "\r\n".join(lines)


def write_archives(chunks: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """One gzip archive for each partition, committed by Spark's text writer."""
    def run(batches):
        for batch in batches:
            columns = batch.columns
            yield pa.RecordBatch.from_arrays([pa.array([
                _header(*(row := [c[i].as_py() for c in columns]), date) + "\r\n\r\n" + row[-1]
                for i in range(batch.num_rows)], pa.string())], names=["value"])
    # The first row of a file lacks the version line that the separator carries to all others.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    rows = chunks.mapInArrow(run, "value string")
    rows = rows.select(F.when(first, F.concat(F.lit(f"{VERSION}\r\n"), F.col("value"))).otherwise(F.col("value")).alias("value"))
    rows.write.option("lineSep", BREAK).text(path, compression="gzip")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk rows of written archives; any split of a file can be read alone."""
    schema = arrow_schema(CHUNKS)

    def run(batches):
        for batch in batches:
            out = []
            for line in batch.column(0):
                head, _, rest = line.as_py().removeprefix(f"{VERSION}\r\n").partition("\r\n\r\n")
                if not head:
                    continue
                h = dict(x.split(": ", 1) for x in head.split("\r\n"))
                name, _, number = h["WARC-Record-ID"].removeprefix("<urn:warc:").rstrip(">").partition(":")
                payload = rest.encode()[:int(h["Content-Length"])].decode()
                page, refers = h.get("X-Page-ID"), h.get("WARC-Refers-To")
                out.append((name, int(number), None if page is None else int(page), h.get("WARC-Target-URI"),
                            "revisit" if refers else "response", int(refers[10:-1]) if refers else None,
                            int(h["X-Payload-Length"]), _sha1_hex(h["WARC-Payload-Digest"]),
                            _sha1_hex(h["X-Running-Digest"]), h["X-Last-Segment"] == "yes", payload))
            yield batch_of(out, schema)
    return spark.read.option("lineSep", BREAK).text(path).mapInArrow(run, CHUNKS)


def _check(batches, schema):
    """Digest of each record from its chunks in order, one chunk at a time."""
    name, running, seen, whole = None, None, 0, True
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            rid, k, page, _, kind, refers, size, digest, so_far, last, payload = (c[i].as_py() for c in batch.columns)
            if rid != name:
                name, running, seen, whole = rid, hashlib.sha1(), 0, True
            data = payload.encode()
            running.update(data)
            seen, whole = seen + len(data), whole and running.hexdigest() == so_far
            if last and kind == "revisit":
                out.append((rid, page, kind, refers, size, digest, whole and not seen))
            elif last:
                out.append((rid, page, kind, refers, seen, running.hexdigest(), whole and seen == size
                            and running.hexdigest() == digest))
        yield batch_of(out, schema)


def records(chunks: DataFrame) -> DataFrame:
    """One row for each record, with size and digest counted from the chunks.

    Records of one chunk are checked where they are read; only the chunks of longer ones are brought together, sorted
    within partitions and streamed, so a record of any length needs the memory of one chunk.
    """
    schema = arrow_schema(RECORDS)

    def check(batches):
        return _check(batches, schema)
    short = (F.col("chunk_no") == 0) & F.col("last")
    long = chunks.where(~short).repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return chunks.where(short).mapInArrow(check, RECORDS).unionByName(long.mapInArrow(check, RECORDS))
