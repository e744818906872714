"""Dictionary-compressed WARC archives (operator 10).

Each archive begins with a skippable frame that holds a Zstandard dictionary trained from its own records; every record
follows as a frame of its own, compressed with that dictionary. A task writes its rows into archives of about ``roll_bytes``; archive
names carry the task attempt, and only those named by the manifest count, so that a repeated task leaves nothing double.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, shared_dir

#: Fixed by the format: the skippable frame that holds a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
SMALL = 100


def with_record_types(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """id, url, payload, digest, first: the key of the response for a revisit, else null.

    Of equal payloads of at least SMALL bytes the smallest key is the response; rows that tie on it all are.
    Null keys come last: with no other key, equal payloads are all responses.
    """
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    copies = keep(
        rows.where(F.length("payload") >= SMALL).groupBy(F.col("digest").alias("same")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "first"),
        "copies",
    )
    # Revisits are found by id and digest; payloads meet them on both, so a common payload is spread over its ids.
    revisits = rows.select("id", "digest").join(copies, F.col("digest") == F.col("same")).where(~F.col("id").eqNullSafe(F.col("first"))).select(F.col("id").alias("r_id"), "same", "first").distinct()
    return rows.join(revisits, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("same")), "left").select("id", "url", "payload", "digest", "first")


def _record(id_, url, payload: bytes, digest: str, first, date: str) -> bytes:
    name = lambda x: f"<urn:page:{'none' if x is None else x}>"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {name(id_)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if first is None:
        body += payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(first)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def train_dictionary(records: list[bytes], size: int, sample_bytes: int) -> zstandard.ZstdCompressionDict:
    """A dictionary from records spread over the list, up to ``sample_bytes``; too few records serve as they are."""
    step = max(1, sum(map(len, records)) // sample_bytes)
    samples = [r[: 1 << 16] for r in records[::step]]
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:].ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_bytes(records: list[bytes], level: int = 3, size: int = 1 << 15, sample_bytes: int = 1 << 20):
    """The pieces of an archive: the frame with the dictionary, then one frame a record."""
    d = train_dictionary(records, size, sample_bytes)
    raw = d.as_bytes()
    yield struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw
    c = zstandard.ZstdCompressor(level=level, dict_data=d)
    for r in records:
        yield c.compress(r)


def _filesystem(folder: str):
    if folder.startswith(("s3a://", "s3n://")):  # Hadoop's names
        folder = "s3" + folder[3:]
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_archives(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", roll_bytes: int = 8 << 20) -> DataFrame:
    """Write (id, url, payload, digest, first) rows; the manifest: path, records, bytes."""

    def run(batches):
        store, base = _filesystem(folder)
        context = TaskContext.get()
        made = 0
        held: list[bytes] = []
        size = 0

        def flush():
            nonlocal made, held, size
            path = f"{base}/{context.partitionId():06d}-{context.taskAttemptId()}-{made:04d}.warc.zst"
            store.create_dir(base, recursive=True)
            written = 0
            with store.open_output_stream(path, compression=None) as out:
                for piece in archive_bytes(held):
                    out.write(piece)
                    written += len(piece)
            row = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(held)], pa.int64()), pa.array([written], pa.int64())], ["path", "records", "bytes"])
            made, held, size = made + 1, [], 0
            return row

        for batch in batches:
            for i in range(batch.num_rows):
                held.append(_record(*(c[i].as_py() for c in batch.columns), date))
                size += len(held[-1])
                if size >= roll_bytes:
                    yield flush()
        if held:
            yield flush()

    return keep(rows.select("id", "url", "payload", "digest", "first").mapInArrow(run, "path string, records long, bytes long"), "manifest")


def read_records(stream):
    """(header fields, payload) of each record of an archive, one at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    d = zstandard.ZstdCompressionDict(stream.read(size))
    plain = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=d).stream_reader(stream, read_across_frames=True), 1 << 16)
    while line := plain.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields = {}
        while (line := plain.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().partition(":")
            fields[k] = v.strip()
        body = plain.read(int(fields["Content-Length"]))
        if plain.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield fields, body.partition(b"\r\n\r\n")[2]


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """id, payload_bytes, payload_digest, record_type, refers_to of every record of the manifest's archives.

    Payloads of responses are hashed again; a difference from the digest in the header is an error.
    """
    number = lambda s: None if s is None or s.endswith(":none>") else int(s[10:-1])

    def run(batches):
        store, _ = _filesystem(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with store.open_input_stream(path, compression=None) as stream:
                    for f, payload in read_records(stream):
                        digest, length = f["WARC-Payload-Digest"].removeprefix("sha256:"), int(f["X-Payload-Length"])
                        if f["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{path}: the payload of {f['WARC-Record-ID']} is damaged")
                        rows.append((number(f["WARC-Record-ID"]), length, digest, f["WARC-Type"], number(f.get("WARC-Refers-To"))))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int64())], ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(parts).mapInArrow(run, "id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archive every row and read the archives back: key, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload, a null url an empty target; repeated rows and null keys each have their record. An empty
    table writes no archive. Other columns are not read. ``folder``: where archives go, by default a new one in the shared folder; any file
    system that pyarrow opens.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/pricewell-warc-{uuid.uuid4().hex}"
    manifest = write_archives(with_record_types(pages, key, url, html), folder)
    return read_archives(manifest, folder).withColumnRenamed("id", key)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN f.first IS NULL OR f.first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first <> page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
