"""Deterministic sharded WARC archives (operator 3).

Records are range-sorted, and the ranges are cut where the sizes of the payloads
before a record pass equal steps, so shards follow from the pages alone and not
from how they lie in files or partitions.  Each shard writes gzip members (one a
record) into files that roll at a compressed size; headers and digests are computed
anew from the payload.  Files are written under temporary names and get their own
when they are whole; the manifest, one row a file, is written last and is what makes
a set of files an archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.files import Committed, open_fs
from tessera.llm.ordering import cuts, number
from tessera.llm.scratch import Scratch, partitions

#: fixed values: the format
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

MANIFEST = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, html: str | None, first: int | None, date: str) -> bytes:
    """A whole record before compression.  ``first``: the page whose payload this one repeats, or None."""
    payload = (html or "").encode()
    http = HTTP % len(payload)
    block = http if first is not None else http + payload
    name = lambda i: f"<urn:x-page:{i}>"
    target = "".join(c for c in (url or f"urn:x-page:{page_id}") if c >= " ")
    head = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date), ("WARC-Target-URI", target)]
    if first is not None:
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", name(first))]
    head += [("WARC-Payload-Digest", "sha1:" + digest(payload)), ("WARC-Block-Digest", "sha1:" + digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member; its header has no time and no name, so equal records give equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Roll:
    def __init__(self, store, base: str, shard: int, seq: int):
        self.shard, self.seq, self.name = shard, seq, f"shard-{shard:06d}-{seq:05d}.warc.gz"
        self.file = Committed(store, f"{base}/{self.name}")
        self.records = self.bytes = 0
        self.sum = hashlib.sha256()

    def write(self, data: bytes) -> None:
        self.file.sink.write(data)
        self.sum.update(data)
        self.records, self.bytes = self.records + 1, self.bytes + len(data)

    def close(self) -> pa.RecordBatch:
        self.file.commit()
        return pa.RecordBatch.from_pylist([{"shard": self.shard, "seq": self.seq, "name": self.name, "records": self.records, "bytes": self.bytes, "sha256": self.sum.hexdigest()}], schema=MANIFEST)


def _writer(root: str, roll_bytes: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_fs(root)
        current: _Roll | None = None
        try:
            for batch in batches:
                for shard, *row in zip(*[batch.column(c).to_pylist() for c in ("shard", "page_id", "url", "html", "first")], strict=True):
                    data, seq = member(record(*row, date)), 0
                    if current and (current.shard != shard or current.bytes + len(data) > roll_bytes):
                        seq = current.seq + 1 if current.shard == shard else 0
                        yield current.close()
                        current = None
                    if current is None:
                        current = _Roll(store, base, shard, seq)
                    current.write(data)
            if current:
                yield current.close()
                current = None
        finally:
            if current:
                current.file.abort()

    return write


def write_archives(pages: DataFrame, root: str, scratch: Scratch, roll_bytes: int = 64 << 20, shard_bytes: int = 64 << 20, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write all ``pages`` (page_id, url, html) below ``root``; returns the manifest, which is beside the files.

    Of pages with equal payloads of at least ``least`` bytes, the one with the
    smallest page_id is a response and the others revisit it.  Payloads are told
    apart by SHA-256; only those that occur more than once are joined back.  Pages of
    one id are in the order of a hash of url and payload; those that are equal in all
    three go to one shard.
    """
    spark = pages.sparkSession
    store, base = open_fs(root)
    store.create_dir(base, recursive=True)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("_key"))
    rows = rows.withColumn("_tie", F.xxhash64("_key", F.coalesce("url", F.lit("")), F.col("url").isNull()))
    groups = rows.where(F.octet_length("html") >= least).groupBy("_key").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # written, so that Spark knows its size and may broadcast it, or split a payload that many pages share
    repeated = scratch.table(groups.where("n > 1").drop("n"), "repeated")
    keys = ["page_id", "_tie"]
    found = cuts(rows.withColumn("size", F.octet_length("html").cast("long")), keys, "size", shard_bytes, scratch)
    marked = rows.join(repeated, "_key", "left").withColumn("first", F.when(F.col("page_id") > F.col("first"), F.col("first"))).withColumn("shard", number(rows, keys, found).cast("int"))
    n = max(1, min(len(found), 4 * partitions(spark)))
    # a shard is one task's, and a task may have several
    ranges = marked.repartitionById(n, F.col("shard") % n).sortWithinPartitions("shard", *keys, "_key", "url").select("shard", "page_id", "url", "html", "first")
    ranges.mapInArrow(_writer(root, roll_bytes, date), "shard int, seq int, name string, records long, bytes long, sha256 string").write.mode("overwrite").parquet(f"{root}/manifest")
    return spark.read.parquet(f"{root}/manifest")


def members(f) -> Iterator[bytes]:
    """The records of an open archive, a chunk of the file at a time."""
    z, out = zlib.decompressobj(31), []
    while chunk := f.read(1 << 16):  # small, as what follows a record in its chunk is copied
        while chunk:
            out.append(z.decompress(chunk))
            chunk = z.unused_data if z.eof else b""
            if z.eof:
                yield b"".join(out)
                z, out = zlib.decompressobj(31), []
    if any(out):
        raise ValueError("the archive ends inside a record")


def parse(data: bytes) -> dict:
    """Fields of a record; digests of what is stored are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    if version.encode() != VERSION or fields["WARC-Block-Digest"] != "sha1:" + digest(block):
        raise ValueError("damaged record")
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or digest(payload) != stated):
        raise ValueError("damaged payload")
    number = lambda s: None if s is None or s == "<urn:x-page:None>" else int(s[len("<urn:x-page:") : -1])
    return {"page_id": number(fields["WARC-Record-ID"]), "payload_bytes": length, "payload_digest": stated, "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")), "url": fields["WARC-Target-URI"]}


def _read(root: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_fs(root)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                held: list[dict] = []
                with store.open_input_file(f"{base}/{name}") as f:
                    for data in members(f):
                        held.append(parse(data))
                        if len(held) >= 5000:
                            yield pa.RecordBatch.from_pylist(held, schema=RECORD)
                            held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=RECORD)

    return read


def read_archives(manifest: DataFrame, root: str) -> DataFrame:
    n = max(1, manifest.count())  # a task for each file
    return manifest.select("shard", "seq", "name").repartitionByRange(n, "shard", "seq").mapInArrow(_read(root), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write all ``pages`` and read them back, one row a record.

    A null html is an empty payload, and empty payloads are equal to each other.  A
    null url becomes the page's own name.  Pages without an id sort first and are
    responses.  Rows that repeat the smallest page_id of a payload are responses
    too.  An empty table gives no files and an empty result; other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    root = scratch.path("archives")
    return read_archives(write_archives(pages, root, scratch), root).drop("url")
