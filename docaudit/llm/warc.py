"""WARC archives: a deterministic sharded writer and a reader.

Records are range-sorted by their row id: bytes are summed in equal slices of the id range and the running sums cut
the range into shards, so the same rows always give the same shards. One task writes a shard, record by record as
gzip members, into files that roll over at a compressed size. Files appear under temporary names; when all are
there a manifest is written, and only the files that it names are renamed to their final names. A task that runs
again writes the same bytes. Headers and digests are regenerated from the payload, never taken over.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docaudit.session import ship_package

from .common import keyed_join, written

#: Payload bytes of a shard (one task): about a ``SHARDS``-th of all within these limits. Compressed bytes at which a file rolls over.
SHARDS = 200
LEAST_SHARD_BYTES, SHARD_BYTES = 1 << 20, 256 << 20
FILE_BYTES = 16 << 20
#: Repeated payloads up to this number (about 40 bytes each) may be broadcast to mark their rows.
FEW_GROUPS = 500_000
#: Slices of the id range in which bytes are summed.
SLICES = 1 << 16
#: Payloads below this size are never revisits.
REVISIT_BYTES = 1_000
#: Date of all records, as they carry none of their own; equal runs give equal bytes.
DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 4

MANIFEST = "file string, temporary string, shard int, part int, records long, bytes long, sha1 string"
RECORD = "row_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"


def record_id(row_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{row_id}:{digest}')}>"


def target_uri(url: str | None, row_id: int | None) -> str:
    """A header-safe URI: white space and control characters are percent-encoded; without a url, the row's own."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:row:{'' if row_id is None else row_id}"


def encode_record(row_id: int | None, url: str | None, payload: bytes | None, size: int, sha1: bytes, refers_to: int | None) -> bytes:
    """One record. ``payload`` is None for a revisit, whose ``size`` and ``sha1`` are those of the full payload."""
    digest = "sha1:" + base64.b32encode(sha1).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: {record_id(row_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target_uri(url, row_id)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"Content-Length: {len(block)}",
    ]
    if row_id is not None:
        head.append(f"X-Row-Id: {row_id}")
    if payload is None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Row-Id: {refers_to}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "replace") + block + b"\r\n\r\n"


class Rolling:
    """Files of one shard, each closed once it holds ``limit`` compressed bytes."""

    def __init__(self, fs: pafs.FileSystem, folder: str, shard: int, limit: int):
        self.fs, self.folder, self.shard, self.limit = fs, folder, shard, limit
        self.part, self.attempt, self.stream = -1, uuid.uuid4().hex, None

    def add(self, record: bytes) -> Iterator[tuple]:
        if self.stream is None:
            self.part += 1
            self.name = f"records-{self.shard:07d}-{self.part:05d}.warc.gz"
            self.temporary = f"{self.name}.{self.attempt}"
            self.stream = self.fs.open_output_stream(f"{self.folder}/temporary/{self.temporary}", compression=None)
            self.count, self.size, self.sha1 = 0, 0, hashlib.sha1()
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)  # no time, no name: equal records give equal bytes
        member = packer.compress(record) + packer.flush()
        self.stream.write(member)
        self.sha1.update(member)
        self.count += 1
        self.size += len(member)
        if self.size >= self.limit:
            yield self.close()

    def close(self) -> tuple:
        self.stream.close()
        self.stream = None
        return self.name, self.temporary, self.shard, self.part, self.count, self.size, self.sha1.hexdigest()


def _shards(meta: DataFrame, shard_bytes: int) -> DataFrame:
    """``slice`` -> ``shard``: slices of the id range in order, cut where the running bytes pass a multiple of ``shard_bytes``.

    There are at most ``SLICES`` slices; running sums go over blocks of slices and then over the slices of a block.
    """
    block = F.expr("slice div 256")
    sums = meta.groupBy("slice").agg(F.sum("size").alias("bytes")).withColumn("block", block)
    earlier = F.coalesce(F.sum("b").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sums.groupBy("block").agg(F.sum("bytes").alias("b")).select("block", earlier.alias("earlier"))
    within = F.coalesce(F.sum("bytes").over(Window.partitionBy("block").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = sums.withColumn("within", within).join(F.broadcast(blocks), "block")
    return cut.select("slice", F.floor((F.col("earlier") + F.col("within")) / shard_bytes).cast("int").alias("shard"))


def write_archives(df: DataFrame, folder: str, key: str, payload: str, url: str | None = None, shard_bytes: int | None = None) -> DataFrame:
    """Write a record of every row of ``df`` below the shared ``folder`` and return the manifest.

    ``payload`` is a string column, stored in UTF-8; null counts as empty. Of payloads that are equal and have at
    least ``REVISIT_BYTES`` bytes, the row with the largest key is the response and the others revisit it; rows that
    repeat that key with that payload are responses too. Null keys come first; they are revisits where a row with a
    key has their payload, else responses. Other columns are not archived. An empty table gives an empty manifest.
    """
    spark = df.sparkSession
    ship_package(spark)
    uri = F.col(url) if url else F.lit(None).cast("string")
    data = F.coalesce(F.encode(payload, "UTF-8"), F.lit("").cast("binary"))
    rows = df.select(F.col(key).cast("long").alias("row_id"), uri.alias("url"), data.alias("data")).select(
        "row_id", "url", "data", F.length("data").cast("long").alias("size"), F.unhex(F.sha1("data")).alias("sha1")
    )
    narrow = written(rows.select("row_id", "size", "sha1"), "warc-digests")
    ends = narrow.agg(F.min("row_id").alias("lo"), F.max("row_id").alias("hi"), F.sum("size").alias("bytes")).first()
    lo, hi = ends["lo"] or 0, ends["hi"] or 0
    # A width that grows with the range only; a null key lies before all others.
    slice_ = F.when(F.col("row_id").isNull(), -1).otherwise(F.expr(f"(row_id - {lo}) div {(hi - lo) // SLICES + 1}")).cast("int")
    shard_bytes = shard_bytes or min(SHARD_BYTES, max(LEAST_SHARD_BYTES, (ends["bytes"] or 0) // SHARDS))
    shards = written(_shards(narrow.withColumn("slice", slice_), shard_bytes), "warc-shards")

    large = narrow.filter(F.col("size") >= REVISIT_BYTES).groupBy("sha1").agg(F.max("row_id").alias("response"), F.count("*").alias("n"))
    groups = written(large.filter("n > 1 AND response IS NOT NULL").select("sha1", "response"), "warc-groups")
    marked = keyed_join(rows, groups, "sha1", few=FEW_GROUPS)
    again = (F.col("size") >= REVISIT_BYTES) & F.col("response").isNotNull() & ~F.col("row_id").eqNullSafe(F.col("response"))
    records = (
        marked.withColumn("slice", slice_).join(F.broadcast(shards), "slice")
        .select("shard", "row_id", "url", F.when(~again, F.col("data")).alias("data"), "size", "sha1", F.when(again, F.col("response")).alias("refers_to"))
        .repartition("shard")
        .sortWithinPartitions("shard", F.col("row_id").asc_nulls_first(), "sha1", "url")
    )
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(f"{path}/temporary", recursive=True)
    fs.create_dir(f"{path}/archives", recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, files, names = None, [], [f.split()[0] for f in MANIFEST.split(", ")]
        own, top = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for shard, *record in zip(*[b.column(i).to_pylist() for i in range(7)], strict=True):
                if out is None or out.shard != shard:
                    if out is not None and out.stream is not None:
                        files.append(out.close())
                    out = Rolling(own, top, shard, FILE_BYTES)
                files += out.add(encode_record(*record))
        if out is not None and out.stream is not None:
            files.append(out.close())
        columns = list(zip(*files, strict=True)) or [()] * len(names)
        kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[f.split()[1]] for f in MANIFEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    records.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return commit(spark, folder)


def commit(spark: SparkSession, folder: str) -> DataFrame:
    """Give the files of the manifest their final names, check their sizes, and return the manifest. Can be repeated."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name, temporary, size in zip(*[b.column(c).to_pylist() for c in ("file", "temporary", "bytes")], strict=True):
                source, target = fs.get_file_info([f"{top}/temporary/{temporary}", f"{top}/archives/{name}"])
                if source.type != pafs.FileType.NotFound:
                    if target.type != pafs.FileType.NotFound:
                        fs.delete_file(target.path)
                    fs.move(source.path, target.path)
                if fs.get_file_info(target.path).size != size:
                    raise OSError(f"{name} is not the file that the manifest names")
            yield b

    manifest.mapInArrow(rename, MANIFEST).agg(F.sum("bytes")).collect()
    return manifest


def parse_archive(content: bytes, with_payload: bool = True) -> Iterator[tuple]:
    """Records of one archive file; every payload and block digest is computed again and compared."""
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as f:
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError("no WARC record where one should start")
            head = {}
            while (line := f.readline().rstrip(b"\r\n")):
                name, _, value = line.decode("utf-8").partition(":")
                head[name.strip().lower()] = value.strip()
            block = f.read(int(head["content-length"]))
            f.read(4)
            http, _, payload = block.partition(b"\r\n\r\n")
            size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
            sha1 = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:"))
            full = head["warc-type"] == "response"
            if full and (len(payload) != size or hashlib.sha1(payload).digest() != sha1):
                raise ValueError(f"the payload of {head['warc-record-id']} differs from its digest")
            if "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != head["warc-block-digest"]:
                raise ValueError(f"the block of {head['warc-record-id']} differs from its digest")
            own, other = head.get("x-row-id"), head.get("x-refers-to-row-id")
            yield (
                None if own is None else int(own), size, sha1.hex(), head["warc-type"], None if other is None else int(other),
                head["warc-target-uri"], payload if full and with_payload else None,
            )


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """All records of the committed archives below ``folder``; payloads of revisits are null, as are all without ``with_payload``."""
    ship_package(spark)
    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").load(f"{folder}/archives")
    kinds = [{"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}[f.split()[1]] for f in RECORD.split(", ")]
    names = [f.split()[0] for f in RECORD.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                columns = list(zip(*parse_archive(content.as_py(), with_payload), strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return files.select("content").mapInArrow(parse, RECORD)
