"""Deterministic sharded WARC writer and reader.

Records are range-sorted by their key; each task writes its range to gzip members (one per
record) and rolls to a new file when the compressed size passes ``roll_bytes``.  Headers, record
ids, digests and the (fixed) date are made anew from the content, so the same rows and ranges
give the same bytes.  A file is written under a temporary name of the task attempt and renamed
when complete; the rows about finished files form the manifest, which Spark commits as Parquet.
Readers open only what the manifest names, so half-written files of lost or repeated attempts
are never seen.

Of records with equal payloads of at least ``dedupe_bytes`` bytes the one with the largest key is
the response, the others are revisits that refer to it.  That decision is made on narrow rows
(key, digest, size); it meets its record in the writer, because both streams are sorted by the
same ranges, so payloads are shuffled once.

Files go to a folder under the shared checkpoint folder through pyarrow's file systems.

Defined cases: a NULL payload is empty, and empty or short payloads are all responses.  Repeated
rows with one key and payload that is its group's largest key are all responses; a NULL key is
smaller than any other, and its revisits still refer to the response.  Any further columns are
not read.  An empty table writes no file and reads back no row.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.llm.common import shared_folder, ship_package

DATE = "2000-01-01T00:00:00Z"           # fixed: equal input gives equal bytes
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("n_records", T.LongType()),
    T.StructField("n_bytes", T.LongType()), T.StructField("sha256", T.StringType())])
RECORDS = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("refers_to", T.LongType()),
    T.StructField("payload", T.BinaryType())])


# ------------------------------------------------------------------ records
def record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{key} {digest}')}>"


def _plain(text: str) -> str:
    """A URI as it is, but for control characters, which a header can't hold."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def _line(text: str) -> str:
    """A header value: control characters and the escape itself percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", text)


def _unline(text: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), text)


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """One gzip member with no time and no name in its header."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def record(key: int | None, url: str | None, payload: bytes, digest: str,
           refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record: an HTTP response with the payload, or of a revisit its head alone with the
    payload's digest and size.  A URI with control characters stands in ``X-Target-URI``, too, escaped."""
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body += b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {record_id(key, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_plain(url)}")
        if _plain(url) != url:
            head.append(f"X-Target-URI: {_line(url)}")
    head.append(f"WARC-Block-Digest: sha1:{hashlib.sha1(body).hexdigest()}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if key is not None:
        head.append(f"X-Record-Key: {key}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}",
                 f"X-Refers-To-Key: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def info_record(name: str) -> bytes:
    """The record that opens a file."""
    body = b"software: ledgerscope\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(None, name)}", f"WARC-Date: {DATE}",
            f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, content) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    h = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    n = int(h["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError(f"record {h.get('WARC-Record-ID')}: wrong length")
    return h, rest[:n]


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The uncompressed gzip members of a binary stream, one after the other."""
    d, parts, data = zlib.decompressobj(31), [], b""
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                break
        parts.append(d.decompress(data))
        data = b""
        if d.eof:
            yield b"".join(parts)
            data = d.unused_data
            d, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("archive ends inside a record")


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """(pyarrow file system, path in it) of a Spark path."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


# ------------------------------------------------------------------ writer
class ShardWriter:
    """Files of one task: members in, finished files out as manifest rows."""

    def __init__(self, folder: str, shard: int, attempt: int, roll_bytes: int):
        self.fs, self.folder = file_system(folder)
        self.shard, self.attempt, self.roll_bytes = shard, attempt, roll_bytes
        self.roll, self.out = 0, None

    def _open(self) -> None:
        self.name = f"part-{self.shard:06d}-{self.roll:05d}.warc.gz"
        self.temp = f"{self.folder}/.{self.name}.{self.attempt}.tmp"
        self.out = self.fs.open_output_stream(self.temp, compression=None)
        self.n, self.size, self.sha = 0, 0, hashlib.sha256()
        self._put(gzip_member(info_record(self.name)))

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)

    def write(self, member: bytes) -> Iterator[tuple]:
        if self.out is None:
            self._open()
        self._put(member)
        self.n += 1
        if self.size >= self.roll_bytes:
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        """Give the finished file its name; yields its manifest row."""
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temp, f"{self.folder}/{self.name}")
            yield self.name, self.n, self.size, self.sha.hexdigest()
            self.out, self.roll = None, self.roll + 1


def decisions(rows: DataFrame, dedupe_bytes: int) -> DataFrame:
    """``key, digest, refers_to`` of the revisits (narrow rows in, narrow rows out)."""
    big = rows.where(F.col("n_bytes") >= dedupe_bytes)
    last = (big.groupBy("digest").agg(F.max("key").alias("refers_to"), F.count(F.lit(1)).alias("n"))
            .where((F.col("n") > 1) & F.col("refers_to").isNotNull()).drop("n"))
    return (big.join(last, "digest")
            .where(F.col("key").isNull() | (F.col("key") < F.col("refers_to")))
            .select("key", "digest", "refers_to").distinct())


def key_bounds(narrow: DataFrame, shards: int, per_shard: int = 100) -> list[int]:
    """At most ``shards - 1`` ascending keys that cut the rows into even ranges: quantiles of the keys of
    lowest hash (about ``per_shard`` a shard), which depend on the keys alone and not on how they
    are dealt out."""
    keys = narrow.where(F.col("key").isNotNull()).select("key").distinct()
    n = keys.count()
    if shards < 2 or not n:
        return []
    step = max(1, n // (per_shard * shards))
    chosen = sorted(r["key"] for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(step)) == 0).collect())
    return sorted({chosen[len(chosen) * i // shards] for i in range(1, shards)}) if chosen else []


def shard_of(key: Column, bounds: list[int]) -> Column:
    """Number of the bounds that a key has reached, by bisection; NULL keys belong to the first shard."""
    def split(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < bounds[mid], split(lo, mid)).otherwise(split(mid + 1, hi))
    return F.when(key.isNull(), 0).otherwise(split(0, len(bounds)))


def write_warc(rows: DataFrame, folder: str, key: str = "page_id", url: str = "url",
               payload: str = "html", dedupe_bytes: int = 1000, roll_bytes: int = 256 << 20,
               shards: int | None = None) -> DataFrame:
    """Write every row as a record under ``folder`` and return the committed manifest.

    ``shards``: number of key ranges (default: Spark's shuffle partitions).  Their bounds come from the
    keys, so equal tables give equal files however their rows are dealt out.
    """
    spark = rows.sparkSession
    ship_package(spark)
    body = F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b""))
    src = rows.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"),
                      body.alias("payload"))
    narrow = src.select("key", F.sha1("payload").alias("digest"),
                        F.octet_length("payload").cast("long").alias("n_bytes"))
    revisits = decisions(narrow, dedupe_bytes)
    # order inside a key: decisions (kind 0) before records (kind 1), so the writer has both
    both = (revisits.select("key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"),
                            F.lit(None).cast("binary").alias("payload"), "digest", "refers_to")
            .unionByName(src.select("key", F.lit(1).alias("kind"), "url", "payload",
                                    F.sha1("payload").alias("digest"),
                                    F.lit(None).cast("long").alias("refers_to"))))
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    shard = shard_of(F.col("key"), key_bounds(narrow, shards))
    ranged = (both.withColumn("_shard", shard).repartitionById(shards, F.col("_shard")).drop("_shard")
              .sortWithinPartitions("key", "kind", "digest", "url"))
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        out = ShardWriter(folder, ctx.partitionId(), ctx.taskAttemptId(), roll_bytes)
        refer: dict[tuple, int] = {}
        at: object = refer             # the key that ``refer`` is about
        done: list[tuple] = []
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(6)]
            for k, kind, u, data, digest, to in zip(*cols, strict=True):
                if k != at:
                    refer.clear()
                    at = k
                if kind == 0:
                    refer[digest] = to
                    continue
                to = refer.get(digest)
                done += out.write(gzip_member(record(k, u, data, digest, to, to is not None)))
        done += out.close()
        if done:
            yield pa.RecordBatch.from_pylist(
                [dict(zip(MANIFEST.names, r, strict=True)) for r in done],
                schema=pa.schema([("path", pa.string()), ("n_records", pa.int64()),
                                  ("n_bytes", pa.int64()), ("sha256", pa.string())]))

    ranged.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


# ------------------------------------------------------------------ reader
def read_warc(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives that the manifest of ``folder`` names.

    Content is checked: the digest of a response's payload, the record count and the checksum
    of each file.  ``payload_digest`` and ``payload_bytes`` are of the full payload; a revisit's
    are those of the payload it refers to.
    """
    ship_package(spark)
    manifest = read_manifest(spark, folder)
    # a count of its own: the manifest is tiny, and Spark would merge it into one task
    files = manifest.repartition(max(1, 2 * manifest.count()), "path")
    width = 7 if with_payload else 6
    schema = T.StructType(RECORDS.fields[:width])

    def rows_of(path: str, n: int, sha: str) -> Iterator[tuple]:
        fs, base = file_system(folder)
        seen, digest = 0, hashlib.sha256()
        with fs.open_input_stream(f"{base}/{path}", compression=None) as f:

            class Tee:
                @staticmethod
                def read(k: int) -> bytes:
                    data = f.read(k)
                    digest.update(data)
                    return data

            for data in members(Tee):
                h, body = parse(data)
                if h["WARC-Type"] == "warcinfo":
                    continue
                if hashlib.sha1(body).hexdigest() != h["WARC-Block-Digest"].removeprefix("sha1:"):
                    raise ValueError(f"{path}: digest of the block of {h['WARC-Record-ID']} doesn't match")
                body = body.partition(b"\r\n\r\n")[2]
                name = h["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = h["WARC-Type"]
                if kind == "response" and hashlib.sha1(body).hexdigest() != name:
                    raise ValueError(f"{path}: digest of {h['WARC-Record-ID']} doesn't match")
                k, to, u = h.get("X-Record-Key"), h.get("X-Refers-To-Key"), h.get("WARC-Target-URI")
                u = _unline(h["X-Target-URI"]) if "X-Target-URI" in h else u
                row = (None if k is None else int(k), u, kind, name,
                       int(h["X-Payload-Length"]), None if to is None else int(to), body)
                seen += 1
                yield row[:width]
        if seen != n or digest.hexdigest() != sha:
            raise ValueError(f"{path}: differs from its manifest")

    arrow = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema(list(zip(schema.names, arrow, strict=False)))

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)],
                schema=kinds)

        rows: list[tuple] = []
        for b in batches:
            for m in b.to_pylist():
                for r in rows_of(m["path"], m["n_records"], m["sha256"]):
                    rows.append(r)
                    if len(rows) >= 500:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    return files.mapInArrow(run, schema)


def write_and_read(rows: DataFrame, with_payload: bool = False, **options) -> DataFrame:
    """Write ``rows`` to a new folder under the shared checkpoint folder and read them back."""
    spark = rows.sparkSession
    folder = shared_folder(spark, "warc")
    write_warc(rows, folder, **options)
    return read_warc(spark, folder, with_payload)
