"""WARC archives: a writer with one gzip member per record, and a splittable reader.

Writer: each task streams its rows into one file below a shared folder, under a
name of its own, and renames it when it is whole. The manifest (path, size,
records) is itself a written table, so files of lost or repeated attempts are
never named by it.

Reader: every archive is cut into byte ranges; a task opens its range, searches
for the gzip magic, accepts a candidate only if it inflates to a WARC record
header and to the member's end with a valid checksum, and owns the records
whose first byte lies in its range, however far they extend beyond it. A range
may hold no start at all. What was read is counted and compared with the manifest.

Paths are opened with pyarrow's file systems (local or mounted folders, object
stores, HDFS where libhdfs is there).

Defined results: a null payload is empty; a null url writes no target URI and
reads as null; a null page_id is kept, sorts last when the first of equal
payloads is chosen, and reads as null; equal rows are written and read as often
as they occur (rows that share the smallest id are all responses); an empty
table gives no record; other columns are ignored.
Control characters in a url are percent-encoded, as a header line can't hold
them.
"""

from __future__ import annotations

import base64
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm import common as C

MAGIC = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:kinweave:page:"

MANIFEST = "path string, size long, records long"
RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("path", T.StringType()),
        T.StructField("offset", T.LongType()),
    ]
)


def open_store(path: str):
    """(file system, path inside it) of a URI, by pyarrow."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


# ---- writing -------------------------------------------------------------------


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, first (the id whose record holds the payload), is_first.

    Equal payloads of at least min_bytes share their smallest page_id's record.
    Only digests and ids are grouped; the payload rows meet a one-row-per-digest
    side in an equi-join that Spark may split where a digest is frequent.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    firsts = rows.groupBy("digest").agg(F.min("page_id").alias("first")).withColumnRenamed("digest", "d")
    joined = rows.join(firsts, F.col("digest") == F.col("d")).drop("d")
    small = F.octet_length("payload") < min_bytes
    return joined.withColumn("revisit", ~small & ~F.col("page_id").eqNullSafe(F.col("first")))


def record_bytes(page_id, url, payload: bytes, digest: bytes, refers_to, revisit: bool, date: str) -> bytes:
    """One record, not compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{ID_PREFIX}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
    ]
    if url is not None:
        safe = "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in url)
        head.append(f"WARC-Target-URI: {safe}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{ID_PREFIX}{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_warc(pages: DataFrame, directory: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", max_file_bytes: int = 1 << 30) -> DataFrame:
    """Write the archives into directory/archives; returns the manifest, a written table."""
    C.small_batches(pages.sparkSession)
    spark = pages.sparkSession
    archives = f"{directory.rstrip('/')}/archives"
    planned = plan_records(pages, min_bytes)

    def run(batches):
        import uuid

        import pyarrow as pa

        store, base = open_store(archives)
        store.create_dir(base, recursive=True)
        out = name = None
        size = records = 0
        done = []

        def close():
            out.close()
            store.move(f"{base}/.{name}", f"{base}/{name}")
            done.append((f"{archives}/{name}", size, records))

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "first", "revisit")]
            for row in zip(*(c for c in columns), strict=True):
                page_id, url, payload, digest, first, revisit = (x.as_py() for x in row)
                if out is None or size >= max_file_bytes:
                    if out is not None:
                        close()
                    name, size, records = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/.{name}", compression=None)
                member = gzip_member(record_bytes(page_id, url, payload, digest, first, revisit, date))
                out.write(member)
                size, records = size + len(member), records + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["path", "size", "records"])

    manifest = planned.mapInArrow(run, MANIFEST)
    manifest.write.parquet(f"{directory.rstrip('/')}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{directory.rstrip('/')}/manifest")


# ---- reading -------------------------------------------------------------------


class _Window:
    """Random access to a file in blocks, one block held."""

    def __init__(self, handle, size: int, block: int = 1 << 20):
        self.handle, self.size, self.block, self.at, self.data = handle, size, block, 0, b""

    def read(self, start: int, n: int) -> bytes:
        if start < self.at or start + n > self.at + len(self.data):
            self.handle.seek(start)
            self.at, self.data = start, self.handle.read(max(n, self.block))
        return self.data[start - self.at : start - self.at + n]

    def find(self, start: int, end: int) -> int:
        """First position in [start, end) where the magic begins, or -1."""
        while start < end:
            n = min(self.block, end - start) + len(MAGIC) - 1
            i = self.read(start, n).find(MAGIC)
            if i >= 0:
                return start + i if start + i < end else -1
            start += n - len(MAGIC) + 1
        return -1


def _parse_head(head: bytes):
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/1."):
        return None
    fields = {}
    for line in lines[1:]:
        k, sep, v = line.partition(b":")
        if not sep:
            return None
        fields[k.strip().lower()] = v.strip().decode("utf-8", "replace")
    return fields if fields.get(b"content-length", "").isdigit() and b"warc-type" in fields else None


def decode_member(window: _Window, start: int, size: int):
    """(fields, block, end of the member) if a whole WARC record begins at start, else None.

    What is inflated is checked at once to begin like a record, so that a false
    magic costs little; a header may have any length. The record is held in
    memory once.
    """
    z, whole, fields, pos, need, seen = zlib.decompressobj(31), bytearray(), None, start, None, 0
    try:
        while not z.eof:
            chunk = window.read(pos, min(1 << 16, size - pos))
            if not chunk:
                return None
            pos += len(chunk)
            whole += z.decompress(chunk)
            if fields is None:
                if not whole.startswith(b"WARC/1."[: len(whole)]):
                    return None
                at = whole.find(b"\r\n\r\n", seen)
                seen = max(0, len(whole) - 3)
                if at >= 0:
                    fields = _parse_head(bytes(whole[:at]))
                    if fields is None:
                        return None
                    need = at + 4 + int(fields[b"content-length"])
    except zlib.error:
        return None
    if fields is None or len(whole) < need:
        return None
    begin = need - int(fields[b"content-length"])
    return fields, bytes(whole[begin:need]), pos - len(z.unused_data)


def records_in(window: _Window, start: int, end: int, size: int):
    """(offset, fields, block) of the records that begin in [start, end)."""
    at = start
    while at < end:
        at = window.find(at, end)
        if at < 0:
            return
        got = decode_member(window, at, size)
        if got is None:
            at += 1
            continue
        yield at, got[0], got[1]
        at = got[2]


def _number(urn: str | None):
    tail = (urn or "").strip("<>").removeprefix(ID_PREFIX)
    return int(tail) if tail.lstrip("-").isdigit() else None


def complete(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """records as a written table, after each archive's number is compared with the manifest's; a difference is an error."""
    records = C.materialise(records, "warc-records")
    got = records.groupBy("path").agg(F.count("*").alias("got")).withColumnRenamed("path", "p")
    wrong = manifest.join(got, F.col("path") == F.col("p"), "left").where(F.col("records") != F.coalesce("got", F.lit(0))).select("path", "records", "got").take(3)
    if wrong:
        raise ValueError("archives whose records don't add up: " + "; ".join(f"{r['path']} has {r['got'] or 0} of {r['records']}" for r in wrong))
    return records


def read_warc(manifest: DataFrame, split_bytes: int = 8 << 20, with_payload: bool = True) -> DataFrame:
    """Records of the archives that manifest (path, size) names, by byte ranges of split_bytes; see complete()."""
    spark = manifest.sparkSession
    ranges = manifest.select("path", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes))).alias("start"))
    n = max(1, ranges.count())
    ranges = ranges.repartition(min(n, 100_000), "path", "start")
    schema = T.StructType([f for f in RECORDS if with_payload or f.name != "payload"])

    def run(batches):
        import hashlib

        import pyarrow as pa

        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "offset": pa.int64(), "payload": pa.binary()}
        names = schema.fieldNames()

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names)

        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "start")), strict=True):
                store, inner = open_store(path)
                rows, held = [], 0
                with store.open_input_file(inner) as handle:
                    for offset, fields, block in records_in(_Window(handle, size), start, min(start + split_bytes, size), size):
                        kind = fields[b"warc-type"]
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = fields.get(b"warc-payload-digest", "").removeprefix("sha1:")
                        if kind == "revisit":
                            length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
                            payload = None
                        else:
                            length = len(payload)
                            if digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
                                raise ValueError(f"{path} at {offset}: the payload doesn't match its digest")
                        rows.append({"page_id": _number(fields.get(b"warc-record-id")), "url": fields.get(b"warc-target-uri"), "record_type": kind, "payload_bytes": length, "payload_digest": digest, "refers_to": _number(fields.get(b"warc-refers-to")) if kind == "revisit" else None, "payload": payload, "path": path, "offset": offset})
                        held += len(payload or b"") if with_payload else 0
                        if held > 1 << 23 or len(rows) >= 5000:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return ranges.mapInArrow(run, schema)


def round_trip(pages: DataFrame, directory: str | None = None, min_bytes: int = 0, split_bytes: int = 8 << 20, with_payload: bool = False) -> DataFrame:
    directory = directory or C.scratch_dir(pages.sparkSession, "warc")
    manifest = write_warc(pages, directory, min_bytes)
    return complete(read_warc(manifest, split_bytes, with_payload), manifest)


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")
