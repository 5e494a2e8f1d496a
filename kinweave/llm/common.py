"""Shared pieces: scratch tables in the cluster's shared folder, and numpy views of Arrow text."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Lists that scratch paths are kept in for their owners to sweep, the innermost last; none outside collecting(). (A plain list: this module goes to workers by value.)
_owners: list[list[str]] = []


@contextlib.contextmanager
def collecting(made: list[str]):
    """Scratch paths made inside go to `made`, and to no other list."""
    _owners.append(made)
    try:
        yield
    finally:
        _owners.pop()


def scratch_dir(spark: SparkSession, name: str, swept: bool = True) -> str:
    """A new path below spark.checkpoint.dir, deleted when the driver ends, or before by whoever collects it and sweeps.

    Where the setting is absent a local master gets one local folder; a cluster's executors could not read that, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kinweave-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    if swept and _owners:
        _owners[-1].append(path)
    return path


def sweep(spark: SparkSession, made: list[str]) -> None:
    """Delete collected scratch tables: for a caller whose results from them are all written elsewhere. Others' tables stay."""
    while made:
        drop_path(spark, made.pop())


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Let Arrow batches have this many rows at most: texts are long, and a batch is held whole outside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, rows)


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialise(df: DataFrame, name: str, swept: bool = True) -> DataFrame:
    """Write df below spark.checkpoint.dir and return a scan of it: lineage ends there.

    The finished job's shuffle files are let go, so that they don't pile up on
    executors' disks while the next stage runs.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name, swept)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(setting, held)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinweave_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more; what was made from them is written itself."""
    for t in tables:
        drop_path(t.sparkSession, t._kinweave_path)


def running_total(df: DataFrame, keys: list[str], order: str, value: str, out: str, chunk: int = 1024) -> DataFrame:
    """Exclusive running sum of value per keys in the order of an integer column.

    Two levels: sums per block of `chunk` consecutive orders, then inside each
    block, so that a key with a large share of the rows is not sorted in one task.
    """
    names = df.columns
    df = df.withColumn("__kw_block", F.floor(F.col(order) / chunk))
    block = [*keys, "__kw_block"]
    before = W.partitionBy(*keys).orderBy("__kw_block").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(*block).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    per_block = df.groupBy(*block).agg(F.sum(value).alias("__kw_sum")).withColumn("__kw_base", F.coalesce(F.sum("__kw_sum").over(before), F.lit(0)))
    right = per_block.select(*[F.col(k).alias(f"__kw_r_{i}") for i, k in enumerate(block)], "__kw_base")
    cond = F.lit(True)
    for i, k in enumerate(block):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__kw_r_{i}"))
    joined = df.withColumn("__kw_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(right, cond)
    return joined.select(*names, (F.col("__kw_base") + F.col("__kw_in")).alias(out))


# ---- texts known by their digest -----------------------------------------------


def digest_of(text: Column) -> Column:
    """SHA-256 of a string's UTF-8 bytes, binary."""
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def key_of(digest: Column, bits: int = 64) -> Column:
    """The first 64 bits of a digest as a long, big-endian, or fewer (for tests of clashes)."""
    high, low = (F.conv(F.hex(F.substring(digest, i, 4)), 16, 10).cast("long") for i in (1, 5))
    key = F.shiftleft(high, 32).bitwiseOR(low)
    return key if bits == 64 else F.shiftrightunsigned(key, 64 - bits)


def renumbered(texts: DataFrame) -> DataFrame | None:
    """digest, key: new keys for those texts (one row each: key, digest) whose key another text has too; None if there are none.

    With them a key stands for one text only, whatever their number. 64 bits
    clash some n * n / 2 ** 65 times among n texts.
    """
    shared = texts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k"))
    shared = materialise(texts.join(shared, F.col("key") == F.col("k"), "left_semi").select("digest"), "text-clashes")
    if shared.isEmpty():
        forget(shared)
        return None
    salt = 0
    while True:
        salt += 1
        new = materialise(shared.select("digest", F.xxhash64("digest", F.lit(salt)).alias("key")), "text-keys")
        twice = new.groupBy("key").count().where("count > 1")
        if twice.isEmpty() and new.join(texts.select(F.col("key").alias("k")), F.col("key") == F.col("k"), "left_semi").isEmpty():
            return new
        forget(new)


def rekeyed(rows: DataFrame, new: DataFrame | None, digest: str, key: str) -> DataFrame:
    """rows with the keys of renumbered()."""
    if new is None:
        return rows
    names = rows.columns
    new = new.select(F.col("digest").alias("__kw_nd"), F.col("key").alias("__kw_nk"))
    return rows.join(new, F.col(digest) == F.col("__kw_nd"), "left").withColumn(key, F.coalesce("__kw_nk", key)).select(*names)


# ---- numpy views of Arrow text ------------------------------------------------

#: The six characters that part words: [^\x20\x09-\x0D]+ is a word.
_SPACES = (9, 10, 11, 12, 13, 32)


def utf8(array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string or binary array, and its offsets from 0; null is empty."""
    import pyarrow as pa

    if hasattr(array, "combine_chunks"):
        array = array.combine_chunks()
        if isinstance(array, pa.ChunkedArray):
            array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.string())
    array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    n = len(array)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, off - off[0]


def spans_of(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of rows of about `most` bytes together, one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def sub_batches(array, most: int = 1 << 20):
    """(first row, bytes, offsets) of slices of an Arrow text array of about `most` bytes each."""
    body, off = utf8(array)
    for i, j in spans_of(off, most):
        yield i, body[off[i] : off[j]], off[i : j + 1] - off[i]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    out = np.full(max(n, 1), base | 1, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _value_of_byte() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def segment_hash(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of body[start:end] for each segment; disjoint or not, empty ones are equal.

    Eight bytes at a time, each mixed with its place before they are added, so
    that no pattern of bytes cancels out as it may in a polynomial.
    """
    out = np.zeros(len(start), np.uint64)
    size = np.asarray(end - start, np.int64)
    if len(body) and len(size):
        padded = np.concatenate((body, np.zeros(8, np.uint8)))
        eight = np.ndarray((len(body),), "<u8", padded, strides=(1,))
        blocks = (size + 7) >> 3
        full = np.flatnonzero(blocks > 0)
        blocks = blocks[full]
        if len(full):
            first = np.concatenate(([0], np.cumsum(blocks)[:-1]))
            nth = np.arange(int(blocks.sum()), dtype=np.int64) - np.repeat(first, blocks)
            value = eight[np.repeat(start[full], blocks) + 8 * nth].astype(np.uint64)
            last = first + blocks - 1
            spare = (8 * blocks - size[full]).astype(np.uint64) * np.uint64(8)  # bits beyond the segment
            value[last] = (value[last] << spare) >> spare
            value = mix(value + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            out[full] = np.add.reduceat(value, first)
    return mix(out + size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start..start+size of each segment, one after the other."""
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    return np.repeat(start - first, size) + np.arange(int(size.sum()))


def equal_segments(body: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether body[a : a + size] is body[b : b + size], byte by byte, for each pair of segments."""
    same = np.ones(len(a), bool)
    full = np.flatnonzero((size > 0) & (a != b))
    if len(full):
        alike = body[ragged(a[full], size[full])] == body[ragged(b[full], size[full])]
        same[full] = np.logical_and.reduceat(alike, np.concatenate(([0], np.cumsum(size[full])[:-1])))
    return same


def exact_classes(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Class numbers of segments: equal numbers for equal bytes, and for no others."""
    h = segment_hash(body, start, end)
    _, at, inverse = np.unique(h, return_index=True, return_inverse=True)
    size = end - start
    first = at[inverse]
    ok = size == size[first]
    ok[ok] = equal_segments(body, start[ok], start[first[ok]], size[ok])
    if ok.all():
        return inverse
    # segments that only share a hash are told apart by their bytes
    whole, known, out = body.tobytes(), {}, inverse.copy()
    for i in np.flatnonzero(~ok):
        key = whole[start[i] : end[i]]
        out[i] = known.setdefault(key, len(at) + len(known))
    return out


def words_of(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word [^\\x20\\x09-\\x0D]+; none crosses rows."""
    table = np.ones(256, bool)
    table[list(_SPACES)] = False
    inside = table[body]
    rows = np.flatnonzero(np.diff(offsets) > 0)
    first, last = offsets[:-1][rows], offsets[1:][rows] - 1
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    begins[first], ends[last] = inside[first], inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a per-byte array over each row."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def shingles_of(word_hash: np.ndarray, word_row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of every run of k words; a row of fewer words has one run of all of them."""
    count = np.bincount(word_row, minlength=n_rows)
    n = len(word_hash)
    start = np.arange(max(n - k + 1, 0))
    whole = word_row[start] == word_row[start + k - 1] if len(start) else np.zeros(0, bool)
    start = start[whole]
    odd = powers(k + 1, 0xC2B2AE3D27D4EB4F)
    h = np.zeros(len(start), np.uint64)
    for j in range(k):
        h += word_hash[start + j] * odd[j]
    row = word_row[start]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.concatenate(([0], np.cumsum(count)[:-1]))[short]
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            extra[has] += word_hash[first[has] + j] * odd[j]
        h, row, start = np.concatenate((h, extra)), np.concatenate((row, short)), np.concatenate((start, first))
        order = np.argsort(row, kind="stable")
        h, row, start = h[order], row[order], start[order]
    return mix(h), row, start


def groups(batches, column: str):
    """Lists of rows (dicts) with one value of column each, from batches sorted by it."""
    held, now = [], None
    for b in batches:
        for i in range(b.num_rows):
            x = b.column(column)[i].as_py()
            if x != now and held:
                yield held
                held = []
            now = x
            held.append({c: b.column(c)[i].as_py() for c in b.schema.names})
    if held:
        yield held
