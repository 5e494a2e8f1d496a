"""Writers: size-capped JSON shards, CSV, id lists, sorted maps, appends that can be resumed, raw lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.validate import scratch


def json_shards(df: DataFrame, path: str, max_bytes: int = 300 * 1024 * 1024, mode: str = "error") -> int:
    """JSON lines in files of max_bytes at most; a row longer than that has a file of its own. Returns the number of size classes.

    Rows go by classes of length, each from over a half to the whole of a power of two bytes, so that as many rows of a
    class as fit at its greatest length never exceed the cap, whatever the other rows' lengths.
    """
    spark, held = df.sparkSession, scratch(df.sparkSession, "shards")
    size = F.octet_length(F.to_json(F.struct("*"))) + 1  # with the end of its line
    df.withColumn("__bits", F.ceil(F.log2(size)).cast("int")).write.partitionBy("__bits").option("compression", "zstd").parquet(held)
    kept = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, __bits int").parquet(held)
    classes = sorted(r["__bits"] for r in kept.select("__bits").distinct().collect())  # some forty at most
    if not classes:
        df.write.mode(mode).json(path)
    for i, bits in enumerate(classes):
        rows = max(1, max_bytes >> bits)
        kept.where(F.col("__bits") == bits).drop("__bits").write.mode("append" if i else mode).option("maxRecordsPerFile", rows).json(path)
    return len(classes)


def csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "error") -> None:
    (df.select(*columns) if columns else df).write.mode(mode).option("header", True).csv(path)


def id_list(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).write.text(path)


def dump_ids(df: DataFrame, column: str, path: str) -> int:
    """id_list(), sorted; returns the number of ids written."""
    ids = df.select(F.col(column).cast("string").alias("id")).where("id is not null")
    n = ids.count()
    ids.orderBy("id").write.text(path)
    return n


def json_map(df: DataFrame, key: str, name: str, value: str, path: str) -> None:
    """{key: {name: value}} with sorted keys as one text: for maps that fit a task, as the format itself asks for."""
    inner = df.groupBy(key).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value))))).alias("m"))
    quoted = F.regexp_replace(F.to_json(F.struct(F.col(key).cast("string").alias("k"))), r'^\{"k":|\}$', "")
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.concat(quoted, F.lit(":"), F.col("m")).alias("t"))))
    whole = inner.groupBy().agg(F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda x: x["t"]), ","), F.lit("}")).alias("value"))
    whole.write.text(path)


def chart_data(frames: dict[str, DataFrame], path: str) -> None:
    """{name: [{column: value}, ...]} of small aggregates as one JSON text, rows in order of their columns."""
    one = None
    for name, df in frames.items():
        rows = df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*df.columns)))).alias("t")).select(F.concat(F.lit(f'"{name}":'), "t").alias("t"))
        one = rows if one is None else one.union(rows)
    one.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list("t")), ","), F.lit("}")).alias("value")).coalesce(1).write.text(path)


def example(df: DataFrame, order: str, n: int, path: str) -> None:
    """The first n rows as a JSON array in one text: a sample to look at."""
    rows = df.orderBy(order).limit(n)
    rows.agg(F.to_json(F.sort_array(F.collect_list(F.struct(order, *[c for c in df.columns if c != order])))).alias("value")).write.text(path)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Append as JSON the rows whose key the folder doesn't have yet; running it twice writes nothing more."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    if there:
        df = df.join(spark.read.schema(df.schema).json(path).select(key).distinct(), key, "left_anti").select(*df.columns)
    df.write.mode("append").json(path)


def raw_lines(df: DataFrame, path: str, column: str = "value") -> None:
    """Accepted lines as they came in."""
    df.select(column).write.text(path)


def table(df: DataFrame, name: str, bucket: str | None = None, buckets: int = 64) -> None:
    """A managed Parquet table, bucketed by a join key if one is named."""
    w = df.write.mode("overwrite").format("parquet")
    (w.bucketBy(buckets, bucket).sortBy(bucket) if bucket else w).saveAsTable(name)
