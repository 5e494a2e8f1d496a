"""Streams that can be ended and started again: appends of new keys, and harvests over HTTP.

Where a stream got to is kept below its checkpoint, and what it wrote is listed
in its sink's own log, so a restart neither writes a batch twice nor leaves one
out, whatever was lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinweave.sources import http


def stream_new(spark: SparkSession, source: str, schema: str, key: str, sink: str, checkpoint: str, event_time: str | None = None, delay: str = "1 day") -> StreamingQuery:
    """Reads what is new in source since the checkpoint, drops keys seen before, appends to sink, and ends.

    Without event_time every key is kept for ever. With it (a timestamp column) a key is forgotten once the newest time seen
    is `delay` past it, and the state stays as large as that span of the stream.
    """
    rows: DataFrame = spark.readStream.schema(schema).json(source).where(f"{key} is not null")
    rows = rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key]) if event_time else rows.dropDuplicates([key])
    return rows.writeStream.format("json").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def id_files(ids: DataFrame, column: str, path: str, per_file: int = 1000) -> int:
    """The distinct ids of a column as text files of about per_file ids each, which a harvest takes file by file. Returns their number."""
    one = ids.select(F.col(column).cast("string").alias("value")).where("value is not null and value <> ''").distinct()
    n = one.count()
    files = max(1, -(-n // per_file))
    dealt = one.withColumn("file", F.pmod(F.xxhash64("value"), F.lit(files)))
    dealt.repartition(files, "file").sortWithinPartitions("value").select("value").write.option("maxRecordsPerFile", 2 * per_file).mode("append").text(path)
    return n


def harvest(spark: SparkSession, ids: str, plan: http.Plan, sink: str, checkpoint: str, files: int = 8, batch: int = 50, per_second: float | None = None) -> StreamingQuery:
    """Asks for the ids in the text files of a folder (id_files()), appends (request, ordinal, body) to sink as JSON, and ends; started again it goes on.

    A step takes `files` files, asked for in parallel; it is finished when its answers are in the sink, and then its ids are never
    asked for again. Of a step that was broken off all ids are asked for anew. per_second: requests of one task; the steps'
    rate is at most `files` times that. Files added later are taken up by the next start.
    """
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files).text(ids)
    rows = http.answers(lines.select(F.col("value").alias("id")), plan, batch, per_second)
    return rows.writeStream.format("json").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
