"""Readers with declared schemas: tolerant, skipping and strict JSON lines, maps, CSV, id lists, JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import scalars as S


def json_lines(spark: SparkSession, path: str, schema: str, mode: str = "tolerant") -> DataFrame:
    """mode tolerant: bad lines stay as _corrupt; skip: bad lines go; strict: a bad line fails the job. Blank lines are no lines."""
    spark_mode = {"tolerant": "PERMISSIVE", "skip": "DROPMALFORMED", "strict": "FAILFAST"}[mode]
    r = spark.read.option("mode", spark_mode).option("pathGlobFilter", "*.json*")
    if mode == "tolerant":
        return r.option("columnNameOfCorruptRecord", "_corrupt").schema(f"{schema}, _corrupt string").json(path)
    return r.schema(schema).json(path)


def raw_and_parsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """value (the line as it came), doc (null if it can't be parsed)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.withColumn("doc", F.from_json("value", f"struct<{schema}>" if not schema.strip().startswith("struct") else schema))


def json_map(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object {key: {name: value}} -> key, name, value."""
    whole = spark.read.text(path, wholetext=True)
    m = whole.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("key", "inner"))
    return m.select("key", F.explode("inner").alias("name", "value"))


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(schema).json(path)


def array_or_object(column: str, schema: str) -> F.Column:
    """JSON text of an array of objects, or of one, as an array."""
    text = F.ltrim(F.col(column))
    return F.when(text.startswith("["), F.from_json(text, f"array<struct<{schema}>>")).otherwise(F.array(F.from_json(text, f"struct<{schema}>")))


def json_field(df: DataFrame, column: str, field: str, kind: str, out: str) -> DataFrame:
    """df with a field of a JSON text column, null where it is absent or of another kind."""
    return df.withColumn(out, F.get_json_object(column, f"$.{field}").try_cast(kind))


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def csv_text(spark: SparkSession, path: str, key: str, ints: tuple[str, ...] = ()) -> DataFrame:
    """All columns as trimmed text, the named ones as integers or null, rows without a key dropped, one row of each key (the smallest)."""
    raw = spark.read.option("header", True).csv(path)
    t = raw.select(*[(F.nullif(S.strip(c), F.lit("")).try_cast("bigint") if c in ints else F.nullif(S.strip(c), F.lit(""))).alias(c) for c in raw.columns])
    rest = [c for c in t.columns if c != key]
    one = t.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("r"))
    return one.select(key, *[F.col("r")[c].alias(c) for c in rest]).select(*t.columns)


def csv_map(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """key, value of a two-column CSV; of several values the last: of the files in order of their paths, and in each the last line."""
    raw = spark.read.option("header", True).csv(path)
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())  # a block's lines are in one task, in order
    return raw.select(key, value, place.alias("__i")).groupBy(key).agg(F.max_by(value, "__i").alias(value))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """mbid, pos of the non-blank lines."""
    t = spark.read.text(path).select(S.strip("value").alias("mbid"), F.monotonically_increasing_id().alias("pos"))
    return t.where("mbid <> ''")


def jdbc(spark: SparkSession, table: str, env: dict[str, str], partition: tuple[str, int, int, int] | None = None, fetch: int = 50_000) -> DataFrame:
    """A table of a PostgreSQL server; host, port, database, user and password by env, with defaults. partition: column, low, high, parts."""
    url = f"jdbc:postgresql://{env.get('PGHOST', 'localhost')}:{env.get('PGPORT', '5432')}/{env.get('PGDATABASE', 'catalog')}"
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("user", env.get("PGUSER", "postgres")).option("password", env.get("PGPASSWORD", "")).option("fetchsize", fetch)
    if partition:
        column, low, high, parts = partition
        r = r.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return r.load()


def tables(spark: SparkSession, names: list[str], database: str | None = None) -> dict[str, DataFrame]:
    """Those of the named tables that the catalog has."""
    full = [f"{database}.{n}" if database else n for n in names]
    return {n: spark.table(f) for n, f in zip(names, full, strict=True) if spark.catalog.tableExists(f)}


def ids_of(artist: DataFrame) -> DataFrame:
    return artist.where("gid is not null").select("gid").orderBy("gid")
