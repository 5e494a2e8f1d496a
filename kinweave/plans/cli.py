"""Command line: python -m kinweave.plans.cli {features,network,final,writers} ..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import session
from kinweave.operators import early, graph_build, graph_iterate, graph_local, graph_traverse, matrix
from kinweave.plans import pipeline
from kinweave.schemas import ARTIST_DOC, METRICS
from kinweave.sources import readers, sinks

# Relations that make a person a writer.
WRITERS = ["composer", "lyricist", "writer", "co-composer", "librettist", "translator", "arranger"]
RECORDINGS = "recording_id string, recording_title string, authors array<struct<name: string, mbid: string, relation: string>>"


def table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or CSV with numbers where every value is one."""
    return spark.read.parquet(path) if not path.endswith(".csv") else spark.read.option("header", True).option("inferSchema", True).csv(path)


def features(spark, a) -> None:
    docs = readers.json_lines(spark, a.docs, ARTIST_DOC, "skip")
    out = matrix.clean_features(early.features(pipeline.accepted(docs), a.as_of, a.years))
    out.write.mode("error").parquet(a.output)


def network(spark, a) -> None:
    docs = readers.json_lines(spark, a.docs, ARTIST_DOC, "skip")
    for name, df in pipeline.network(docs, table(spark, a.features), a.dimensions).items():
        df.write.mode("error").parquet(f"{a.output}/{name}")


def final(spark, a) -> None:
    metrics = readers.json_lines(spark, a.metrics_jsonl, METRICS, "strict").withColumn("__order", F.monotonically_increasing_id())
    out = matrix.build_final(table(spark, a.base_features), table(spark, a.node_features), table(spark, a.node_embeddings), metrics, "__order")
    sinks.csv(out, a.output)


def writer_metrics(edges: DataFrame) -> DataFrame:
    """author, degree, weighted_degree, betweenness of a writer graph, most connected first."""
    e = edges.select("u", "v")
    ends = edges.select(F.col("u").alias("node"), "weight").union(edges.select(F.col("v").alias("node"), "weight"))
    strength = ends.groupBy("node").agg(F.sum("weight").alias("weighted_degree"))
    out = graph_local.degree(e).select("node", "degree").join(strength, "node").join(graph_traverse.betweenness(e, None), "node").join(graph_iterate.connected_components(e).select("node", "component_size"), "node")
    return out.withColumnRenamed("node", "author").orderBy(F.col("weighted_degree").desc(), F.col("degree").desc(), "author")


def writers(spark, a) -> None:
    edges = graph_build.writer_graph(readers.json_lines(spark, a.jsonl, RECORDINGS, "skip"), WRITERS)
    sinks.csv(edges.orderBy(F.col("weight").desc(), "u", "v"), f"{a.prefix}_edges")
    sinks.csv(writer_metrics(edges), f"{a.prefix}_nodes")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="kinweave")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("features")
    one.add_argument("docs"), one.add_argument("output"), one.add_argument("--as-of", required=True), one.add_argument("--years", type=int, default=5)
    two = sub.add_parser("network")
    two.add_argument("docs"), two.add_argument("features"), two.add_argument("output"), two.add_argument("--dimensions", type=int, default=32)
    three = sub.add_parser("final")
    for name in ("--base-features", "--node-features", "--node-embeddings", "--metrics-jsonl", "--output"):
        three.add_argument(name, required=True)
    four = sub.add_parser("writers")
    four.add_argument("jsonl"), four.add_argument("--prefix", required=True)
    a = p.parse_args(argv)
    {"features": features, "network": network, "final": final, "writers": writers}[a.command](session.build(), a)


if __name__ == "__main__":
    main()
