"""Connected components of an undirected link table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import common as C


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """links (a, b), longs -> (node, root): root is the smallest node of the component.

    Alternates large-star and small-star steps (each links a node's neighbours to
    its smallest one) until nothing changes. Each step is two aggregations on
    links; a node of many neighbours is pre-aggregated to its minimum and joined
    back, never gathered. The links of a step are a written table. Nodes without
    a link are absent. Nulls and self-links are dropped; repeated links count once.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = C.materialise(edges, name), None
    while True:
        both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        # large star: every larger neighbour of a node links to the node's minimum
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: every smaller neighbour, and the node, links to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        joined = large.join(least, F.col("a") == F.col("n"))
        small = joined.select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("n").alias("a"), F.col("m").alias("b")))))
        small = C.materialise(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
        # the number of links and two sums of hashes tell whether a step changed anything
        hashes = [F.sum(F.xxhash64("a", "b", F.lit(i)).cast("decimal(38,0)")) for i in range(2)]
        now = tuple(small.agg(F.count("*"), *hashes).first())
        C.forget(edges)
        edges = small
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
