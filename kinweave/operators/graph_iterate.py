"""Iterative graph measures: one join and aggregation a step, lineage cut by written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.graph_build import vertices
from kinweave.operators.graph_local import both_ways
from kinweave.validate import cut, forget


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node), component_size.

    Alternates large-star and small-star steps: a node's greater neighbours, and
    then its smaller ones, are linked to the smallest of all, until the links
    are stars around the smallest nodes. Both are an aggregation to one row a
    node that is joined back; the links shrink to one for each node.
    """
    links = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct())
    whole, print_ = vertices(edges), None
    while True:
        both = links.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(least, F.col("a") == F.col("n")).select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("n").alias("a"), F.col("m").alias("b")))))
        small = cut(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        hashes = [F.sum(F.xxhash64("a", "b", F.lit(i)).cast("decimal(38,0)")) for i in range(2)]
        now = tuple(small.agg(F.count("*"), *hashes).first())
        forget(links)
        links = small
        if now == print_:
            break
        print_ = now
    label = whole.join(links, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("component"))
    size = label.groupBy("component").agg(F.count("*").alias("component_size"))
    return label.join(size, "component").select("node", "component", "component_size")


def component_sizes(components: DataFrame) -> DataFrame:
    """component_size, n_components, node_share."""
    per = components.groupBy("component").agg(F.count("*").alias("component_size"))
    total = components.agg(F.count("*").alias("t"))
    return per.groupBy("component_size").agg(F.count("*").alias("n_components")).join(F.broadcast(total), F.lit(True)).select("component_size", "n_components", (F.col("component_size") * F.col("n_components") / F.col("t")).alias("node_share"))


def eigenvector(edges: DataFrame, max_iter: int = 200, tolerance: float = 1e-6, fixed: int | None = None) -> DataFrame:
    """node, eigencent: x <- x + Ax, scaled to length 1, until the changes add up to under n * tolerance; fixed: so many steps, no test.

    Raises ValueError if max_iter steps don't suffice.
    """
    a = cut(both_ways(edges))
    x = held = cut(vertices(edges).withColumn("x", F.lit(1.0)))
    n = x.count()
    for i in range(fixed or max_iter):
        y = a.join(x.select(F.col("node").alias("dst"), F.col("x").alias("xd")), "dst").groupBy("src").agg(F.sum("xd").alias("s"))
        y = x.join(y, F.col("node") == F.col("src")).select("node", F.col("x").alias("old"), (F.col("x") + F.col("s")).alias("x"))
        y = cut(y)
        length = y.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 1.0
        before = x.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] if i == 0 else 1.0
        gap = y.agg(F.sum(F.abs(F.col("x") / length - F.col("old") / before))).first()[0] or 0.0
        forget(held)
        held = y
        x = y.select("node", (F.col("x") / length).alias("x"))
        if fixed is None and gap < n * tolerance:
            break
    else:
        if fixed is None:
            raise ValueError(f"eigenvector centrality didn't settle in {max_iter} steps")
    return x.withColumnRenamed("x", "eigencent")


def pagerank(edges: DataFrame, damping: float = 0.85, steps: int = 20) -> DataFrame:
    """node, pagerank after so many steps from the uniform start; every vertex of the edges has neighbours."""
    a = both_ways(edges)
    deg = a.groupBy("src").agg(F.count("*").alias("k"))
    a = cut(a.join(deg, "src"))
    x = cut(vertices(edges))
    n = x.count()
    x, held = x.withColumn("x", F.lit(1.0 / max(n, 1))), None
    for _ in range(steps):
        y = a.join(x.select(F.col("node").alias("src"), "x"), "src").groupBy("dst").agg(F.sum(F.col("x") / F.col("k")).alias("s"))
        x = cut(y.select(F.col("dst").alias("node"), (F.lit((1 - damping) / max(n, 1)) + damping * F.col("s")).alias("x")))
        if held is not None:
            forget(held)
        held = x
    return x.withColumnRenamed("x", "pagerank")


def core_number(edges: DataFrame) -> DataFrame:
    """node, kcore: the fixpoint of the h-index of the neighbours' values, begun at the degrees.

    Neighbours of equal value are counted first, so that a hub is as many rows
    as its neighbours have values.
    """
    from pyspark.sql.window import Window as W

    a = cut(both_ways(edges))
    x = cut(a.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("x")))
    while True:
        n = a.join(x.select(F.col("node").alias("dst"), F.col("x").alias("xd")), "dst").groupBy("src", "xd").agg(F.count("*").alias("n"))
        above = F.sum("n").over(W.partitionBy("src").orderBy(F.col("xd").desc()))
        h = n.withColumn("r", above).groupBy("src").agg(F.max(F.least("r", "xd")).alias("h"))
        y = cut(x.join(h, F.col("node") == F.col("src")).select("node", F.col("x").alias("old"), F.least("x", "h").alias("x")))
        done = y.where("x <> old").limit(1).count() == 0
        forget(x)
        if done:
            forget(a)
            return y.select("node", F.col("x").alias("kcore"))
        x = cut(y.select("node", "x"))
        forget(y)


def distance_to(edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """hubs: node. node, distance to the nearest hub; infinity where none is reached. Breadth first, the frontier joined each step."""
    a = cut(both_ways(edges))
    # an edge's ends are at most one step apart, so only the last two frontiers can be met again
    before, frontier = None, cut(hubs.select("node").distinct().withColumn("distance", F.lit(0.0)))
    seen, step = frontier, 0
    while True:
        step += 1
        new = a.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(frontier, "node", "left_anti")
        if before is not None:
            new = new.join(before, "node", "left_anti")
        new = cut(new.withColumn("distance", F.lit(float(step))))
        if new.isEmpty():
            break
        before, frontier, seen = frontier, new, seen.union(new)
    return vertices(edges).join(seen, "node", "left").withColumn("distance", F.coalesce("distance", F.lit(float("inf"))))


def top_hubs(scores: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The k nodes of highest score, ties by node: a top-k report."""
    return scores.orderBy(F.col(column).desc(), "node").limit(k).select("node")
