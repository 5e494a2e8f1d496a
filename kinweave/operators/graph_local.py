"""Local graph measures over simple edges (u, v), u < v.

Triangles are found on edges oriented from the end of lower degree to the higher
(ties by id), which bounds every vertex's out-degree by sqrt(2m); shared partners
of an edge are the triangles over it, so no product of the adjacency with itself
is made beyond them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import order_statistics
from kinweave.operators.graph_build import vertices


def both_ways(edges: DataFrame) -> DataFrame:
    """src, dst: each edge from both ends, by one scan."""
    one = F.struct(F.col("u").alias("src"), F.col("v").alias("dst"))
    return edges.select(F.inline(F.array(one, F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))))


def two_steps(a: DataFrame, block: int = 1024) -> DataFrame:
    """src, dst of every path of two links in a (src, dst, both ways), src <> dst.

    A vertex of n links has n * n such paths. Its incoming links are dealt to
    blocks and its outgoing ones copied to each, so that no task gets more than
    block * n of them.
    """
    blocks = a.groupBy(F.col("src").alias("mid")).agg(F.ceil(F.count("*") / block).alias("blocks"))
    into = a.select("src", F.col("dst").alias("mid")).join(blocks, "mid").select("src", "mid", F.pmod(F.xxhash64("src"), "blocks").alias("block"))
    out = a.select(F.col("src").alias("mid"), "dst").join(blocks, "mid").select("mid", "dst", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    return into.join(out, ["mid", "block"]).where("src <> dst").select("src", "dst")


def degree(edges: DataFrame) -> DataFrame:
    """node, degree, log_degree (log1p)."""
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")).withColumn("log_degree", F.log1p("degree"))


def degree_summary(edges: DataFrame) -> DataFrame:
    d = degree(edges)
    plain = d.agg(F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"), F.var_pop("degree").alias("var_degree"))
    middle = order_statistics.percentiles(d, "degree", {"median_degree": 0.5})
    return plain.join(F.broadcast(middle), F.lit(True), "left").select("mean_degree", "median_degree", "max_degree", "var_degree")  # one row each


def triangles(edges: DataFrame) -> DataFrame:
    """a < b < c, once for each triangle."""
    d = degree(edges).select("node", "degree")
    e = edges.join(d.select(F.col("node").alias("u"), F.col("degree").alias("du")), "u").join(d.select(F.col("node").alias("v"), F.col("degree").alias("dv")), "v")
    up = F.struct("du", "u") < F.struct("dv", "v")
    o = e.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("lo"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("hi"), F.when(up, F.col("dv")).otherwise(F.col("du")).alias("dh"))
    x = o.select("lo", F.col("hi").alias("x"), F.col("dh").alias("dx"))
    y = o.select("lo", F.col("hi").alias("y"), F.col("dh").alias("dy"))
    wedge = x.join(y, "lo").where(F.struct("dx", "x") < F.struct("dy", "y"))
    closed = wedge.join(o.select(F.col("lo").alias("x"), F.col("hi").alias("y")), ["x", "y"])
    t = closed.select(F.array_sort(F.array("lo", "x", "y")).alias("t"))
    return t.select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))


def shared_partners(edges: DataFrame, tri: DataFrame | None = None) -> DataFrame:
    """u, v, shared: the number of common neighbours of each edge's ends."""
    t = triangles(edges) if tri is None else tri
    pairs = t.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("a").alias("u"), F.col("c").alias("v")), F.struct(F.col("b").alias("u"), F.col("c").alias("v")))).alias("e")).select("e.*")
    n = pairs.groupBy("u", "v").agg(F.count("*").alias("shared"))
    return edges.select("u", "v").join(n, ["u", "v"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))


def edge_scores(edges: DataFrame, decay: float = 0.5, weak: int = 1, tri: DataFrame | None = None) -> DataFrame:
    """node, gwesp_score, weak_tie_frac."""
    s = shared_partners(edges, tri)
    ends = s.select(F.col("u").alias("node"), "shared").union(s.select(F.col("v").alias("node"), "shared"))
    return ends.groupBy("node").agg(F.sum(1 - F.exp(-decay * F.col("shared"))).alias("gwesp_score"), F.avg((F.col("shared") <= weak).cast("double")).alias("weak_tie_frac"))


def clustering(edges: DataFrame, tri: DataFrame | None = None) -> DataFrame:
    """node, degree, triangles, clust_local, open_wedges, two_paths."""
    t = triangles(edges) if tri is None else tri
    n = t.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    k = F.col("degree")
    paths = F.floor(k * (k - 1) / 2)
    return (
        degree(edges).select("node", "degree").join(n, "node", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
        .withColumn("clust_local", F.when(k >= 2, 2 * F.col("triangles") / (k * (k - 1))).otherwise(0.0))
        .withColumn("open_wedges", F.greatest(paths - F.col("triangles"), F.lit(0)))
        .withColumn("two_paths", paths)
    )


def global_clustering(edges: DataFrame) -> DataFrame:
    """transitivity, average_clustering, and the four triad classes of an undirected graph."""
    c = clustering(edges)
    s = c.agg(F.count("*").alias("n"), F.sum("degree").alias("d"), F.sum("triangles").alias("t3"), F.sum("two_paths").alias("w"), F.avg("clust_local").alias("average_clustering"))
    n, m, t, w = F.col("n"), F.col("d") / 2, F.col("t3") / 3, F.col("w")
    all3 = n * (n - 1) * (n - 2) / 6
    one = m * (n - 2) - 2 * w + 3 * t
    two = w - 3 * t
    return s.select(F.try_divide(3 * t, w).alias("transitivity"), "average_clustering", t.cast("long").alias("triads_3"), two.cast("long").alias("triads_2"), one.cast("long").alias("triads_1"), (all3 - one - two - t).cast("long").alias("triads_0"))


def density(edges: DataFrame) -> DataFrame:
    """n_nodes, n_edges, density."""
    n = vertices(edges).agg(F.count("*").alias("n_nodes"))
    m = edges.agg(F.count("*").alias("n_edges"))
    return n.join(m, F.lit(True)).withColumn("density", F.try_divide(2.0 * F.col("n_edges"), (F.col("n_nodes") * (F.col("n_nodes") - 1)).cast("double")))


def open_dyads(edges: DataFrame) -> DataFrame:
    """node, open_dyads: vertices within two steps that are no neighbours."""
    a = both_ways(edges)
    two = two_steps(a).distinct()
    far = two.join(a, ["src", "dst"], "left_anti").groupBy("src").agg(F.count("*").alias("open_dyads"))
    return a.select("src").distinct().join(far, "src", "left").select(F.col("src").alias("node"), F.coalesce("open_dyads", F.lit(0)).alias("open_dyads"))


def same_share(edges: DataFrame, attrs: DataFrame, columns: dict[str, str], node: str = "node") -> DataFrame:
    """node and, for each attribute -> name, the share of neighbours of equal value; two nulls are equal."""
    a = attrs.select(F.col(node).alias("__n"), *columns)
    s = a.select(F.col("__n").alias("src"), *[F.col(c).alias(f"s_{c}") for c in columns])
    d = a.select(F.col("__n").alias("dst"), *[F.col(c).alias(f"d_{c}") for c in columns])
    j = both_ways(edges).join(s, "src", "left").join(d, "dst", "left")
    return j.groupBy(F.col("src").alias("node")).agg(*[F.avg(F.col(f"s_{c}").eqNullSafe(F.col(f"d_{c}")).cast("double")).alias(name) for c, name in columns.items()])


def triangle_mixing(edges: DataFrame, attrs: DataFrame, columns: dict[str, str], node: str = "node", tri: DataFrame | None = None) -> DataFrame:
    """node and tri_within_<name>, tri_cross_<name>: its triangles with all values equal, and with all different."""
    t = triangles(edges) if tri is None else tri
    a = attrs.select(F.col(node).alias("__n"), *columns)
    for corner in "abc":
        t = t.join(a.select(F.col("__n").alias(corner), *[F.col(c).alias(f"{corner}_{c}") for c in columns]), corner, "left")
    flags = []
    for c, name in columns.items():
        x, y, z = (F.col(f"{k}_{c}") for k in "abc")
        flags += [F.count_if(x.eqNullSafe(y) & y.eqNullSafe(z)).alias(f"tri_within_{name}"), F.count_if(~x.eqNullSafe(y) & ~y.eqNullSafe(z) & ~x.eqNullSafe(z)).alias(f"tri_cross_{name}")]
    counted = t.withColumn("node", F.explode(F.array("a", "b", "c"))).groupBy("node").agg(*flags)
    return vertices(edges).join(counted, "node", "left").fillna(0)


def log_binned_clustering(edges: DataFrame, bins: int = 10) -> DataFrame:
    """Mean clustering in logarithmic bins of the degree, half-open; the centre is the geometric mean of a bin's edges."""
    c = clustering(edges).where("degree > 0")
    top = c.agg(F.max("degree").alias("top"))
    width = F.log10(F.col("top")) / bins
    j = c.join(F.broadcast(top), F.lit(True)).where("degree < top")  # one row
    b = F.floor(F.log10("degree") / width + 1e-9)
    j = j.withColumn("bin", b).withColumn("centre", F.pow(F.lit(10.0), (b + 0.5) * width))
    return j.groupBy("bin", "centre").agg(F.count("*").alias("n"), F.avg("clust_local").alias("mean_clustering"))


def participation(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """partition: node, community. node, community_participation: the share of neighbours in other communities."""
    p = partition.select(F.col("node").alias("src"), F.col("community").alias("cs"))
    q = partition.select(F.col("node").alias("dst"), F.col("community").alias("cd"))
    return both_ways(edges).join(p, "src").join(q, "dst").groupBy(F.col("src").alias("node")).agg(F.avg((F.col("cs") != F.col("cd")).cast("double")).alias("community_participation"))


def modularity(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """modularity, communities of a given partition: sum over communities of L/m - (d/2m)^2."""
    p = partition.select(F.col("node").alias("u"), F.col("community").alias("cu"))
    q = partition.select(F.col("node").alias("v"), F.col("community").alias("cv"))
    e = edges.join(p, "u").join(q, "v")
    inner = e.where("cu = cv").groupBy(F.col("cu").alias("c")).agg(F.count("*").alias("l"))
    d = e.select(F.explode(F.array("cu", "cv")).alias("c")).groupBy("c").agg(F.count("*").alias("d"))
    m = e.agg(F.count("*").alias("m"))
    j = d.join(inner, "c", "left").join(F.broadcast(m), F.lit(True))  # one row
    return j.agg(F.sum(F.coalesce("l", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("modularity"), F.count("*").alias("communities"))
