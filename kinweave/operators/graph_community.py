"""Communities by modularity optimisation (Louvain), by tables.

A level is a graph of weighted edges, once each, with loops for what was merged
into a vertex. Vertices move in rounds, those of a round drawn by a hash: each
drawn one looks at its links' weight to every neighbouring community (one join
of links and labels, one aggregation) and takes the community of greatest gain.
All of a round move at once, from the labels before it. Where two single
vertices would swap, only the greater moves to the smaller. A level ends when
almost nothing moves; its communities are contracted into the next level's
vertices by one aggregation, written as a table. Once a contracted graph has
`held_edges` edges or fewer (counted), one task ends it by moving vertex after
vertex. Last, vertices of the first level move again from the communities
found (refinement), which is kept if modularity grew.

Nothing but counts comes to the driver, and no task holds more than held_edges
edges or a partition of a shuffle. A hub's links meet its label in a join of
which Spark splits large partitions; its sums by community are partial first.
`label_communities` is another algorithm, by label propagation, for those who ask for it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.graph_build import vertices
from kinweave.operators.graph_local import both_ways
from kinweave.validate import cut, forget

#: Edges of a contracted graph that one task takes over: two ids and a weight each, some hundred MB as Python objects.
HELD_EDGES = 1_000_000
#: A gain counts from here; sums of doubles differ by less from run to run.
LEAST_GAIN = 1e-9


def _move(at: np.ndarray, to: np.ndarray, weight: np.ndarray, degree: np.ndarray, m2: float) -> np.ndarray:
    """One level on one machine: vertices in order move to the neighbouring community of greatest gain until none gains; ties to the smaller label. Only vertices whose neighbourhood changed are looked at again."""
    n = len(at) - 1
    starts, ends, near, w, deg = at[:-1].tolist(), at[1:].tolist(), to.tolist(), weight.tolist(), degree.tolist()
    label, total = list(range(n)), degree.tolist()
    again = [True] * n
    moved = True
    while moved:
        moved = False
        for i in range(n):
            if not again[i]:
                continue
            again[i] = False
            own, k = label[i], deg[i] / m2
            links: dict[int, float] = {own: 0.0}
            for p in range(starts[i], ends[i]):
                j = near[p]
                if j != i:
                    c = label[j]
                    links[c] = links.get(c, 0.0) + w[p]
            total[own] -= deg[i]
            best, value = own, links[own] - total[own] * k
            for c, x in links.items():
                g = x - total[c] * k
                if g > value + 1e-12 or g > value - 1e-12 and c < best and best != own:
                    best, value = c, max(g, value)
            total[best] += deg[i]
            if best != own:
                label[i], moved = best, True
                for p in range(starts[i], ends[i]):
                    if label[near[p]] != best:
                        again[near[p]] = True
    return np.array(label)


def louvain_labels(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Communities 0..k-1 of vertices 0..n-1, levels until nothing merges. Edges once each; a loop counts twice in its vertex's degree."""
    place, m2 = np.arange(n), 2 * float(w.sum())
    while m2:
        loop = u == v
        src, dst, x = np.concatenate((u, v[~loop])), np.concatenate((v, u[~loop])), np.concatenate((w, w[~loop]))
        order = np.lexsort((dst, src))
        at = np.concatenate(([0], np.cumsum(np.bincount(src, minlength=n))))
        degree = np.bincount(src, x, n) + np.bincount(u[loop], w[loop], n)
        label = _move(at, dst[order], x[order], degree, m2)
        names, label = np.unique(label, return_inverse=True)
        place = label[place]
        if len(names) == n:
            break
        a, b = np.minimum(label[u], label[v]), np.maximum(label[u], label[v])
        key, inverse = np.unique(a * np.int64(len(names)) + b, return_inverse=True)
        u, v, w, n = key // len(names), key % len(names), np.bincount(inverse, w), len(names)
    return place


def _links(level: DataFrame) -> DataFrame:
    """src, dst, w: a level's edges from both ends, without loops."""
    one = F.struct(F.col("u").alias("src"), F.col("v").alias("dst"), "w")
    return level.where("u <> v").select(F.inline(F.array(one, F.struct(F.col("v").alias("src"), F.col("u").alias("dst"), "w"))))


def _degrees(level: DataFrame) -> DataFrame:
    """node, k: summed weight of its links; a loop counts twice."""
    ends = F.when(F.col("u") == F.col("v"), F.array(F.struct(F.col("u").alias("node"), (2 * F.col("w")).alias("k")))).otherwise(F.array(F.struct(F.col("u").alias("node"), F.col("w").alias("k")), F.struct(F.col("v").alias("node"), F.col("w").alias("k"))))
    return level.select(F.inline(ends)).groupBy("node").agg(F.sum("k").alias("k"))


def _round(links: DataFrame, state: DataFrame, m2: float, drawn) -> DataFrame:
    """state (node, k, c) after the drawn vertices took their best community, with moved."""
    near = links.where(drawn("src")).join(state.select(F.col("node").alias("dst"), F.col("c").alias("to")), "dst")
    near = near.groupBy("src", "to").agg(F.sum("w").alias("x"))
    # a vertex may stay where it has no link
    near = near.select("src", "to", "x").unionByName(state.where(drawn("node")).select(F.col("node").alias("src"), F.col("c").alias("to"), F.lit(0.0).alias("x"))).groupBy("src", "to").agg(F.sum("x").alias("x"))
    totals = state.groupBy("c").agg(F.sum("k").alias("total"), F.count("*").alias("members"))
    own = state.join(totals, "c").select(F.col("node").alias("src"), "k", "c", F.col("members").alias("own_members"))
    near = near.join(totals.withColumnRenamed("c", "to"), "to").join(own, "src")
    here = F.col("to") == F.col("c")
    gain = F.col("x") - (F.col("total") - F.when(here, F.col("k")).otherwise(F.lit(0.0))) * F.col("k") / F.lit(m2)
    swap = (F.col("own_members") == 1) & (F.col("members") == 1) & (F.col("to") > F.col("c"))
    best = near.where(here | ~swap).select("src", "to", "c", gain.alias("gain")).groupBy("src").agg(
        F.min_by("to", F.struct(-F.round("gain", 9), F.col("to"))).alias("to"), F.max("gain").alias("gain"), F.max(F.when(F.col("to") == F.col("c"), F.col("gain"))).alias("stay")
    )
    moves = best.where(F.col("gain") > F.col("stay") + LEAST_GAIN).select("src", "to")
    after = state.drop("moved").join(moves, F.col("node") == F.col("src"), "left")
    return after.select("node", "k", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().alias("moved"))


def _moved(level: DataFrame, state: DataFrame, m2: float, seed: int, rounds: int, share: float) -> DataFrame:
    """state after rounds of moves, until two in a row move no more than `share` of the vertices."""
    links, n, quiet = cut(_links(level)), state.count(), 0
    for i in range(rounds):
        after = cut(_round(links, state, m2, lambda c, i=i: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(2)) == i % 2 if i < rounds // 2 else F.pmod(F.xxhash64(c, F.lit(seed + i)), F.lit(2)) == 0))
        forget(state)
        state = after
        quiet = quiet + 1 if state.where("moved").count() <= share * n else 0
        if quiet == 2:
            break
    forget(links)
    return state


def _contracted(level: DataFrame, state: DataFrame) -> DataFrame:
    """The next level: communities as vertices, what lies inside them as loops."""
    label = state.select("node", "c")
    e = level.join(label.select(F.col("node").alias("u"), F.col("c").alias("a")), "u").join(label.select(F.col("node").alias("v"), F.col("c").alias("b")), "v")
    return e.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.sum("w").alias("w"))


def _quality(level: DataFrame, m2: float) -> float:
    """Modularity of a level's vertices as communities."""
    inside = level.where("u = v").agg(F.sum("w").alias("x")).first().x or 0.0
    spread = _degrees(level).agg(F.sum(F.col("k") * F.col("k")).alias("x")).first().x or 0.0
    return 2 * inside / m2 - spread / m2 / m2


def _finished(level: DataFrame, kind: str) -> DataFrame:
    """node, c of a level that one task can hold."""

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(["u", "v"])
        names, at = np.unique(np.concatenate((pdf["u"].to_numpy(), pdf["v"].to_numpy())), return_inverse=True)
        label = louvain_labels(at[: len(pdf)], at[len(pdf) :], pdf["w"].to_numpy(), len(names))
        first = np.full(len(names), len(names))
        np.minimum.at(first, label, np.arange(len(names)))
        return pd.DataFrame({"node": names, "c": names[first[label]]})

    return level.groupBy(F.lit(0).alias("one")).applyInPandas(run, f"node {kind}, c {kind}")


def louvain(edges: DataFrame, rounds: int = 16, levels: int = 20, refine: int = 6, share: float = 0.005, held_edges: int = HELD_EDGES) -> DataFrame:
    """node, community (its smallest node of the level that named it): the same at every run. edges: u, v[, weight], once each."""
    kind = dict(edges.dtypes)["u"]
    w = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    first = level = cut(edges.select("u", "v", w.alias("w")).where("u is not null and v is not null"))
    m2 = 2 * (first.agg(F.sum("w").alias("x")).first().x or 0.0)
    label = cut(vertices(first).select("node", F.col("node").alias("c")))
    if m2 <= 0:
        return label.select("node", F.col("c").alias("community"))
    quality = _quality(first, m2)
    for i in range(levels):
        if i and level.count() <= held_edges:
            state, last = cut(_finished(level, kind)), True
        else:
            state, last = _moved(level, cut(_degrees(level).withColumn("c", F.col("node")).withColumn("moved", F.lit(True))), m2, i, rounds, share), False
        after = cut(_contracted(level, state))
        now = _quality(after, m2)
        if now <= quality + 1e-6:
            break
        label = cut(label.join(state.select(F.col("node").alias("c"), F.col("c").alias("to")), "c").select("node", F.col("to").alias("c")))
        level, quality = after, now
        if last:
            break
    if refine:
        state = cut(_degrees(first).join(label, "node").withColumn("moved", F.lit(True)))
        state = _moved(first, state, m2, 1, refine, share)
        if _quality(_contracted(first, state), m2) > quality:
            label = state
    return label.select("node", F.col("c").alias("community"))


def label_communities(edges: DataFrame, steps: int = 10) -> DataFrame:
    """node, community by so many steps of label propagation: the most frequent label among the neighbours, the smallest of ties."""
    a = cut(both_ways(edges))
    x = cut(vertices(edges).withColumn("community", F.col("node")))
    for _ in range(steps):
        n = a.join(x.select(F.col("node").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.count("*").alias("n"))
        x = cut(n.groupBy(F.col("src").alias("node")).agg(F.min_by("community", F.struct(-F.col("n"), F.col("community"))).alias("community")))
    return x
