import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import helpers as H
from kinweave.operators import graph_build, graph_community, graph_iterate, graph_local, graph_traverse, graph_walks
from kinweave.plans import pipeline
from kinweave.schemas import ARTIST_DOC, NODE_COLUMNS

TAIL = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d")]


def g(spark, edges):
    return spark.createDataFrame(edges, "u string, v string")


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_triangle_with_tail(spark):
    e = g(spark, TAIL)
    c = {r.node: r for r in graph_local.clustering(e).collect()}
    assert {k: v.triangles for k, v in c.items()} == {"a": 1, "b": 1, "c": 1, "d": 0}
    assert (c["a"].clust_local, c["c"].clust_local, c["d"].clust_local, c["c"].open_wedges) == (1.0, pytest.approx(1 / 3), 0.0, 2)
    assert by(graph_iterate.core_number(e), "node", "kcore") == {"a": 2, "b": 2, "c": 2, "d": 1}
    assert by(graph_local.open_dyads(e), "node", "open_dyads") == {"a": 1, "b": 1, "c": 0, "d": 2}
    s = {r.node: r for r in graph_local.edge_scores(e).collect()}
    assert s["a"].gwesp_score == pytest.approx(2 * (1 - math.exp(-0.5))) and s["d"].weak_tie_frac == 1.0


def test_paths_and_cliques(spark):
    p4 = g(spark, [("1", "2"), ("2", "3"), ("3", "4")])
    assert by(graph_traverse.betweenness(p4), "node", "betweenness") == pytest.approx({"1": 0, "2": 2 / 3, "3": 2 / 3, "4": 0})
    assert by(graph_traverse.closeness(p4), "node", "closeness") == pytest.approx({"1": 0.5, "2": 0.75, "3": 0.75, "4": 0.5})
    assert graph_traverse.approximate_diameter(p4, "2") == 3
    k4 = g(spark, [(x, y) for x in "abcd" for y in "abcd" if x < y])
    assert set(by(graph_iterate.core_number(k4), "node", "kcore").values()) == {3}
    assert graph_local.global_clustering(k4).first().transitivity == 1.0
    two = g(spark, [("a", "b"), ("c", "d"), ("d", "e")])
    assert by(graph_iterate.connected_components(two), "node", "component_size") == {"a": 2, "b": 2, "c": 3, "d": 3, "e": 3}
    d = by(graph_iterate.distance_to(two, spark.createDataFrame([("a",)], "node string")), "node", "distance")
    assert d["b"] == 1.0 and math.isinf(d["e"])


def test_attributes(spark):
    tri = [("a", "b"), ("a", "c"), ("b", "c")]
    for values, want in ((("x", "x", "y"), (0, 0)), (("x", "x", "x"), (1, 0)), (("x", "y", "z"), (0, 1)), ((None, None, None), (1, 0))):
        at = spark.createDataFrame(list(zip("abc", values, strict=True)), "node string, x string")
        r = graph_local.triangle_mixing(g(spark, tri), at, {"x": "x"}).where("node = 'a'").first()
        assert (r.tri_within_x, r.tri_cross_x) == want


def test_modularity_and_louvain(spark):
    e = g(spark, [("a", "b"), ("a", "c"), ("b", "c"), ("d", "e"), ("d", "f"), ("e", "f"), ("c", "d")])
    part = spark.createDataFrame([(x, int(x > "c")) for x in "abcdef"], "node string, community long")
    assert graph_local.modularity(e, part).first().modularity == pytest.approx(5 / 14)
    got = by(graph_community.louvain(e), "node", "community")
    assert got["a"] == got["b"] == got["c"] != got["d"] == got["e"] == got["f"]


def test_building(spark):
    dirty = spark.createDataFrame([(" a", "a"), ("a", "b"), ("b", "a "), ("", "b"), (None, "b")], "u string, v string")
    assert [(r.u, r.v) for r in graph_build.simple_graph(dirty).collect()] == [("a", "b")]
    work = [(1, "w", "2000", [], [("m1", ""), ("m2", "")]), (2, "undated", None, [], [("m1", ""), ("m3", "")])]
    docs = spark.createDataFrame([("m1", "A", "", None, None, work, [], []), ("m2", "B", "", None, None, work[:1], [], [])], ARTIST_DOC)
    assert [tuple(r) for r in graph_build.cowork_edges(docs).collect()] == [("m1", "m2", 2)]
    rec = spark.createDataFrame([("r1", "Song", [("X", "x", "composer"), ("Y", "", "Lyricist"), ("Z", "z", "producer")])], "recording_id string, recording_title string, authors array<struct<name: string, mbid: string, relation: string>>")
    assert [tuple(r) for r in graph_build.writer_graph(rec, ["composer", "lyricist"]).collect()] == [("Y", "x", 1, "Song")]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 1000))
def test_random_graphs_against_plain_python(spark, seed):
    r = random.Random(seed)
    n = r.randint(4, 12)
    pairs = sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(2 * n)})
    e = spark.createDataFrame(pairs, "u long, v long")
    a = H.adjacency(pairs)
    deg = by(graph_local.degree(e), "node", "degree")
    assert sum(deg.values()) == 2 * len(pairs)
    tri = by(graph_local.clustering(e), "node", "triangles")
    assert sum(tri.values()) == 3 * H.triangles(a)
    assert by(graph_iterate.core_number(e), "node", "kcore") == H.cores(a)
    assert {x.node: (x.component, x.component_size) for x in graph_iterate.connected_components(e).collect()} == H.components(a)
    assert by(graph_traverse.betweenness(e, None), "node", "betweenness") == pytest.approx(H.betweenness(a))
    assert by(graph_traverse.closeness(e), "node", "closeness") == pytest.approx(H.closeness(a))
    joins = {(x.source, x.node): x.distance for x in graph_traverse.distances_by_joins(e, graph_build.vertices(e)).collect()}
    held = {(x.source, x.node): x.distance for x in graph_traverse.distances(e, graph_build.vertices(e)).collect()}
    assert joins == held == {(s, v): d for s in a for v, d in H.bfs(a, s).items()}


def test_node_features_and_walks(spark):
    e = g(spark, TAIL)
    nodes = spark.createDataFrame([(x, "g", None, "r" + x) for x in "abcd"], "node string, primary_genre string, primary_label string, primary_role string")
    out = pipeline.node_features(e, nodes, {"primary_genre": "genre", "primary_label": "label", "primary_role": "role"})
    assert out.columns == list(NODE_COLUMNS) and out.count() == 4
    row = out.where("node = 'a'").first()
    assert (row.same_genre_share, row.same_label_share, row.same_role_share, row.tri_within_genre, row.component_size) == (1.0, 1.0, 0.0, 1, 4)
    w = graph_walks.walks(e, 5, 2, p=0.5, q=2.0).collect()
    a = H.adjacency(TAIL)
    assert len(w) == 8 and all(y in a[x] for r in w for x, y in zip(r.walk, r.walk[1:], strict=False))
    assert len(graph_walks.node2vec(e, 4, 5, 2).columns) == 5


def test_registered_betweenness_uses_the_operators_sources(spark, monkeypatch):
    """Exact, by paths of a tree, on a graph of more than 64 and less than 256 vertices."""
    from kinweave.plans import graph_queries

    n = 120
    parent = {i: (i * 7 % 11) * (i - 1) // 11 for i in range(1, n)}
    e = spark.createDataFrame([(p, i) for i, p in parent.items()], "u long, v long")
    monkeypatch.setattr(graph_queries, "edges", lambda spark, d: e)
    through = dict.fromkeys(range(n), 0)
    up = {0: [0]}
    for i in range(1, n):
        up[i] = [i, *up[parent[i]]]
    for i in range(n):
        for j in range(i):
            shared = set(up[i]) & set(up[j])
            top = next(x for x in up[i] if x in shared)
            for x in ({*up[i], *up[j]} - shared | {top}) - {i, j}:
                through[x] += 1
    got = {r.node: r.betweenness for r in graph_queries.betweenness(spark, None).collect()}
    assert got == {x: pytest.approx(2 * k / ((n - 1) * (n - 2)), abs=1e-8) for x, k in through.items()}


def test_hubs_and_popular_works_in_blocks(spark, monkeypatch):
    """Dealt to blocks of two, everything is as by plain pairs."""
    from itertools import combinations

    r = random.Random(2)
    rows = sorted({(r.randrange(4), r.randrange(15)) for _ in range(50)})
    want = {}
    for k in range(4):
        for p in combinations(sorted(n for w, n in rows if w == k), 2):
            want[p] = want.get(p, 0) + 1
    df = spark.createDataFrame(rows, "w int, n long")
    monkeypatch.setattr(graph_build, "BLOCK", 2)
    assert {(x.u, x.v): x.weight for x in graph_build.pair_counts(df, "w", "n").collect()} == want
    e = spark.createDataFrame(list(want), "u long, v long")
    a = H.adjacency(want)
    got = sorted(map(tuple, graph_local.two_steps(graph_local.both_ways(e), 2).collect()))
    assert got == sorted((s, d) for m in a for s in a[m] for d in a[m] if s != d)


def test_sampled_subgraphs(spark):
    ring = [(i, (i + 1) % 40) for i in range(40)]
    e = spark.createDataFrame([(min(p), max(p)) for p in ring], "u long, v long")
    got = graph_build.sampled_subgraph(e, 20, 3, attempts=50)
    assert got.count() >= 3 and graph_build.vertices(got).count() <= 20
    assert graph_build.sampled_subgraph(e, 2, 4, attempts=2).count() == 4
    m = graph_build.adjacency(e.withColumn("w", F.lit(2.0)), spark.createDataFrame([(0,), (1,), (5,)], "node long"), "node", "w")
    assert {(r.row, r.column): r.value for r in m.collect()} == {(x, y): 2.0 if {x, y} == {0, 1} else 0.0 for x in (0, 1, 5) for y in (0, 1, 5)}


def test_diameters_and_sampled_measures(spark, monkeypatch):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")]
    e = g(spark, pairs)
    a = H.adjacency(pairs)
    for bound in (graph_traverse.HELD_EDGES, 0):
        monkeypatch.setattr(graph_traverse, "HELD_EDGES", bound)
        assert by(graph_traverse.diameters(e), "component", "diameter") == {"a": 3, "x": 1}
        assert by(graph_traverse.path_lengths(e), "distance", "n") == {1: 8, 2: 4, 3: 2}
        drawn = [r.node for r in graph_traverse.sources(e, 3).collect()]
        reach = {v: [H.bfs(a, s)[v] for s in drawn if v in H.bfs(a, s)] for v in a}
        assert by(graph_traverse.closeness(e, 3), "node", "closeness") == pytest.approx({v: len(x) / sum(x) if sum(x) else 0.0 for v, x in reach.items()})
        assert by(graph_traverse.closeness(e), "node", "closeness") == pytest.approx(H.closeness(a))


def test_louvain_finds_planted_groups(spark):
    r = random.Random(3)
    pairs = sorted({tuple(sorted((10 * k + i, 10 * k + j))) for k in range(6) for i in range(10) for j in range(10) if i != j and r.random() < 0.6} | {(10 * k, 10 * k + 10) for k in range(5)})
    e = spark.createDataFrame(pairs, "u long, v long")
    got = by(graph_community.louvain(e), "node", "community")
    assert all(len({got[10 * k + i] for i in range(10)}) == 1 for k in range(6)) and len(set(got.values())) == 6
