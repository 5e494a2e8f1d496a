"""Graph operators in the forms that no task or driver holds the graph for, against plain Python and the kernels."""

import random
from collections import Counter

import helpers as H
import numpy as np
import pytest

from kinweave.operators import graph_build, graph_community, graph_traverse, graph_walks


def by(df, k, v):
    return {r[k]: r[v] for r in df.collect()}


def simple(pairs):
    return sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]})


def quality(edges, label):
    m2, inside, total = 2 * sum(e[2] for e in edges), 0.0, Counter()
    for u, v, w in edges:
        inside += w * (label[u] == label[v])
        total[label[u]] += w
        total[label[v]] += w
    return 2 * inside / m2 - sum(x * x for x in total.values()) / m2 / m2


def planted(r, groups, size, links, inside):
    n = groups * size
    return simple((a := r.randrange(n), a // size * size + r.randrange(size) if r.random() < inside else r.randrange(n)) for _ in range(links))


@pytest.mark.parametrize("seed", [1, 2])
def test_louvain_by_tables(spark, seed):
    """Modularity within 0.01 of moving vertex after vertex on one machine, with and without a last level in one task; the same again."""
    r = random.Random(seed)
    pairs = planted(r, 6, 20, 500, 0.6) if seed == 1 else simple((r.randrange(150), r.randrange(150)) for _ in range(600))
    edges = [(u, v, float(r.choice([1, 1, 2]))) for u, v in pairs]
    names, at = np.unique(np.array([e[:2] for e in edges]), return_inverse=True)
    at = at.reshape(-1, 2)
    kernel = graph_community.louvain_labels(at[:, 0], at[:, 1], np.array([e[2] for e in edges]), len(names))
    want = quality(edges, dict(zip(names.tolist(), kernel.tolist(), strict=True)))
    df = spark.createDataFrame(edges, "u long, v long, weight double").repartition(3)
    got = by(graph_community.louvain(df, held_edges=0 if seed == 1 else graph_community.HELD_EDGES), "node", "community")
    assert set(got) == set(names.tolist())
    assert quality(edges, got) >= want - 0.01
    if seed == 1:
        return
    small = df.where("u < 40 and v < 40")
    assert by(graph_community.louvain(small.repartition(5), refine=0), "node", "community") == by(graph_community.louvain(small, refine=0), "node", "community")


def test_louvain_of_odd_graphs(spark):
    assert graph_community.louvain(spark.createDataFrame([], "u long, v long")).count() == 0
    loops = spark.createDataFrame([(1, 1, 5.0), (1, 2, 1.0), (3, 4, None), (None, 4, 1.0)], "u long, v long, weight double")
    got = by(graph_community.louvain(loops), "node", "community")
    assert got[3] == got[4] and set(got) == {1, 2, 3, 4}


def test_betweenness_by_tables(spark, monkeypatch):
    r = random.Random(5)
    pairs = simple([(r.randrange(25), r.randrange(25)) for _ in range(45)] + [(100, 101), (101, 102)])
    e = spark.createDataFrame(pairs, "u long, v long").repartition(3)
    monkeypatch.setattr(graph_traverse, "HELD_EDGES", 0)
    want = H.betweenness(H.adjacency(pairs))
    assert by(graph_traverse.betweenness(e, None), "node", "betweenness") == pytest.approx(want, abs=1e-9)
    sample = graph_traverse.sources(e, 7)
    in_batches = by(graph_traverse.dependencies_by_joins(e, sample, batch_pairs=110), "node", "b")
    assert {k: v for k, v in in_batches.items() if v} == pytest.approx({k: v for k, v in by(graph_traverse.dependencies_by_joins(e, sample), "node", "b").items() if v})


@pytest.mark.parametrize("held", [True, False])
def test_diameters_by_bounds(spark, monkeypatch, held):
    """Exact on a giant component with under a tenth of its vertices searched from."""
    if not held:
        monkeypatch.setattr(graph_traverse, "HELD_EDGES", 0)
    r = random.Random(6)
    n = 500 if held else 50
    pairs = simple([(i, r.randrange(i)) for i in range(1, n)] + [(r.randrange(n), r.randrange(n)) for _ in range(n // 4)] + [(2000, 2001)])
    if not held:
        pairs += simple((1000 + i, 1000 + (i + 1) % 9) for i in range(9))
    a = H.adjacency(pairs)
    want = {}
    for v, (c, _) in H.components(a).items():
        want[c] = max(want.get(c, 0), max(H.bfs(a, v).values()))
    count = {}
    assert by(graph_traverse.diameters(spark.createDataFrame(pairs, "u long, v long").repartition(3), searches=2, held_bounds=count), "component", "diameter") == want
    if held:
        assert count["searches"] < n / 10


def test_neighbourhoods_by_sketches(spark):
    """Closeness and distances of all vertices within four standard errors; exact where balls are small."""
    r = random.Random(7)
    pairs = simple([(r.randrange(200), r.randrange(200)) for _ in range(500)] + [(500, 501), (501, 502)])
    a = H.adjacency(pairs)
    e = spark.createDataFrame(pairs, "u long, v long").repartition(3)
    got, want = by(graph_traverse.sketched_closeness(e, 12), "node", "closeness"), H.closeness(a)
    assert all(got[v] == pytest.approx(want[v], rel=4 * 1.04 / 64) for v in a)
    assert got[500] == pytest.approx(want[500]) and got[501] == pytest.approx(want[501])
    lengths = Counter(d for v in a for d in H.bfs(a, v).values() if d)
    about = by(graph_traverse.sketched_path_lengths(e, 12), "distance", "n")
    total = sum(lengths.values())
    assert sum(about.values()) == pytest.approx(total, rel=0.07)
    assert all(abs(about.get(d, 0) - n) < 0.07 * total for d, n in lengths.items())


# ---- walks ---------------------------------------------------------------------


def test_walk_transitions(spark, monkeypatch):
    """Shares of first and second steps against exact probabilities, with ranges of two neighbours; the same again."""
    monkeypatch.setattr(graph_walks, "RANGE", 2)
    monkeypatch.setattr(graph_walks, "RUN", 3)
    links = [(0, 1, 3.0), (0, 2, 1.0), (1, 2, 2.0), (1, 3, 1.0), (2, 4, 5.0), (3, 4, 1.0), (0, 5, 0.5), (0, 6, 1e-3), (0, 7, 2.0)]
    weight = {**{(a, b): w for a, b, w in links}, **{(b, a): w for a, b, w in links}}
    e = spark.createDataFrame(links, "u long, v long, weight double").repartition(3)
    n = 4000
    for p, q in ((1.0, 1.0), (0.25, 2.0)):
        w = graph_walks.walks(e, 3, n, p=p, q=q).collect()
        assert len(w) == 8 * n and all(len(x.walk) == 3 for x in w)
        seen = Counter(tuple(map(int, x.walk)) for x in w)
        first = Counter(k[:2] for k in seen.elements())
        for (a, b), m in first.items():
            share = weight[a, b] / sum(x for (s, _), x in weight.items() if s == a)
            assert m / n == pytest.approx(share, abs=4 * (share * (1 - share) / n) ** 0.5 + 1e-9), (a, b)
            bias = {d: x * (1 / p if d == a else 1.0 if (a, d) in weight else 1 / q) for (s, d), x in weight.items() if s == b}
            for d, x in bias.items():
                s = x / sum(bias.values())
                assert seen[a, b, d] / m == pytest.approx(s, abs=4.5 * (s * (1 - s) / m) ** 0.5 + 1e-9), (a, b, d)
    again = graph_walks.walks(e.repartition(5), 3, 3, p=0.25, q=2.0).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, graph_walks.walks(e, 3, 3, p=0.25, q=2.0).collect()))


def test_embeddings_of_planted_groups(spark):
    """Neighbours lie closer than strangers; training is dealt to blocks, none of its stages to one task."""
    r = random.Random(2)
    pairs = planted(r, 4, 25, 900, 0.93)
    rows = graph_walks.node2vec(spark.createDataFrame(pairs, "u long, v long").repartition(3), 16, length=8, per_node=6, window=5).collect()
    v = {int(x[0]): np.array(x[1:]) for x in rows}
    names = sorted(v)
    m = np.array([v[i] / np.linalg.norm(v[i]) for i in names])
    same = np.equal.outer(np.array(names) // 25, np.array(names) // 25)
    near = m @ m.T
    assert near[same].mean() > near[~same].mean() + 0.3
    assert set(names) == {x for p in pairs for x in p}


def test_pairs_of_a_window(spark):
    got = graph_walks.window_pairs(spark.createDataFrame([("a", ["a", "b", "c", "b"])], "node string, walk array<string>"), 2)
    assert Counter((x.node, x.context) for x in got.collect()) == Counter([("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "b"), ("c", "b"), ("b", "c")])


def test_hub_is_dealt_to_ranges(spark):
    """A vertex of 500 neighbours is drawn from by ranges; a range holds few of them."""
    e = spark.createDataFrame([(0, i, float(i)) for i in range(1, 501)], "u long, v long, weight double")
    h = graph_walks.hoods(e)
    per = Counter((x.src, x.range) for x in h.select("src", "range").collect())
    assert len([k for k in per if k[0] == "0"]) == 32 and max(per.values()) < 150
    assert graph_build.vertices(e.select("u", "v")).count() == 501
