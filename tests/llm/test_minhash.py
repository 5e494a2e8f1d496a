import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import same, words_of
from pyspark.sql import functions as F

from kinweave.llm import common as C
from kinweave.llm import components as CC
from kinweave.llm import minhash as X


def runs(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def labelled(rows):
    """((doc_id, text), class number) of each row by all pairs."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [runs(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a | b and len(a & b) >= 0.8 * len(a | b)):
                parent[find(i)] = find(j)
    return [(r, find(i)) for i, r in enumerate(rows)]


def brute(rows):
    """doc_id and class_id of each row."""
    ids = {}
    for (d, _), c in labelled(rows):
        ids.setdefault(c, []).append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((d, least[c]) for (d, _), c in labelled(rows)), key=str)


def test_classes(docs, corpus, clashing, nothing):
    got = X.near_duplicates(docs)
    assert sorted(map(tuple, got.collect()), key=str) == brute([c[:2] for c in corpus])
    assert same(got, X.near_duplicates(clashing))
    assert X.near_duplicates(nothing).count() == 0


def test_large_family(spark):
    """Copies of one text with edits of all degrees: no link between different texts is lost."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 160):
        t = list(base)
        for _ in range(r.randint(1, 14)):
            t[r.randrange(len(t))] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, X.near_duplicates(df).collect()), key=str) == brute(rows)
    assert sorted(map(tuple, X.near_duplicates(df, X.NearDup(slice_texts=5)).collect()), key=str) == brute(rows)


def test_one_of_each_class_stays(docs, corpus, nothing):
    """Also where texts of one id are in different classes."""
    kept = X.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({c for _, c in labelled([c[:2] for c in corpus])})
    assert X.drop_near_duplicates(nothing).count() == 0
    nameless = docs.limit(0).unionByName(docs.sparkSession.createDataFrame([(None, f"{i} other words than all the rest have", "en", "s", 1) for i in range(3)], docs.schema))
    assert X.drop_near_duplicates(nameless).count() == 3


def test_signature_estimates_probability_jaccard():
    a = Counter({f"x{i} y z u v{i % 7}": 1 + i % 3 for i in range(60)})
    b = Counter({k: v for i, (k, v) in enumerate(a.items()) if i % 4}) + Counter({f"new{i} y z u v": 2 for i in range(10)})
    texts = [" ".join(k for k, v in c.items() for _ in range(v)) for c in (a, b)]
    body, off = C.utf8(pa.array(texts))
    e, row, w = X.weighted_sets(body, off, 5)
    sig = np.stack([X.signatures(e, row, w, 2, 512, seed) for seed in range(8)], axis=1).reshape(2, -1)
    sets = [dict(zip(e[row == i].tolist(), w[row == i].tolist(), strict=True)) for i in range(2)]
    want = 0.0
    for d in sets[0].keys() & sets[1].keys():
        want += 1 / sum(max(sets[0].get(x, 0) / sets[0][d], sets[1].get(x, 0) / sets[1][d]) for x in sets[0].keys() | sets[1].keys())
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.03)


def test_overlap_bound_is_a_bound(spark, corpus):
    rows = [(i, c[1]) for i, c in enumerate(corpus) if c[1] and words_of(c[1])]
    df = spark.createDataFrame(rows, "key long, text string")
    got = {r.key: r for r in X.overlap_bounds(df, X.NearDup(), 2).collect()}
    sets = {k: runs(t) for k, t in rows}
    for k, s in sets.items():
        assert got[k]["size"] == len(s)
        assert got[k].common == sum(any(g in o for j, o in sets.items() if j != k) for g in s)
        for j, o in sets.items():
            if j != k:
                assert len(s & o) <= sum(min(got[k][f"c{i}"], got[j][f"c{i}"]) for i in range(X.BINS))


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 1), (5, 5)]
    got = {x.node: x.root for x in CC.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(parent)}
    assert CC.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_key_matches(spark, corpus):
    df = spark.createDataFrame([(c[1],) for c in corpus if c[1] and words_of(c[1])], "text string")
    digest = C.digest_of(F.col("text"))
    native = sorted(map(tuple, df.select(C.key_of(digest), digest).collect()))
    assert native == sorted((r.key, r.digest) for r in X.sketch(df.withColumn("doc_id", F.lit(1))).collect())


def test_clashing_keys(docs, corpus, monkeypatch):
    """Texts are told apart by their whole digest when their keys are the same."""
    real = X.sketch
    monkeypatch.setattr(X, "sketch", lambda d, how: real(d, how).withColumn("key", F.lit(7).cast("long")))
    assert sorted(map(tuple, X.near_duplicates(docs).collect()), key=str) == brute([c[:2] for c in corpus])


def test_frequent_passages_lose_no_link(spark):
    """Sets that are alike are found however often one text repeats a passage."""
    rows = []
    for i in range(6):
        common = [f"c{i}x{j}" for j in range(304)]
        passage = [f"p{i}x{j}" for j in range(14)]
        rows += [(2 * i, " ".join(common + passage)), (2 * i + 1, " ".join(common + passage * 80))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, X.near_duplicates(df).collect()), key=str) == brute(rows)
