"""Shapley values, target statistics, the small network and the halving search."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from kinweave.operators import ergm, explain, model, neural, target_statistics
from kinweave.operators.relational import regression_metrics


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    out = []
    for i in range(600):
        a, b, c, k = r.gauss(0, 1), r.random(), float(r.randrange(4)), r.choice(["p", "q", "r", "s", None])
        out.append((i, a, b, c, k, 3 * (a > 0) * b + c * (k == "q") + math.sin(3 * a) + r.gauss(0, 0.05)))
    return spark.createDataFrame(out, "k long, a double, b double, c double, cat string, y double").cache()


def test_shapley_values_add_up_and_equal_enumeration(spark, rows):
    names = ["a", "b", "c"]
    v = VectorAssembler(inputCols=names, outputCol="f").transform(rows)
    fitted = GBTRegressor(featuresCol="f", labelCol="y", maxIter=4, maxDepth=3, seed=1).fit(v)
    got = explain.shapley_values(fitted, fitted.transform(v), "f", names, ["k", "prediction"]).collect()
    assert len(got) == 600
    for r in got:
        assert r.base + sum(r[f"shap_{n}"] for n in names) == pytest.approx(r.prediction, abs=1e-9)
    trees = explain.trees_of(fitted)

    def value(nodes, i, x, known):
        t = nodes[i]
        if t["left"] < 0:
            return t["prediction"]
        if t["feature"] in known:
            return value(nodes, t["left"] if x[t["feature"]] <= t["threshold"] else t["right"], x, known)
        return sum(nodes[t[s]]["rows"] / t["rows"] * value(nodes, t[s], x, known) for s in ("left", "right"))

    data = {r.k: (r.a, r.b, r.c) for r in rows.collect()}
    for r in got[:15]:
        whole = lambda known, x=data[r.k]: sum(w * value(n, 0, x, known) for n, w in trees)
        for i, n in enumerate(names):
            rest = [j for j in range(3) if j != i]
            want = sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (whole({*s, i}) - whole(set(s))) for m in range(3) for s in itertools.combinations(rest, m))
            assert r[f"shap_{n}"] == pytest.approx(want, abs=1e-9)
    order = [x.feature for x in explain.shapley_importance(explain.shapley_values(fitted, v, "f", names), names).orderBy(F.desc("importance")).collect()]
    assert set(order) == set(names)


def test_ordered_statistic(spark, rows):
    got = target_statistics.ordered_statistic(rows, "k", "cat", "y", "s", weight=2.0, bucket=20).collect()
    import hashlib

    mean = sum(r.y for r in got) / len(got)
    before = {}
    for r in sorted(got, key=lambda r: (hashlib.md5(f"42:{r.k}".encode()).hexdigest(), r.k)):
        s, n = before.get(r.cat, (0.0, 0))
        assert r.s == pytest.approx((s + 2 * mean) / (n + 2))
        before[r.cat] = (s + r.y, n + 1)
    test = spark.createDataFrame([("q",), ("new",), (None,)], "cat string")
    whole = {r.cat: r.s for r in target_statistics.whole_statistic(rows, test, "cat", "y", "s", 2.0).collect()}
    assert whole["new"] == pytest.approx(mean) and whole["q"] == pytest.approx((before["q"][0] + 2 * mean) / (before["q"][1] + 2))
    assert whole[None] == pytest.approx((before[None][0] + 2 * mean) / (before[None][1] + 2))


def test_statistics_of_rare_categories_beat_indices(spark):
    """Held-out error of boosting on many categories of a few rows each. (With few categories of many rows Spark's own splits of indices do better.)"""
    r = random.Random(4)
    effect = {f"c{i}": r.gauss(0, 1) for i in range(500)}
    data = [(i, c := r.choice(list(effect)), x := r.random(), effect[c] + x + r.gauss(0, 0.2)) for i in range(2500)]
    df = spark.createDataFrame(data, "k long, cat string, x double, y double")
    train, test = df.where("k % 5 <> 0").cache(), df.where("k % 5 = 0").cache()
    rmse = lambda p, a, b: regression_metrics(p.fit(a).transform(b), "y", "prediction").first().rmse
    index = rmse(model.pipeline(["x", "cat"], "y", ["cat"], maxIter=8, maxDepth=3, seed=1, maxBins=512), train, test)
    a, b = target_statistics.encoded(train, test, "k", ["cat"], "y")
    stat = rmse(model.pipeline(["x", "cat_stat"], "y", maxIter=8, maxDepth=3, seed=1), a, b)
    print("indices", index, "statistics", stat)
    assert stat <= index


def test_network_gradient():
    r = np.random.default_rng(1)
    weights, x, y = neural.start([3, 5, 4, 1], 2), r.normal(size=(7, 3)), r.normal(size=7)
    _, g = neural.gradient(weights, x, y)
    for i, w in enumerate(weights):
        for at in list(np.ndindex(w.shape))[:6]:
            held, step = w[at], 1e-6
            w[at] = held + step
            up = neural.gradient(weights, x, y)[0]
            w[at] = held - step
            down = neural.gradient(weights, x, y)[0]
            w[at] = held
            assert g[i][at] == pytest.approx((up - down) / (2 * step), rel=1e-4, abs=1e-6)


def test_network_beats_the_linear_model(spark, rows, monkeypatch):
    train, test = rows.where("k % 4 <> 0"), rows.where("k % 4 = 0")
    net = neural.fit(train, "k", ["a", "b", "c"], "y", hidden=(24, 12), epochs=25, batch_rows=150, rate=0.015)
    got = regression_metrics(net.predict(test), "y", "prediction").first().rmse
    linear = regression_metrics(model.scaled_linear(["a", "b", "c"], "y").fit(train).transform(test), "y", "prediction").first().rmse
    assert got < 0.85 * linear
    monkeypatch.setattr(neural, "FEW", 0)  # sums in two rounds of tasks
    again = neural.fit(train.limit(40), "k", ["a", "b"], "y", hidden=(4,), epochs=2, batch_rows=20)
    assert all(np.isfinite(w).all() for w in again.weights)


def test_halving_search(spark, rows):
    space = {"regParam": (0.0, 2.0), "elasticNetParam": [0.0, 0.5]}
    search = lambda: model.halving_search(rows, "k", ["a", "b", "c"], "y", space, candidates=4, factor=2, kind="linear", folds=2).collect()
    got = search()
    assert [sum(r.rung == i for r in got) for i in range(3)] == [4, 2, 1]  # fits, of two folds each
    n = [max(r.rows for r in got if r.rung == i) for i in range(3)]
    assert n[0] < n[1] < n[2] == 600
    assert [r.parameters for r in got if r.rung == 1] and {r.parameters for r in got if r.rung == 1} == {r.parameters for r in got if r.rung == 0 and r.kept}
    assert got == search()


def all_dyads(spark, n, edges, extra=lambda u, v: {}):
    rows = [(u, v, int((u, v) in edges), 1.0, *extra(u, v).values()) for u, v in itertools.combinations(range(n), 2)]
    return spark.createDataFrame(rows, ", ".join(["u long, v long, edge int, weight double", *[f"{k} double" for k in extra(0, 1)]]))


def newton(x, y, w, steps=50):
    """Estimates and standard errors of a weighted logistic regression."""
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ b))
        info = x.T @ (x * (w * p * (1 - p))[:, None])
        b = b + np.linalg.solve(info, x.T @ (w * (y - p)))
    return b, np.sqrt(np.diag(np.linalg.inv(info)))


def test_block_model_equals_the_full_fit(spark):
    """Non-edges drawn within and between blocks at their own rates, and a covariate of the pair: as if all pairs were there."""
    r = random.Random(3)
    n, block = 40, [i % 3 for i in range(40)]
    near = {(u, v): float((u * v) % 5) for u, v in itertools.combinations(range(n), 2) if (u + v) % 4 == 0}
    edges = {p for p in itertools.combinations(range(n), 2) if r.random() < (0.5 if block[p[0]] == block[p[1]] else 0.12) + 0.05 * (near.get(p, 0) > 2)}
    e = spark.createDataFrame(sorted(edges), "u long, v long")
    nodes = spark.createDataFrame([(i, f"b{block[i]}") for i in range(n)], "node long, block string")
    pairs = spark.createDataFrame([(v, u, x) for (u, v), x in near.items()], "u long, v long, near double")
    dy = ergm.block_dyads(e, nodes, "node", "block", within=30, between=30)
    assert dy.groupBy("u", "v").count().where("count > 1").count() == 0 and dy.where("edge = 1").count() == len(edges)
    assert dy.agg(F.sum("weight")).first()[0] == pytest.approx(n * (n - 1) / 2)
    dy = ergm.pair_covariate(dy, pairs, "near", "near").cache()
    terms = ["match_block", "edgecov_near"]
    got = ergm.fit(dy, terms)
    full = list(itertools.combinations(range(n), 2))
    x = np.array([[1.0, block[u] == block[v], near.get((u, v), 0.0)] for u, v in full], float)
    want, error = newton(x, np.array([p in edges for p in full], float), np.ones(len(full)))
    assert [got["edges"], got["match_block"], got["edgecov_near"]] == pytest.approx(want, abs=0.06)
    table = {t.term: t for t in ergm.inference(dy, got).collect()}
    assert [table[t].std_error for t in ("edges", *terms)] == pytest.approx(error, rel=0.05)
    few = ergm.block_dyads(e, nodes, "node", "block", within=1, between=1)
    assert few.count() < dy.count() and few.agg(F.sum("weight")).first()[0] == pytest.approx(n * (n - 1) / 2)


def test_a_failed_formula_says_why(spark):
    dy = all_dyads(spark, 4, set())
    assert ergm.ladder(dy, {"none": []}).first().term.startswith("failed: ")
