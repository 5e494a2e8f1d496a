"""Shapley values of fitted trees: what each feature adds to each row's prediction.

The value of a set of features is a tree's mean prediction when only these are
known: at a split on another feature both branches are taken, by the share of
training rows that went there (path-dependent). That value is a sum over
leaves of products, one factor for each feature on the leaf's path, so a leaf's
Shapley values follow from the coefficients of a small polynomial, exactly, in
time square in the path's length and not exponential in the features.

A fitted model's trees are small tables (trees times nodes), read by the driver;
rows are explained where they lie, in Arrow batches, without a shuffle.
"""

from __future__ import annotations

from math import factorial

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.validate import forget, scratch


class Leaf:
    """A leaf's value, and for each feature on its path the share of rows that its splits let through and the values that pass."""

    def __init__(self, value: float):
        self.value, self.share, self.tests = value, {}, {}


def leaves(nodes: dict[int, dict], weight: float = 1.0) -> list[Leaf]:
    """nodes: id -> prediction, rows, left, right, feature, threshold (or a set of categories that go left)."""
    out = []

    def down(i: int, path: list[tuple]):
        x = nodes[i]
        if x["left"] < 0:
            leaf = Leaf(weight * x["prediction"])
            for feature, share, test in path:
                leaf.share[feature] = leaf.share.get(feature, 1.0) * share
                leaf.tests.setdefault(feature, []).append(test)
            out.append(leaf)
            return
        for side in ("left", "right"):
            down(x[side], [*path, (x["feature"], nodes[x[side]]["rows"] / x["rows"], (x["threshold"], x["categories"], side == "left"))])

    down(0, [])
    return out


def trees_of(model) -> list[tuple[dict[int, dict], float]]:
    """(nodes, weight) of each tree of a fitted tree, forest or boosting model, by way of its saved form."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = scratch(spark, "trees")
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    if "treeID" not in saved.columns:
        saved = saved.select(F.lit(0).alias("treeID"), F.struct(*saved.columns).alias("nodeData"))
    rows = saved.collect()  # a row for each node of the model
    weights = getattr(model, "treeWeights", None) or [1.0]
    scale = 1.0 if "GBT" in type(model).__name__ else 1.0 / len(weights)
    trees = [({}, float(w) * scale) for w in weights]
    for r in rows:
        n, split = r["nodeData"], r["nodeData"]["split"]
        values = list(split["leftCategoriesOrThreshold"] or [])
        category = split["numCategories"] != -1
        trees[r["treeID"]][0][n["id"]] = {
            "prediction": n["prediction"], "rows": float(n["impurityStats"][0]), "left": n["leftChild"], "right": n["rightChild"], "feature": split["featureIndex"],
            "threshold": None if category or not values else values[0], "categories": frozenset(values) if category else None,
        }
    forget_path = spark.createDataFrame([], "x int")
    forget_path._kinweave_path = path
    forget(forget_path)
    return trees


def _passes(x: np.ndarray, tests: list[tuple]) -> np.ndarray:
    """1.0 where a feature's value goes the leaf's way at all of its splits."""
    ok = np.ones(len(x), bool)
    for threshold, categories, left in tests:
        ok &= (np.isin(x, list(categories)) if categories is not None else x <= threshold) == left
    return ok.astype(float)


def contributions(all_leaves: list[Leaf], x: np.ndarray) -> tuple[np.ndarray, float]:
    """(rows, features) Shapley values, and the mean prediction that they are counted from."""
    out, base = np.zeros(x.shape), 0.0
    for leaf in all_leaves:
        names = list(leaf.share)
        m = len(names)
        share = [leaf.share[f] for f in names]
        base += leaf.value * float(np.prod(share))
        goes = [_passes(x[:, f], leaf.tests[f]) for f in names]
        weight = [factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)]
        for i, f in enumerate(names):
            # coefficients by the number of known features among the others
            poly = [np.ones(len(x))]
            for j in range(m):
                if j != i:
                    up = [c * goes[j] for c in poly]
                    poly = [c * share[j] for c in poly] + [np.zeros(len(x))]
                    for k, c in enumerate(up):
                        poly[k + 1] = poly[k + 1] + c
            out[:, f] += leaf.value * (goes[i] - share[i]) * sum(w * c for w, c in zip(weight, poly, strict=True))
    return out, base


def shapley_values(model, rows: DataFrame, vector: str, features: list[str], keep: list[str] = ()) -> DataFrame:
    """keep, base, shap_<feature> ...: contributions that add up, with base, to the model's prediction. model: the fitted tree stage; vector: the assembled features."""
    held = [leaf for nodes, weight in trees_of(model) for leaf in leaves(nodes, weight)]
    n, own = len(features), list(keep)
    kinds = dict(rows.dtypes)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            x = np.array(pdf["__x"].tolist(), float).reshape(len(pdf), n)
            values, base = contributions(held, x)
            yield pd.concat([pdf[own].reset_index(drop=True), pd.DataFrame({"base": np.full(len(pdf), base)}), pd.DataFrame(values, columns=[f"shap_{f}" for f in features])], axis=1)

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in own], "base double", *[f"`shap_{f}` double" for f in features]])
    return rows.select(*own, vector_to_array(vector).alias("__x")).mapInPandas(run, schema)


def shapley_importance(values: DataFrame, features: list[str]) -> DataFrame:
    """feature, importance: the mean size of its contributions."""
    one = values.agg(*[F.avg(F.abs(f"shap_{f}")).alias(f) for f in features])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("importance")) for f in features])))
