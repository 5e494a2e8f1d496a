"""Regression on the model table with Spark ML: folds, grids, importances, segments.

Gradient-boosted trees stand in for the boosted libraries of other stacks; their
numbers are their own.
"""

from __future__ import annotations

import ast

from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.relational import regression_metrics

REGRESSORS = {"gbt": GBTRegressor, "linear": LinearRegression, "forest": RandomForestRegressor}


def parse_params(row: dict) -> dict:
    """{'model__depth': '8'} -> {'depth': 8}: parameters of a stored search, prefixes cut, values read as literals."""
    out = {}
    for k, v in row.items():
        try:
            v = ast.literal_eval(v) if isinstance(v, str) else v
        except (ValueError, SyntaxError):
            pass
        out[k.split("__")[-1]] = v
    return out


def pipeline(features: list[str], label: str, categorical: list[str] = (), kind: str = "gbt", **params) -> Pipeline:
    """Categories are indexed, unseen ones apart; nulls in numbers must be filled before."""
    index = [StringIndexer(inputCol=c, outputCol=f"__i_{c}", handleInvalid="keep") for c in categorical]
    columns = [f"__i_{c}" if c in categorical else c for c in features]
    vector = VectorAssembler(inputCols=columns, outputCol="__features", handleInvalid="keep" if kind == "gbt" else "error")
    return Pipeline(stages=[*index, vector, REGRESSORS[kind](featuresCol="__features", labelCol=label, **params)])


def cross_validate(df: DataFrame, key: str, estimator: Pipeline, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """fold, rmse, mae, r2 of each fold held out; a row's fold is a hash of its key."""
    df = df.withColumn("__fold", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds)))
    out = None
    for i in range(folds):
        got = estimator.fit(df.where(F.col("__fold") != i)).transform(df.where(F.col("__fold") == i))
        row = regression_metrics(got, label, "prediction").withColumn("fold", F.lit(i))
        out = row if out is None else out.unionByName(row)
    return out.select("fold", "rmse", "mae", "r2")


def fold_summary(folds: DataFrame) -> DataFrame:
    """metric, mean, sd (of the population) over the folds of cross_validate()."""
    names = ["rmse", "mae", "r2"]
    one = folds.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("sd")) for c in names])))


def codes(df: DataFrame, columns: list[str], training: DataFrame) -> DataFrame:
    """<c>_code: the place of a value among the sorted values of the training rows; null for null and for values that these don't have."""
    for c in columns:
        values = training.where(F.col(c).isNotNull()).agg(F.array_sort(F.collect_set(c)).alias("__v"))
        place = F.nullif(F.array_position("__v", F.col(c)), F.lit(0).cast("long"))
        df = df.join(F.broadcast(values), F.lit(True)).withColumn(f"{c}_code", (place - 1).cast("double")).drop("__v")  # one row of a category's values
    return df


def scaled_linear(features: list[str], label: str, **params) -> Pipeline:
    """Standardised features into a linear model; neural.fit() has the small neural network."""
    from pyspark.ml.feature import StandardScaler

    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="__features", withMean=True), LinearRegression(featuresCol="__features", labelCol=label, **params)])


def top_importances(importances: dict[str, float], spark, k: int = 15) -> DataFrame:
    """feature, importance of the k most important, greatest first."""
    best = sorted(importances.items(), key=lambda x: (-x[1], x[0]))[:k]
    return spark.createDataFrame([(n, float(v)) for n, v in best], "feature string, importance double")


def save(model, path: str, summary: DataFrame | None = None, status: str = "ok") -> None:
    """The fitted pipeline, its summary table and a status line below path; see load()."""
    model.write().overwrite().save(f"{path}/model")
    if summary is not None:
        summary.write.mode("overwrite").option("header", True).csv(f"{path}/summary")
        summary.sparkSession.createDataFrame([(status,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/status")


def load(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{path}/model")


def grid_search(df: DataFrame, key: str, features: list[str], label: str, grid: list[dict], kind: str = "gbt", folds: int = 3) -> list[tuple[dict, float]]:
    """(parameters, mean rmse), best first; the grid's size is the caller's."""
    got = []
    for params in grid:
        rmse = cross_validate(df, key, pipeline(features, label, kind=kind, **params), label, folds).agg(F.avg("rmse")).first()[0]
        got.append((params, rmse))
    return sorted(got, key=lambda x: x[1])


def drawn_parameters(space: dict[str, list | tuple], n: int, seed: int = 42) -> list[dict]:
    """n settings drawn from a space: a list is one of its values, a tuple (low, high) a number between, whole if both are; repeats are left out."""
    import random

    r, out = random.Random(seed), []
    for _ in range(20 * n):
        one = {k: r.choice(v) if isinstance(v, list) else r.randint(*v) if all(isinstance(x, int) for x in v) else r.uniform(*v) for k, v in sorted(space.items())}
        if one not in out:
            out.append(one)
        if len(out) == n:
            break
    return out


def halving_search(df: DataFrame, key: str, features: list[str], label: str, space: dict[str, list | tuple], candidates: int = 27, factor: int = 3, share: float | None = None, kind: str = "gbt", folds: int = 3, seed: int = 42, categorical: list[str] = ()) -> DataFrame:
    """rung, rows, parameters (a string), rmse, kept: random search by successive halving.

    The first rung tries all candidates on a small sample of rows, each further rung the best 1 / factor of them on factor
    times as many rows, until one is left or all rows are used. Samples are by a hash of the key, each inside the next, so
    a rerun chooses the same. share: the first rung's share of rows; by default the last rung has all.
    """
    spark, left, out = df.sparkSession, drawn_parameters(space, candidates, seed), []
    rungs = 0
    while factor ** (rungs + 1) <= len(left):
        rungs += 1
    share = share or factor**-rungs
    drawn = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 11) / F.lit(float(1 << 53))
    rung = 0
    while True:
        rows = df.where(drawn < min(1.0, share * factor**rung))
        n, got = rows.count(), []
        for params in left:
            rmse = cross_validate(rows, key, pipeline(features, label, categorical, kind, **params), label, folds, seed).agg(F.avg("rmse")).first()[0]
            got.append((float("inf") if rmse is None else rmse, left.index(params), params))
        got.sort(key=lambda x: x[:2])
        last = len(left) == 1 or share * factor**rung >= 1
        left = [x[2] for x in got[: 1 if last else max(1, len(got) // factor)]]
        out += [(rung, n, repr(params), rmse, params in left) for rmse, _, params in got]
        if last:
            return spark.createDataFrame(out, "rung int, rows long, parameters string, rmse double, kept boolean")
        rung += 1


def permutation_importance(model, df: DataFrame, features: list[str], label: str, seed: int = 1) -> dict[str, float]:
    """Rise of rmse when a column is taken from another row (a shifted order by hash); explain.shapley_values() has Shapley values."""
    from pyspark.sql.window import Window as W

    base = regression_metrics(model.transform(df), label, "prediction").first()["rmse"]
    out = {}
    for c in features:
        order = W.partitionBy(F.pmod(F.xxhash64(*[F.col(f).cast("string") for f in features]), F.lit(64))).orderBy(F.xxhash64(F.col(c).cast("string"), F.lit(seed)))
        shuffled = df.withColumn("__moved", F.coalesce(F.lag(c).over(order), F.col(c))).drop(c).withColumnRenamed("__moved", c)
        out[c] = regression_metrics(model.transform(shuffled), label, "prediction").first()["rmse"] - base
    return out


def rank_segment(df: DataFrame, years: str, estimator: Pipeline, limit: float = 5, keep: list[str] = ()) -> DataFrame:
    """Fit on rows of more than `limit` years, predict those of fewer: prediction, back-transformed score, rank."""
    model = estimator.fit(df.where(F.col(years) > limit))
    got = model.transform(df.where(F.col(years) < limit))
    return got.select(*keep, "prediction", F.greatest(F.expm1("prediction") - 1, F.lit(0.0)).alias("score")).orderBy(F.col("score").desc(), *keep)
