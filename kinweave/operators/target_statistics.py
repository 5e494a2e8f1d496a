"""Categories as numbers by ordered target statistics.

A training row's number is the mean target of the rows of its category that
come before it in a fixed random order, drawn towards the mean of all by a
weight: its own target is never in it. Rows to predict take the whole
category's mean, drawn likewise.

The order is by MD5 of seed and key. Sums before a row are found in two levels:
sums of buckets by the order's first digits, then running sums inside a
bucket, so a category with a third of all rows is sorted in as many tasks as it
has buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinweave.operators.graph_build import draw_order

#: Rows of a category that one task sorts, on average.
BUCKET = 100_000


def ordered_statistic(train: DataFrame, key: str, category: str, target: str, out: str, weight: float = 1.0, seed: int = 42, bucket: int = BUCKET) -> DataFrame:
    """train with out; null is a category of its own, rows without target count nowhere."""
    n, mean = train.agg(F.count("*").alias("n"), F.avg(F.col(target).cast("double")).alias("m")).first()
    digits = 0
    while 16**digits * bucket < n:
        digits += 1
    rows = train.withColumn("__order", draw_order(key, seed)).withColumn("__bucket", F.substring("__order", 1, digits) if digits else F.lit(""))
    y, has = F.coalesce(F.col(target).cast("double"), F.lit(0.0)), F.col(target).isNotNull().cast("long")
    per = rows.groupBy(F.col(category).alias("__c"), F.col("__bucket").alias("__b")).agg(F.sum(y).alias("__s"), F.sum(has).alias("__n"))
    before = W.partitionBy("__c").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)  # a row for each bucket
    per = per.select("__c", "__b", F.coalesce(F.sum("__s").over(before), F.lit(0.0)).alias("__s0"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"))
    inside = W.partitionBy(category, "__bucket").orderBy("__order", key).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__s1", F.coalesce(F.sum(y).over(inside), F.lit(0.0))).withColumn("__n1", F.coalesce(F.sum(has).over(inside), F.lit(0)))
    both = rows.join(per, F.col(category).eqNullSafe(F.col("__c")) & (F.col("__bucket") == F.col("__b")))
    value = (F.col("__s0") + F.col("__s1") + F.lit(weight * (mean or 0.0))) / (F.col("__n0") + F.col("__n1") + F.lit(weight))
    return both.select(*train.columns, value.alias(out))


def whole_statistic(train: DataFrame, rows: DataFrame, category: str, target: str, out: str, weight: float = 1.0) -> DataFrame:
    """rows with out, from all of train; a category that train lacks has the mean of all."""
    mean = train.agg(F.avg(F.col(target).cast("double")).alias("m")).first().m or 0.0
    per = train.where(F.col(target).isNotNull()).groupBy(F.col(category).alias("__c")).agg(((F.sum(F.col(target).cast("double")) + weight * mean) / (F.count("*") + weight)).alias("__v"))
    return rows.join(per, F.col(category).eqNullSafe(F.col("__c")), "left").select(*rows.columns, F.coalesce("__v", F.lit(mean)).alias(out))


def encoded(train: DataFrame, test: DataFrame, key: str, categories: list[str], target: str, weight: float = 1.0, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """train and test with <c>_stat for each category: the boosting input in place of indices."""
    a, b = train, test
    for i, c in enumerate(categories):
        a = ordered_statistic(a, key, c, target, f"{c}_stat", weight, seed + i)
        b = whole_statistic(train, b, c, target, f"{c}_stat", weight)
    return a, b
