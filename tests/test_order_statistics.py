import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators import order_statistics as O
from kinweave.operators import relational


@pytest.fixture(scope="module")
def values(spark):
    """A group of many values, one of one value in a third of all rows, small ones, one of nulls, a null key."""
    r = random.Random(1)
    rows = [("wide", r.gauss(0, 1) * 10 ** r.randint(-3, 6)) for _ in range(4000)] + [("same", 7.0)] * 3000 + [("mixed", float(r.choice([1, 1, 1, 2, 3, 50]))) for _ in range(900)]
    rows += [("few", 3.0), ("few", 1.0), ("one", -5.0), ("null", None), (None, 2.0), (None, 9.0), ("wide", None)]
    return rows, spark.createDataFrame(rows, "g string, x double").repartition(5).cache()


def test_percentiles(spark, values):
    rows, df = values
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.999, "e": 1.0}
    seen = []
    got = {r.g: r for r in O.percentiles(df, "x", probs, ["g"], most=60, seen=seen).collect()}
    want = {r.g: r.p for r in df.groupBy("g").agg(F.percentile("x", F.array(*[F.lit(p) for p in probs.values()])).alias("p")).where("p is not null").collect()}
    assert set(got) == set(want)
    for g, p in want.items():
        assert [got[g][n] for n in probs] == p, g  # to the last bit
    assert max(seen) <= 60  # the most that one task sorts
    whole = O.percentiles(df, "x", probs, most=60).first()
    assert [whole[n] for n in probs] == df.agg(F.percentile("x", F.array(*[F.lit(p) for p in probs.values()])).alias("p")).first().p
    assert O.percentiles(df.where("g = 'null'"), "x", probs).count() == 0


def test_nearest_ranks(values):
    rows, df = values
    got = {r.g: (r.lo, r.hi) for r in O.nearest_ranks(df, "x", {"lo": 0.25, "hi": 0.75}, ["g"], most=50).collect()}
    for g in {g for g, x in rows if x is not None}:
        own = sorted(x for k, x in rows if k == g and x is not None)
        at = lambda p, own=own: own[min(len(own), max(1, round(p * (len(own) + 1)))) - 1]
        assert got[g] == (at(0.25), at(0.75)), g


def test_numbered(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("g"))
    order = F.xxhash64("id", F.lit(1))
    got = O.numbered(df, ["g"], order, ["id"], "n", most=100).withColumn("h", order).collect()
    per = {}
    for r in got:
        per.setdefault(r.g, []).append((r.h, r.id, r.n, r["__group_n"]))
    for g, x in per.items():
        assert [y[2] for y in sorted(x)] == list(range(1, len(x) + 1)), g
        assert {y[3] for y in x} == {len(x)}


def test_split_and_bins_are_as_before(spark):
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0], float((i * 37) % 101)) for i in range(500)], "k long, s string, x double")
    split = relational.stratified_split(df, "s", "k").collect()
    for s in "ab":
        own = sorted((r for r in split if r.s == s), key=lambda r: r.k)
        assert sum(r.is_test for r in own) == len(own) // 5
    bins = {r.k: r.bin for r in relational.quantile_bins(df, "x").collect()}
    x = np.array([float((i * 37) % 101) for i in range(500)])
    inner = np.unique(np.quantile(x, np.arange(11) / 10))[1:-1]
    assert all(bins[i] == int((inner < x[i]).sum()) for i in range(500))
