"""Table operators: keep-latest, top-k, buckets, scaling, splits, anti-joins, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinweave.operators import order_statistics
from kinweave.validate import cut


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by an explicit order: an aggregation, so no key's rows are sorted."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return g.select(*keys, *[F.col("__r")[c].alias(c) for c in rest]).select(*df.columns)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return g.select(*keys, *[F.col("__r")[c].alias(c) for c in rest]).select(*df.columns)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """k rows of each key, with rank."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def numbered(df: DataFrame, column: str, out: str, rows: int = 100_000) -> DataFrame:
    """df with out = 0, 1, 2, ... over the rows, by buckets of a hash of `column` (distinct values) and inside them by value: no window holds all rows."""
    buckets = max(1, df.count() // rows)
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(column), F.lit(buckets)))
    sizes = df.groupBy("__bucket").agg(F.count("*").alias("__n"))
    start = sizes.select(F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"))  # a row for each bucket
    j = df.join(start, F.col("__bucket") == F.col("__b"))
    return j.withColumn(out, F.col("__start") + F.row_number().over(W.partitionBy("__bucket").orderBy(column)) - 1).drop("__bucket", "__b", "__start")


def describe(df: DataFrame, keys: list[str], column: str, percentiles: dict[str, float], prefix: str = "") -> DataFrame:
    """keys, n, mean_, std_ (sample) of a column and the named exact percentiles."""
    name = prefix or column
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(column).alias(f"mean_{name}"), F.stddev_samp(column).alias(f"std_{name}"), *[F.percentile(column, F.lit(p)).alias(n) for n, p in percentiles.items()])


def threshold_profile(df: DataFrame, keys: list[str], column: str, thresholds: dict[str, float]) -> DataFrame:
    """keys, mean_, median_, min_, max_ of a column, and the share of rows at or above each threshold."""
    c = F.col(column)
    return df.groupBy(*keys).agg(F.avg(c).alias(f"mean_{column}"), F.percentile(c, F.lit(0.5)).alias(f"median_{column}"), F.min(c).alias(f"min_{column}"), F.max(c).alias(f"max_{column}"), *[F.avg((c >= t).cast("double")).alias(name) for name, t in thresholds.items()])


def yearly_profile(first: DataFrame, column: str) -> DataFrame:
    """first: one row for each item, with its earliest year. year, n, mean_, median_, min_, max_, and the quartiles p25 and p75 by nearest rank.

    Ranks and median are found by counts over intervals, so no year is sorted or gathered.
    """
    some = cut(first.where(F.col(column).isNotNull()).select("year", column))  # read for each rank and each level of intervals
    plain = some.groupBy("year").agg(F.count("*").alias("n"), F.avg(column).alias(f"mean_{column}"), F.min(column).alias(f"min_{column}"), F.max(column).alias(f"max_{column}"))
    middle = order_statistics.percentiles(some, column, {f"median_{column}": 0.5}, ["year"])
    ranks = order_statistics.nearest_ranks(some, column, {"p25": 0.25, "p75": 0.75}, ["year"])
    for more in (middle, ranks):
        more = more.withColumnRenamed("year", "__y")
        plain = plain.join(more, F.col("year").eqNullSafe(F.col("__y"))).drop("__y")
    return plain.select("year", "n", f"mean_{column}", f"median_{column}", f"min_{column}", f"max_{column}", "p25", "p75")


def id_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """known (ids in both), missing (in b alone), either (in any), as one row."""
    sides = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(key, F.lit(0), F.lit(1))).where(F.col(key).isNotNull())
    per = sides.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return per.agg(F.count_if(F.expr("a = 1 and b = 1")).alias("known"), F.count_if(F.expr("a = 0")).alias("missing"), F.count("*").alias("either"))


def top_rows(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows of a mixed-direction order: a top-k report."""
    return df.orderBy(*order).limit(k)


def union_latest(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, columns of either (null where a side has none); of equal keys b's row."""
    both = a.withColumn("__side", F.lit(0)).unionByName(b.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "__side")]
    g = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("__side", *rest)).alias("__r"))
    return g.select(*keys, *[F.col("__r")[c].alias(c) for c in rest]).select(*[c for c in both.columns if c != "__side"])


def top_or_other(df: DataFrame, column: str, k: int = 10, other: str = "Other") -> DataFrame:
    """value, n: the k most frequent values and the rest as one."""
    n = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    top = n.orderBy(F.col("n").desc(), "value").limit(k).select(F.col("value").alias("t"))
    named = n.join(F.broadcast(top), F.col("value") == F.col("t"), "left").select(F.coalesce("t", F.lit(other)).alias("value"), "n")  # k rows
    return named.groupBy("value").agg(F.sum("n").alias("n"))


def below_quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """Rows up to the exact quantile (linear interpolation) of a column."""
    cutoff = order_statistics.percentiles(df, column, {"__q": q})
    return df.join(F.broadcast(cutoff), F.col(column) <= F.col("__q")).drop("__q")  # one row


def z_scores(df: DataFrame, columns: list[str], sample: bool = False, log: bool = False) -> DataFrame:
    """<c>_z for each column; a null counts as the mean, a deviation of 0 as 1."""
    x = {c: F.log1p(c) if log else F.col(c).cast("double") for c in columns}
    dev = F.stddev_samp if sample else F.stddev_pop
    s = df.agg(*[F.avg(v).alias(f"__m_{c}") for c, v in x.items()], *[dev(v).alias(f"__s_{c}") for c, v in x.items()])
    j = df.join(F.broadcast(s), F.lit(True))  # one row
    z = {f"{c}_z": F.coalesce((v - F.col(f"__m_{c}")) / F.coalesce(F.nullif(F.col(f"__s_{c}"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)) for c, v in x.items()}
    return j.withColumns(z).drop(*s.columns)


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """<c>_scaled in 0..1; a constant column is 0."""
    s = df.agg(*[F.min(c).alias(f"__lo_{c}") for c in columns], *[F.max(c).alias(f"__hi_{c}") for c in columns])
    j = df.join(F.broadcast(s), F.lit(True))  # one row
    return j.withColumns({f"{c}_scaled": F.coalesce(F.try_divide((F.col(c) - F.col(f"__lo_{c}")).cast("double"), (F.col(f"__hi_{c}") - F.col(f"__lo_{c}")).cast("double")), F.lit(0.0)) for c in columns}).drop(*s.columns)


def quantile_bins(df: DataFrame, column: str, q: int = 10) -> DataFrame:
    """bin 0..q-1 by exact quantile edges, right-closed as the usual library cut; equal edges are merged."""
    edges = {f"__e{i}": i / q for i in range(q + 1)}
    e = order_statistics.percentiles(df, column, edges).select(F.array_distinct(F.array(*edges)).alias("__e"))
    j = df.join(F.broadcast(e), F.lit(True), "left")  # one row
    inner = F.slice("__e", F.lit(2), F.greatest(F.size("__e") - 2, F.lit(0)))
    return j.withColumn("bin", F.size(F.filter(inner, lambda x: x < F.col(column)))).drop("__e")


def stratified_split(df: DataFrame, stratum: str, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """is_test: in each stratum the floor(share * n) rows of smallest hash."""
    rank = order_statistics.numbered(df, [stratum], F.xxhash64(F.col(key), F.lit(seed)), [key], "__rank")
    return rank.withColumn("is_test", F.col("__rank") <= F.floor(F.col("__group_n") * F.lit(share))).select(*df.columns, "is_test")


def not_done(todo: DataFrame, done: DataFrame, id_column: str, name_column: str | None = None) -> DataFrame:
    """Rows whose id, and normalised name if given, is not among the done ones."""
    out = todo.join(done.select(id_column).where(F.col(id_column).isNotNull()).distinct(), id_column, "left_anti")
    if name_column:
        names = done.select(F.lower(F.trim(name_column)).alias("__n")).where("__n is not null").distinct()
        out = out.join(names, F.lower(F.trim(F.col(name_column))) == F.col("__n"), "left_anti")
    return out


def missing_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, missing_rate, in one pass."""
    columns = columns or df.columns
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing_rate")) for c in columns])).alias("x")).select("x.*")


def drop_sparse(df: DataFrame, limit: float = 0.3) -> DataFrame:
    rates = {r["column_name"]: r["missing_rate"] for r in missing_rates(df).collect()}  # a row for each column
    return df.select(*[c for c in df.columns if (rates[c] or 0.0) <= limit])


def histogram(df: DataFrame, column: str, bins: int, log: bool = False) -> DataFrame:
    """bin 1..bins, n: equal widths over the column's range (of log10 for log), the top value in the last bin."""
    x = F.log10(F.col(column)) if log else F.col(column).cast("double")
    d = df.where(F.col(column).isNotNull() & ((F.col(column) > 0) if log else F.lit(True))).select(x.alias("x"))
    s = d.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    j = d.join(F.broadcast(s), F.lit(True))  # one row
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1, F.lit(bins))).otherwise(F.lit(1))
    return j.select(b.cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def nearest_rank(values: Column, p: float) -> Column:
    """Nearest-rank percentile of an array: rank max(1, round-half-even(p * (n + 1))), at most n."""
    s = F.array_sort(values)
    k = F.greatest(F.lit(1), F.bround(F.lit(p) * (F.size(s) + 1)).cast("int"))
    return F.get(s, F.least(k, F.size(s)) - 1)


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """rmse, mae, r2."""
    e = F.col(label) - F.col(prediction)
    y = F.col(label)
    sse, n = F.sum(e * e), F.count("*")
    return df.agg(F.sqrt(sse / n).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - sse / (F.var_pop(y) * n)).alias("r2"))


def ranking_summary(df: DataFrame, score: str, k: int = 10) -> DataFrame:
    """pool, mean, median, and the mean of the k best."""
    top = df.orderBy(F.col(score).desc_nulls_last()).limit(k).agg(F.avg(score).alias("top_mean"))
    middle = order_statistics.percentiles(df, score, {"median_score": 0.5})
    plain = df.agg(F.count("*").alias("pool"), F.avg(score).alias("mean_score"))
    return plain.join(F.broadcast(middle), F.lit(True), "left").join(F.broadcast(top), F.lit(True)).select("pool", "mean_score", "median_score", "top_mean")  # one row each


def template_rows(missing: DataFrame, edges: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """For each missing node with a known neighbour, that neighbour's features under the node's own id; of several, the smallest known neighbour."""
    m = missing.select(F.col("node").alias("__m"))
    e = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = both.join(m, F.col("a") == F.col("__m"), "left_semi").join(features.select(F.col(key).alias("b")).distinct(), "b", "left_semi")
    first = known.groupBy("a").agg(F.min("b").alias("b"))
    joined = first.join(features, F.col("b") == F.col(key))
    return joined.select(*[F.col("a").alias(key) if c == key else F.col(c) for c in features.columns], F.col("b").alias("template"))
