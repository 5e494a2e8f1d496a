"""Exact order statistics without sorting a column or a group in one task.

A rank is found by counting: approximate percentiles (a mergeable sketch of fixed
size) cut a group's values into intervals, every row is counted in its
interval, and running counts tell which interval holds the rank. Values that
equal a cut have an interval of their own, so a value that a third of all rows
share is never sorted. Rows of an interval that holds a rank are kept and cut
again until `most` of them are left; only those are sorted. With 64 cuts two
passes serve groups of some 10^8 rows, three of 10^10. A column that has no more
than `most` values in all (counted) is sorted at once.

Ranks of rows in an order of hashes are numbered the same way in two levels:
counts by the hash's first bits, and a row number inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinweave.validate import cut

#: Rows that one task sorts.
MOST = 100_000
CUTS = 64
#: Groups whose cuts (64 values each) are broadcast; those of more groups are joined by a shuffle.
TOLD = 10_000


def _alike(a: list[str], b: list[str]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & F.col(x).eqNullSafe(F.col(y))
    return out


def _told(table: DataFrame) -> DataFrame:
    """A written table, broadcast where it has few rows."""
    return F.broadcast(table) if table.count() <= TOLD else table


def values_at(df: DataFrame, column: str, ranks: DataFrame, keys: list[str] | None = None, most: int = MOST, seen: list[int] | None = None) -> DataFrame:
    """ranks (keys and __rank, from 0; several a group) with __value: the value of that rank among a group's values, nulls left out.

    A rank beyond the group's values has no row. seen, if given, gets the size of the largest interval sorted.
    """
    keys = keys or []
    names = [f"__k{i}" for i in range(len(keys))]
    part, level = "__part", 0
    rows = df.where(F.col(column).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(column).alias("__x"), F.lit("").alias(part))
    want = cut(ranks.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("__rank").cast("long").alias("__asked"), F.col("__rank").cast("long").alias("__rank"), F.lit("").alias(part)).distinct())
    group, other, found = [*names, part], [f"__o{i}" for i in range(len(names) + 1)], []
    renamed = lambda t: t.select(*[F.col(g).alias(o) for g, o in zip(group, other, strict=True)], *[c for c in t.columns if c not in group])
    while True:
        level += 1
        cuts = rows.groupBy(*group).agg(F.array_distinct(F.percentile_approx("__x", [i / CUTS for i in range(1, CUTS)], 20 * CUTS)).alias("__cuts"))
        at = F.size(F.filter("__cuts", lambda c: c < F.col("__x"))) * 2 + F.array_contains("__cuts", F.col("__x")).cast("int")
        dealt = rows.join(_told(cut(renamed(cuts))), _alike(group, other)).select(*group, "__x", at.alias("__at"), F.get("__cuts", F.size(F.filter("__cuts", lambda c: c < F.col("__x")))).alias("__cut"))
        dealt = cut(dealt)
        counts = dealt.groupBy(*group, "__at").agg(F.count("*").alias("__n"), F.first("__cut").alias("__cut"))
        counts = counts.withColumn("__end", F.sum("__n").over(W.partitionBy(*group).orderBy("__at")))  # 2 * CUTS + 1 rows a group at most
        held = want.join(renamed(counts), _alike(group, other) & (F.col("__rank") >= F.col("__end") - F.col("__n")) & (F.col("__rank") < F.col("__end")))
        held = cut(held.select(*group, "__asked", (F.col("__rank") - F.col("__end") + F.col("__n")).alias("__rank"), "__at", "__n", "__cut"))
        found.append(held.where("__at % 2 = 1").select(*names, "__asked", F.col("__cut").alias("__value")))
        open_ = held.where("__at % 2 = 0")
        size = open_.agg(F.max("__n").alias("n"), F.max(F.when(F.col("__n") <= most, F.col("__n"))).alias("small")).first()
        if size.n is None:
            break
        needed = open_.select(*group, "__at", "__n").distinct()
        needed = _told(cut(renamed(needed).withColumnRenamed("__at", "__oat")))
        kept = dealt.join(needed, _alike(group, other) & (F.col("__at") == F.col("__oat"))).select(*group, "__x", "__at", "__n")
        if size.small is not None:
            if seen is not None:
                seen.append(size.small)
            numbered = kept.where(F.col("__n") <= most).withColumn("__i", F.row_number().over(W.partitionBy(*group, "__at").orderBy("__x")) - 1)
            asked = renamed(open_.select(*group, "__asked", "__rank", "__at").withColumnRenamed("__at", "__oat"))
            found.append(numbered.join(asked, _alike(group, other) & (F.col("__at") == F.col("__oat")) & (F.col("__i") == F.col("__rank"))).select(*names, "__asked", F.col("__x").alias("__value")))
        if size.n <= most:
            break
        deeper = F.concat(F.col(part), F.lit("/"), F.col("__at").cast("string"))
        rows = kept.where(F.col("__n") > most).select(*names, "__x", deeper.alias(part))
        want = cut(open_.where(F.col("__n") > most).select(*names, "__asked", "__rank", deeper.alias(part)))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], F.col("__asked").alias("__rank"), "__value")


def _of_ranks(df: DataFrame, column: str, places: dict[str, Column], keys: list[str], most: int, seen: list[int] | None) -> DataFrame:
    """keys, __n and one column per place (a rank by __n): its value. Groups without values have none."""
    some = df.where(F.col(column).isNotNull())
    if some.count() <= most:  # no more than a task sorts anyway
        whole = some.groupBy(*keys).agg(F.sort_array(F.collect_list(column)).alias("__all")).withColumn("__n", F.size("__all").cast("long")).where("__n > 0")
        return whole.select(*keys, "__n", *[F.get("__all", rank.cast("int")).alias(name) for name, rank in places.items()])
    sizes = cut(some.groupBy(*keys).agg(F.count("*").alias("__n")))
    ranks = sizes.select(*keys, F.explode(F.array(*places.values())).alias("__rank"))
    got = values_at(df, column, ranks, keys, most, seen)
    other = [f"__r{i}" for i in range(len(keys))]
    both = sizes.join(got.select(*[F.col(k).alias(o) for k, o in zip(keys, other, strict=True)], "__rank", "__value"), _alike(keys, other))
    picked = [F.max(F.when(F.col("__rank") == rank, F.col("__value"))).alias(name) for name, rank in places.items()]
    return both.groupBy(*keys, "__n").agg(*picked)


def percentiles(df: DataFrame, column: str, probs: dict[str, float], keys: list[str] | None = None, most: int = MOST, seen: list[int] | None = None) -> DataFrame:
    """keys and one column per percentile, linear between neighbouring ranks, as Spark's percentile() gives it."""
    keys, places = keys or [], {}
    at = {name: F.lit(float(p)) * (F.col("__n") - 1) for name, p in probs.items()}
    for name, x in at.items():
        places[f"__lo_{name}"], places[f"__hi_{name}"] = F.floor(x).cast("long"), F.ceil(x).cast("long")
    t = _of_ranks(df, column, places, keys, most, seen)

    def value(name: str) -> Column:
        lo, hi, x = F.col(f"__lo_{name}").cast("double"), F.col(f"__hi_{name}").cast("double"), at[name]
        return F.when((lo == hi) | (F.floor(x) == F.ceil(x)), lo).otherwise((F.ceil(x) - x) * lo + (x - F.floor(x)) * hi)

    return t.select(*keys, *[value(name).alias(name) for name in probs])


def nearest_ranks(df: DataFrame, column: str, probs: dict[str, float], keys: list[str] | None = None, most: int = MOST, seen: list[int] | None = None) -> DataFrame:
    """keys and one column per percentile by nearest rank: rank max(1, round-half-even(p * (n + 1))), at most n."""
    keys = keys or []
    places = {name: F.least(F.col("__n"), F.greatest(F.lit(1).cast("long"), F.bround(F.lit(float(p)) * (F.col("__n") + 1)).cast("long"))) - 1 for name, p in probs.items()}
    return _of_ranks(df, column, places, keys, most, seen).select(*keys, *probs)


def numbered(df: DataFrame, keys: list[str], order: Column, ties: list[str], out: str, most: int = MOST) -> DataFrame:
    """df with out: each row's number from 1 in its group in the order of a hash (a long), then of ties, and __group_n, the group's rows.

    Counts by the hash's first bits come first, so that a group's rows are sorted in as many tasks as it has `most` rows.
    """
    bits = max(0, (max(1, df.count()) // most).bit_length())
    rows = df.withColumn("__hash", order).withColumn("__bucket", F.shiftright("__hash", 64 - bits) if bits else F.lit(0).cast("long"))
    per = rows.groupBy(*keys, "__bucket").agg(F.count("*").alias("__c"))
    whole = W.partitionBy(*keys)
    per = per.withColumn("__base", F.sum("__c").over(whole.orderBy("__bucket")) - F.col("__c")).withColumn("__group_n", F.sum("__c").over(whole))  # a row a bucket
    other = [f"__g{i}" for i in range(len(keys))]
    per = per.select(*[F.col(k).alias(o) for k, o in zip(keys, other, strict=True)], F.col("__bucket").alias("__b"), "__base", "__group_n")
    inside = F.row_number().over(W.partitionBy(*keys, "__bucket").orderBy("__hash", *ties))
    both = rows.withColumn("__in", inside).join(per, _alike(keys, other) & (F.col("__bucket") == F.col("__b")))
    return both.select(*df.columns, (F.col("__base") + F.col("__in")).alias(out), "__group_n")
