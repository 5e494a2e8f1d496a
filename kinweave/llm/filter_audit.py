"""Interaction audit of document filters by a Walsh-Hadamard transform, over every order in which they can be applied.

1. Every document gets a mask: bit i is set where filter i fails it. A repeat of
   an earlier text is found by counting: documents are grouped by digest, part,
   labels and id, so no group of copies is brought together, and only counts meet.
2. For each part and label (all documents, those of good quality, toxic ones)
   2^k signed sums are aggregated, W[s] = sum over documents of
   (-1)^|s AND mask|. They are sums, so tasks add up their own rows first.
3. The transform is its own inverse up to 2^k: cells[m] = sum over s of
   W[s] (-1)^|s AND m| / 2^k, exactly, in whole numbers.
4. Cells give, for each order and step, what is kept, removed, redundant and
   lost. Over all k! orders a document that n filters fail is removed by each of
   them k!/n times: the Shapley figure is a sum of 120/n over cells.

Nothing but counts leaves step 2: k filters cost 3 * 2^k numbers a part whatever
the number of documents.

Defined results: a null text is an empty text; a null or empty part is the part
''; every row of documents counts, rows with equal doc_id too. A row repeats
where a row with a smaller doc_id has its text: rows of equal doc_id don't
repeat one another, and a row without doc_id neither repeats nor is repeated.
A document with several label rows is good if any of them says so, toxic
likewise; labels without doc_id or without a document count nowhere. Words are
told apart by their code points. No documents: no parts, no rows. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm import common as C

WHITE = r"[\x20\x09-\x0D]+"
LABELS = ("all", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """A to D of the production filters: short, repetitive, capitals, symbols."""
    words = F.split(text, WHITE)
    edge = F.array_contains(words, "").cast("int")  # empty strings: before the first and after the last white space
    n = F.size(words) - F.size(F.filter(words, lambda w: w == ""))
    distinct = F.size(F.array_distinct(words)) - edge
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 100,
        "B": F.lit(100) * distinct < F.lit(80) * n,
        "C": F.lit(100) * capitals > F.lit(10) * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame, failures=text_failures, part: str = "lang") -> DataFrame:
    """part, good, toxic, mask, n: counts of documents; the filter after those of `failures` fails repeated texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bits = list(failures(text).values())
    mask = sum((F.when(b, F.lit(1 << i)).otherwise(F.lit(0)) for i, b in enumerate(bits)), F.lit(0))
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("mask"), C.digest_of(text).alias("digest"))
    # a spread of their own for rows without id, which meet no label but must not meet in one task either
    rows = rows.withColumn("spread", F.when(F.col("id").isNull(), F.xxhash64("digest", F.spark_partition_id())).otherwise(F.lit(0)))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    known = known.withColumn("l_spread", F.lit(0).cast("long"))
    rows = rows.join(known, (F.col("id") == F.col("l_id")) & (F.col("spread") == F.col("l_spread")), "left")
    same = ["digest", "mask", "part", "good", "toxic"]
    rows = rows.select("digest", "mask", "part", "id", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")])
    by_id = rows.groupBy(*same, "id").agg(F.count("*").alias("n"))
    # rows of the smallest id, of all ids, and without id, in each set of like copies
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    like = by_id.groupBy(*same).agg(first.alias("first"), F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"))
    texts = like.groupBy("digest").agg(F.collect_list(F.struct(*same[1:], "first", "n", "no_id")).alias("like"), F.min("first.id").alias("least"))  # as many as parts and labels
    each = texts.select("least", F.inline("like"))
    fresh = F.col("no_id") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    last = 1 << len(bits)
    both = F.array(F.struct(F.col("mask").alias("mask"), fresh.alias("n")), F.struct((F.col("mask") + last).alias("mask"), (F.col("n") - fresh).alias("n")))
    return each.select("part", "good", "toxic", F.inline(both)).where("n > 0")


def parity_sums(counts: DataFrame, k: int) -> DataFrame:
    """part, all, good, toxic: arrays of the 2^k signed sums."""
    weight = {"all": "n", "good": "if(good, n, 0L)", "toxic": "if(toxic, n, 0L)"}
    sums = [F.expr(f"sum({weight[x]} * (1 - 2 * (bit_count(mask & {s}) & 1)))").alias(f"{x}_{s}") for x in LABELS for s in range(1 << k)]
    per = counts.groupBy("part").agg(*sums)
    return per.select("part", *[F.array(*[f"{x}_{s}" for s in range(1 << k)]).alias(x) for x in LABELS])


def cells(sums: DataFrame, k: int) -> DataFrame:
    """part, all, good, toxic: arrays of the number of documents of each mask, the transform inverted."""

    def inverse(w: Column) -> Column:
        def cell(m: Column) -> Column:
            signed = F.zip_with(w, F.sequence(F.lit(0), F.lit((1 << k) - 1)), lambda x, s: x * (F.lit(1) - F.lit(2) * F.bit_count(m.bitwiseAND(s)).bitwiseAND(F.lit(1))))
            return F.shiftright(F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x), k)

        return F.transform(F.sequence(F.lit(0), F.lit((1 << k) - 1)), cell)

    return sums.select("part", *[inverse(F.col(x)).alias(x) for x in LABELS])


def _total(array: str, keep) -> Column:
    """Sum of the cells whose mask satisfies keep."""
    with_mask = F.transform(F.col(array), lambda n, m: F.when(keep(m), n).otherwise(F.lit(0)))
    return F.aggregate(with_mask, F.lit(0).cast("long"), lambda a, x: a + x)


def audit(counts: DataFrame, filters: str) -> DataFrame:
    """One row per part, order of the filters (one letter each, bit i for letter i) and step."""
    k = len(filters)
    orders = math.factorial(k)
    table = cells(parity_sums(counts, k), k)
    steps = ", ".join(
        f"struct('{''.join(order)}' AS filter_order, {i + 1} AS step, {(1 << filters.index(order[i]) << k) + sum(1 << filters.index(x) for x in order[:i])} AS pair)" for order in itertools.permutations(filters) for i in range(k)
    )
    # what depends on a filter and the set before it, and not on their order, is found once: k * 2^(k-1) of these
    pairs = ", ".join(f"struct({1 << f} AS bit, {b} AS before)" for f in range(k) for b in range(1 << k) if not b >> f & 1)
    bit, before = F.col("bit"), F.col("before")
    here = lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) == 0)
    turns = F.array(*[F.lit(orders // m.bit_count() if m else 0).cast("long") for m in range(1 << k)])  # orders in which one failing filter of mask m comes first
    fails = F.transform(F.zip_with("all", turns, lambda n, t: n * t), lambda x, m: F.when(m.bitwiseAND(bit) != 0, x).otherwise(F.lit(0)))
    found = table.select("*", F.expr(f"inline(array({pairs}))")).select(
        "part", "bit", "before",
        _total("all", lambda m: m.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"),
        _total("all", here).alias("removed"),
        _total("all", lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        _total("all", lambda m: m == bit).alias("unique_fails"),
        _total("good", here).alias("good_lost"),
        _total("toxic", here).alias("toxic_lost"),
        F.aggregate(fails, F.lit(0).cast("long"), lambda a, x: a + x).alias("shapley"),
    )
    pair = F.shiftleft("bit", k).bitwiseOR(F.col("before"))
    of_pair = found.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(pair, F.struct("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")))).alias("at"))
    rows = of_pair.select("part", "at", F.expr(f"inline(array({steps}))"))
    return rows.select("part", "filter_order", "step", F.col("at")[F.col("pair")].alias("x")).select("part", "filter_order", "step", "x.*")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five production filters: A to D by text, E by repetition."""
    return audit(masks(docs, labels), "ABCDE")
