"""Mixing sources to target weights, with DataFrame operations only.

1. A source's documents, in a pseudorandom but fixed order, are one stream of
   words, cut into blocks of block_words.
2. Targets: sources by code point (null last) weigh 5, 2, 1, repeating; they
   share `share` of all words, each at most `most` times its own, the excess
   reshared by weight (water filling, in closed form over one row per source).
3. Draws: output shards of shard_slots slots each draw multinomial source counts
   (a slot's source is the inverse CDF of a hash). A source's slots are
   numbered over all shards; numbers beyond its quota of blocks are void, and a
   last shard holds the numbers that its draws fell short of, so every quota is
   met exactly.
4. A source's number j is mapped to block P(j mod n_blocks) of pass
   j div n_blocks; P is a swap-or-not shuffle, an exact pseudorandom
   permutation of any range, keyed by seed, source and pass. Within a pass no
   block comes twice.
5. Blocks join the pieces of documents that they hold, by source and index.

Running sums are taken in two levels, so a source with a third of the rows is
spread over as many tasks as it has blocks of rows.

Defined results: a null or empty text has no words and is never taken; a null
source is a source of its own; rows with equal doc_id are separate rows (equal
in text too: interchangeable); an empty table gives an empty result; columns
beside doc_id, text and source are not read here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinweave.llm import common as C

WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space that follows it; the first also has what precedes it.
PIECE = r"(?:^[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


@dataclass(frozen=True)
class Mix:
    block_words: int = 64
    shard_slots: int = 4096
    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: float = 2.0
    seed: int = 20240101
    rounds: int = 24
    rows_per_bucket: int = 512
    cells: int = 1024
    slots_per_task: int = 1 << 15


def _unit(*columns) -> Column:
    """Uniform in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def sized(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col("text").cast("string")).alias("__kw_text"),
        *(carry or []),
    )


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """source, source_size, target: one row per source.

    target = min(most * size, level * weight); the level at which all targets
    add up to the total is found where the capped sources, in the order in which
    they reach their cap, leave the right rest.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    per = per.withColumn("weight", F.get(weights, (F.row_number().over(by_name) - 1) % len(mix.weights)))
    cap = F.col("source_size") * mix.most
    per = per.withColumn("cap", cap).withColumn("full_at", F.col("cap") / F.col("weight"))
    everything = W.partitionBy()
    order = W.orderBy("full_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    per = (
        per.withColumn("total", F.least(F.sum("source_size").over(everything) * F.lit(mix.share), F.sum("cap").over(everything)))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level_here", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
        # capped as long as the level, with all before it capped, is not below its own point
        .withColumn("capped", (F.col("level_here") >= F.col("full_at")).cast("int"))
        .withColumn("level", F.min(F.when(F.col("capped") == 0, F.col("level_here"))).over(W.partitionBy()))
    )
    first_open = F.min(F.when(F.col("capped") == 0, F.struct(F.col("full_at"), F.coalesce(F.col("source"), F.lit("\U0010ffff")).alias("s"), F.col("level_here").alias("l")))).over(everything)
    per = per.withColumn("level", first_open["l"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def streams(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """sizes with start: the words of the row's source before it."""
    n = sizes.count()
    buckets = max(1, n // mix.rows_per_bucket)
    order = W.partitionBy("source", "__kw_bucket").orderBy("__kw_order", "doc_id", "__kw_text", "size")
    rows = sizes.withColumn("__kw_order", F.xxhash64("doc_id", "__kw_text", F.lit(mix.seed))).withColumn("__kw_bucket", F.pmod(F.col("__kw_order"), F.lit(buckets)))
    rows = rows.withColumn("__kw_in", F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    per = C.running_total(rows.groupBy("source", "__kw_bucket").agg(F.sum("size").alias("__kw_n")), ["source"], "__kw_bucket", "__kw_n", "__kw_base")
    per = per.select(F.col("source").alias("__kw_s"), F.col("__kw_bucket").alias("__kw_b"), "__kw_base")
    joined = rows.join(per, rows["source"].eqNullSafe(per["__kw_s"]) & (rows["__kw_bucket"] == per["__kw_b"]))
    return joined.withColumn("start", F.col("__kw_base") + F.col("__kw_in")).drop("__kw_s", "__kw_b", "__kw_base", "__kw_in", "__kw_order", "__kw_bucket")


def permuted(index: Column, size: Column, key: list, rounds: int) -> Column:
    """Swap-or-not shuffle: index's place in a pseudorandom permutation of range(size)."""

    def step(x, r):
        other = F.pmod(F.pmod(F.xxhash64(*key, r), size) - x, size)
        top = F.greatest(x, other)
        return F.when(F.xxhash64(*key, r, top, F.lit(1)).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), step)


def quotas(per: DataFrame, mix: Mix) -> DataFrame:
    """One row per source with a word: n_blocks, and quota, the number of blocks to draw."""
    n = F.ceil(F.col("source_size") / mix.block_words).cast("long")
    return per.where("source_size > 0").withColumn("n_blocks", n).withColumn("quota", F.round(F.col("target") / F.col("source_size") * F.col("n_blocks")).cast("long"))


def draws(per: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """shard, slot, source, block, pass: every slot of the mix and the block that fills it."""
    spark = per.sparkSession
    q = quotas(per, mix).where("quota > 0")
    total = q.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    order = W.orderBy(F.col("source").asc_nulls_last())
    q = q.withColumn("hi", F.sum("quota").over(order) / F.lit(float(max(total, 1)))).withColumn("lo", F.lag("hi", 1, 0.0).over(order))
    last_cell = F.lit(mix.cells - 1)
    cells = q.select("source", "lo", "hi", F.explode(F.sequence(F.least(F.floor(F.col("lo") * mix.cells), last_cell), F.least(F.floor(F.col("hi") * mix.cells), last_cell))).alias("cell"))
    slots = spark.range(int(total)).select(F.floor(F.col("id") / mix.shard_slots).alias("shard"), (F.col("id") % mix.shard_slots).alias("slot"))
    slots = slots.withColumn("u", _unit("shard", "slot", F.lit(mix.seed))).withColumn("cell", F.floor(F.col("u") * mix.cells))
    drawn = slots.join(cells, "cell").where("u >= lo and u < hi").select("shard", "slot", "source")
    counts = drawn.groupBy("source", "shard").agg(F.count("*").alias("drawn"))
    base = C.running_total(counts, ["source"], "shard", "drawn", "base")
    base = base.select(F.col("source").alias("bs"), F.col("shard").alias("bh"), "base")
    ranked = drawn.withColumn("rank", F.row_number().over(W.partitionBy("source", "shard").orderBy("slot")) - 1)
    numbered = ranked.join(base, ranked["source"].eqNullSafe(base["bs"]) & (ranked["shard"] == base["bh"])).select("shard", "slot", "source", (F.col("base") + F.col("rank")).alias("j"))
    got = counts.groupBy("source").agg(F.sum("drawn").alias("got")).withColumnRenamed("source", "gs")
    plan = q.join(got, F.col("source").eqNullSafe(F.col("gs")), "left").select("source", "quota", "n_blocks", F.coalesce("got", F.lit(0)).alias("got"))
    short = plan.where("got < quota").select(F.lit(-1).cast("long").alias("shard"), F.posexplode(F.sequence(F.col("got"), F.col("quota") - 1)).alias("slot", "j"), "source")
    numbered = numbered.unionByName(short.select("shard", F.col("slot").cast("long").alias("slot"), "source", "j"))
    plan = plan.select(F.col("source").alias("ps"), "quota", "n_blocks")
    kept = numbered.join(plan, numbered["source"].eqNullSafe(plan["ps"])).where("j < quota")
    # few bytes, much to compute: dealt by number of slots, as tasks sized by bytes would be too few
    kept = kept.repartition(max(1, int(total) // mix.slots_per_task), "source", "j")
    number = F.floor(F.col("j") / F.col("n_blocks"))
    index = F.col("j") % F.col("n_blocks")
    return kept.select("shard", "slot", "source", number.alias("pass"), permuted(index, F.col("n_blocks"), [F.lit(mix.seed), F.col("source"), number], mix.rounds).alias("block"))


def pieces(rows: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """rows (with start and size), a row for each block that one meets: block, first_word, words."""
    b = mix.block_words
    out = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
    begin = F.greatest(F.col("block") * b, F.col("start"))
    end = F.least((F.col("block") + 1) * b, F.col("start") + F.col("size"))
    return out.withColumn("first_word", begin - F.col("start")).withColumn("words", end - begin)


def mix_plan(docs: DataFrame, mix: Mix = Mix(), carry: list | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with start, targets per source, draws); rows and targets are written tables."""
    rows = C.materialise(streams(sized(docs, carry), mix), "mix-rows")
    per = C.materialise(targets(rows, mix), "mix-targets")
    return rows, per, draws(per, mix)


def mixture(docs: DataFrame, mix: Mix = Mix(), carry: list | None = None) -> DataFrame:
    """The mix itself: shard, slot, pass, source, block, doc_id, start, first_word, words, in slots."""
    rows, _, drawn = mix_plan(docs, mix, carry)
    p = pieces(rows, mix).withColumnRenamed("source", "__kw_s").withColumnRenamed("block", "__kw_b")
    return drawn.join(p, drawn["source"].eqNullSafe(p["__kw_s"]) & (drawn["block"] == p["__kw_b"])).drop("__kw_s", "__kw_b", "__kw_text")


def taken(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken."""
    rows, per, drawn = mix_plan(docs, mix)
    times = drawn.groupBy("source", "block").agg(F.count("*").alias("times")).withColumnRenamed("source", "ts").withColumnRenamed("block", "tb")
    p = pieces(rows, mix)
    met = p.join(times, p["source"].eqNullSafe(times["ts"]) & (p["block"] == times["tb"]), "left")
    some = met.groupBy("source", "start", "doc_id", "size").agg(F.sum(F.coalesce(F.col("times"), F.lit(0)) * F.col("words")).alias("taken"))
    none = rows.where("size = 0").select("source", "start", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    per = per.withColumnRenamed("source", "ps")
    out = some.unionByName(none)
    return out.join(per, out["source"].eqNullSafe(per["ps"])).select("doc_id", "size", "source", "source_size", "target", "taken")


def mixed_texts(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """docs' columns: for each pass, each document that it took, with the words taken as its text.

    Words are planned on ids and sizes; a row is found again by two hashes of
    all its columns (rows equal in all are interchangeable), so texts are dealt
    once.
    """
    names = docs.columns
    whole = [F.xxhash64(F.lit(i), *[F.col(c) for c in names]).alias(f"__kw_r{i}") for i in (1, 2)]
    plan = mixture(docs, mix, whole).groupBy("__kw_r1", "__kw_r2", "source", "start", "pass").agg(F.sort_array(F.collect_list(F.struct("first_word", "words"))).alias("__kw_taken"))
    plan = plan.select(F.col("__kw_r1").alias("__kw_p1"), F.col("__kw_r2").alias("__kw_p2"), "__kw_taken")
    rows = docs.select(*[F.col(c) for c in names], *whole).dropDuplicates(["__kw_r1", "__kw_r2"])
    both = rows.join(plan, (F.col("__kw_r1") == F.col("__kw_p1")) & (F.col("__kw_r2") == F.col("__kw_p2")))
    words = F.regexp_extract_all(F.col("text").cast("string"), F.lit(PIECE), F.lit(0))
    taken_text = F.element_at(F.transform(F.array(words), lambda a: F.array_join(F.transform(F.col("__kw_taken"), lambda t: F.array_join(F.slice(a, (t["first_word"] + 1).cast("int"), t["words"].cast("int")), "")), "")), 1)
    out = both.withColumn("__kw_new", taken_text)
    kinds = dict(docs.dtypes)
    return out.select(*[F.col("__kw_new").alias(c) if c == "text" else F.length("__kw_new").cast(kinds[c]).alias(c) if c == "n_chars" else F.col(c) for c in names])
