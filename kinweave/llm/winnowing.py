"""Document fingerprints by winnowing, with DataFrame operations only.

Every run of k characters (code points) of a text has a polynomial hash modulo a
prime, the rolling hash: the value at a place follows from the one before by the
character that leaves and the one that comes. No array function carries a state
along an array in linear time, so the values are made by doubling: that of 2m
characters is that of m, times the base to the m, plus that of the next m; each
step reads every place once, log2(k) steps in all. In every window of w
successive hashes the smallest is chosen, the rightmost of equal ones (by
doubling too), and a choice is kept once, with its position (the number of the
run's first character). Any passage of k + w - 1 characters that two texts share
gives both at least one equal hash, in any script and at any offset; whatever is
shorter than k gives none, unless it is a whole text: a text of fewer than k
characters has one hash of all of it, one of fewer than w hashes has one window.
A choice is one long: 30 bits of hash above the complement of its position, so
the plain minimum of a window is the smallest hash at its rightmost place.

Memory: a few arrays of a number for each character of the row at hand.

The likeness of two fingerprints is the Jaccard similarity of their sets of
hashes, 1 if both are empty.

The contract's neighbour of a document is the next one by descending doc_id. The
rows are parted by quantiles of doc_id, and between two quantiles evenly, so
that parts keep their size as rows grow; each part also gets a copy of the row
that follows it, so that a part's window needs no other part. A text is dealt
once, and hashed once before its neighbour takes over its fingerprint.

Defined results: a null text is empty; an empty text has an empty fingerprint;
a null doc_id sorts last; rows of equal doc_id are ordered by a hash of their
text; of the only row the next is itself; an empty table gives an empty result;
columns beside doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinweave.llm import common as C

POSITION = 31  # bits
PRIME = (1 << 30) - 35
BASE = 452_930_477


@dataclass(frozen=True)
class Winnow:
    """k and w are powers of two."""

    k: int = 16
    w: int = 32
    #: The order by doc_id: quantiles (at most), rows between two of them (at least), and rows in a part (about, at most).
    quantiles: int = 1024
    quantile_rows: int = 64
    part_rows: int = 4096
    #: Parts whose first rows are looked for by a table sent to every task (some 40 bytes a part); more are joined by a shuffle.
    sent_parts: int = 1 << 18


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _doubled(a: Column, size: int, join) -> Column:
    """join(x, y, m) of each element's run of m and the run behind it, for m = 1, 2, 4 up to size elements."""

    def step(a: Column, m: int) -> Column:
        if m == size:
            return a
        left, right = F.slice(a, 1, F.size(a) - m), F.slice(a, m + 1, F.size(a) - m)
        return _let(F.zip_with(left, right, lambda x, y: join(x, y, m)), lambda b: step(b, 2 * m))

    return step(a, 1)


def choices(text: Column, how: Winnow = Winnow()) -> Column:
    """array<long>: the chosen (hash, position) pairs of a text, in order of position."""
    if any(x < 1 or x & (x - 1) for x in (how.k, how.w)):
        raise ValueError("k and w must be powers of two")
    last = F.lit((1 << POSITION) - 1).cast("long")

    def grams(codes):
        return _doubled(codes, how.k, lambda x, y, m: (x * F.lit(pow(BASE, m, PRIME)) + y) % F.lit(PRIME))

    def chosen(h):
        placed = F.transform(h, lambda x, i: x * F.lit(1 << POSITION) + (last - i))
        return _let(placed, lambda g: F.when(F.size(g) < how.w, F.array(F.array_min(g))).otherwise(F.array_distinct(_doubled(g, how.w, lambda x, y, m: F.least(x, y)))))

    def short(codes):  # of fewer than k characters
        return F.aggregate(codes, F.lit(0).cast("long"), lambda s, x: (s * F.lit(BASE) + x + 1) % F.lit(PRIME))

    def whole(codes):
        return F.when(F.size(codes) >= how.k, _let(grams(codes), chosen)).otherwise(F.array(short(codes) * F.lit(1 << POSITION) + last))

    return F.when(text == "", F.array().cast("array<long>")).otherwise(_let(F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long")), whole))


def _position(choice: Column) -> Column:
    last = F.lit((1 << POSITION) - 1).cast("long")
    return last - choice.bitwiseAND(last)


def _within(found: Column, size: Column, how: Winnow) -> Column:
    """The choices that the whole windows of a text's first `size` characters make, out of all of its choices.

    The last such window chose the least of the choices that lie in it, and
    windows choose in order of position: all up to that one are theirs.
    """
    first = size - (how.k + how.w - 1)
    inside = F.filter(found, lambda x: (_position(x) >= first) & (_position(x) < first + how.w))
    last = _let(F.array_min(inside), _position)
    return F.when(first < 0, F.array().cast("array<long>")).otherwise(_let(last, lambda p: F.filter(found, lambda x: _position(x) <= p)))


def spliced(a: Column, a_found: Column, a_size: Column, b: Column, b_found: Column, b_size: Column, how: Winnow = Winnow()) -> Column:
    """choices() of the first a_size characters of a and the first b_size of b, end to end, from those of a and b.

    A window's choice depends on its own characters only, so only the windows
    across the joint are hashed anew. Where a's part has no whole window the
    text is, unless b_size exceeds a_size by far, short, and is hashed directly.
    """
    reach = how.k + how.w - 2
    whole = F.concat(F.substring(a, F.lit(1), a_size.cast("int")), F.substring(b, F.lit(1), b_size.cast("int")))
    start = a_size - reach
    joint = F.concat(F.substring(a, (start + 1).cast("int"), F.lit(reach)), F.substring(b, F.lit(1), F.least(b_size, F.lit(reach)).cast("int")))
    across = F.when(b_size < 1, F.array().cast("array<long>")).otherwise(F.transform(choices(joint, how), lambda x: x - start))
    parts = F.concat(_within(a_found, a_size, how), across, F.transform(_within(b_found, b_size, how), lambda x: x - a_size))
    return F.when(a_size <= reach, choices(whole, how)).otherwise(F.array_distinct(parts))


def hashes(fingerprint: Column) -> Column:
    """The distinct hashes of a fingerprint, without positions."""
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, POSITION)))


def positions(fingerprint: Column) -> Column:
    """array<struct<hash, position>>."""
    last = F.lit((1 << POSITION) - 1).cast("long")
    return F.transform(fingerprint, lambda x: F.struct(F.shiftright(x, POSITION).alias("hash"), (last - x.bitwiseAND(last)).alias("position")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def as_string(fingerprint: Column) -> Column:
    """hash:position pairs, hexadecimal."""
    last = F.lit((1 << POSITION) - 1).cast("long")
    return F.array_join(F.transform(fingerprint, lambda x: F.concat(F.hex(F.shiftright(x, POSITION)), F.lit(":"), F.hex(last - x.bitwiseAND(last)))), " ")


def fingerprints(docs: DataFrame, how: Winnow = Winnow()) -> DataFrame:
    """doc_id, fingerprint: array<struct<hash, position>>."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), positions(choices(text, how)).alias("fingerprint"))


def with_next(rows: DataFrame, order: str, carry: list[str], made: dict[str, Column], how: Winnow = Winnow()) -> DataFrame:
    """rows with the made columns, and next_<c> for each carried or made column c: those of the row after, by descending `order` (a long, no null) and then ascending __kw_tie; after the last comes the first."""
    ids = rows.select(order)
    stats = ids.agg(F.count("*").alias("n"), F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    n = stats["n"]
    carry = [*carry, *made]
    if not n:
        rows = rows.withColumns(made)
        for c in carry:
            rows = rows.withColumn(f"next_{c}", F.col(c))
        return rows
    parts = max(1, min(how.quantiles, n // how.quantile_rows))
    cuts = ids.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)] or [0.5], 100 * parts).alias("cuts")).first()["cuts"]  # parts - 1 numbers
    cuts = sorted(set(cuts)) if parts > 1 else []
    edges = F.array(*[F.lit(c).cast("long") for c in [stats["lo"], *cuts, stats["hi"]]])
    coarse = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]).cast("array<long>"), lambda e: e < F.col(order)))
    fine = max(1, -(-n // (parts * how.part_rows)))
    rows = rows.withColumn("__kw_c", coarse)
    low, high = F.get(edges, F.col("__kw_c")).cast("double"), F.get(edges, F.col("__kw_c") + 1).cast("double")
    share = F.coalesce(F.try_divide(F.col(order).cast("double") - low, high - low), F.lit(0.0))
    part = F.col("__kw_c").cast("long") * fine + F.greatest(F.lit(0), F.least(F.lit(fine - 1), F.floor(share * fine)))
    rows = rows.withColumn("__kw_part", part).drop("__kw_c")
    by = [F.col(order).desc(), F.col("__kw_tie").asc()]
    top = rows.groupBy("__kw_part").agg(F.max(F.struct(F.col(order), (-F.col("__kw_tie")).alias("t"))).alias("top"))  # a row for each part
    ring = W.orderBy(F.col("__kw_part").desc())
    top = top.withColumn("before", F.coalesce(F.lag("__kw_part").over(ring), F.min("__kw_part").over(W.partitionBy())))
    top = top.select("before", F.col("top")[order].alias("__kw_o"), (-F.col("top")["t"]).alias("__kw_t"))
    if parts * fine <= how.sent_parts:
        top = F.broadcast(top)
    heads = rows.join(top, (F.col(order) == F.col("__kw_o")) & (F.col("__kw_tie") == F.col("__kw_t"))).dropDuplicates(["__kw_part"])
    heads = heads.withColumn("__kw_part", F.col("before")).withColumn("__kw_extra", F.lit(1)).select(*rows.columns, "__kw_extra")
    all_rows = rows.withColumn("__kw_extra", F.lit(0)).unionByName(heads)
    window = W.partitionBy("__kw_part").orderBy(F.col("__kw_extra"), *by)
    # dealt and sorted as the window wants it, and only then hashed: the window adds no second shuffle
    all_rows = all_rows.repartition("__kw_part").sortWithinPartitions("__kw_part", "__kw_extra", *by).withColumns(made)
    for c in carry:
        all_rows = all_rows.withColumn(f"next_{c}", F.lead(c).over(window))
    return all_rows.where("__kw_extra = 0").drop("__kw_extra", "__kw_part")


def edited_fingerprints(docs: DataFrame, how: Winnow = Winnow()) -> DataFrame:
    """The contract's rows: each text's fingerprint, that of the edited text, and the likenesses."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("__kw_id", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))).withColumn("__kw_tie", F.shiftright(F.xxhash64("text"), 1))
    rows = with_next(rows, "__kw_id", ["text"], {"own": choices(F.col("text"), how)}, how)
    half = F.floor(F.length("text") / 2)
    rows = rows.withColumns({"first": F.length("text") - half, "second": F.least(half, F.length("next_text").cast("long"))})
    edited = F.concat(F.substring("text", F.lit(1), F.col("first").cast("int")), F.substring("next_text", F.lit(1), F.col("second").cast("int")))
    changed = spliced(F.col("text"), F.col("own"), F.col("first"), F.col("next_text"), F.col("next_own"), F.col("second"), how)
    out = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode(edited, "UTF-8"), 256).alias("edited_sha256"), F.col("own").alias("a"), changed.alias("b"), F.col("next_own").alias("c"))
    sets = out.withColumns({f"h{x}": hashes(F.col(x)) for x in "abc"})
    return sets.select("doc_id", "n_chars", "edited_sha256", as_string(F.col("a")).alias("fingerprint"), as_string(F.col("b")).alias("edited_fingerprint"), likeness(F.col("ha"), F.col("hb")).alias("near_edited"), likeness(F.col("ha"), F.col("hc")).alias("near_next"))
