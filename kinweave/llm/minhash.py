"""Near duplicates by ProbMinHash signatures, banding and exact verification.

A text is a weighted set of its runs of five words (weight: how often the run
occurs). Every element is a Poisson process whose rate is its weight: its
arrivals come at exponential gaps, each at a uniformly drawn signature
component, and a component keeps the element that arrives first. An element
stops as soon as its next arrival is later than the latest component's minimum,
so long texts need little more than one arrival per element. Two signatures
agree in a component with the probability Jaccard similarity of the weighted
sets. Bands of components are hashed; texts that share a band are candidates;
a candidate counts if the exact Jaccard similarity of the sets of runs is at
least `threshold`. That is a similarity of plain sets, far from the weighted one
where runs occur more often in one text than in the other, so a text also has
the bands of its set with unit weights, in the same buckets: those of a text
without a repeated run are its only ones. Texts whose sets are 0.8 similar share
a band of these with a chance of 0.999.

Copies are collapsed to one text first. In a band's bucket every text is
compared with the most central of them, the one with most company over all its
buckets. Texts of a bucket that are then still in different classes are paired,
but only those that can have a link at all. Runs are dealt into bins by hash;
what two texts share is at most the sum over bins of the smaller of their
numbers of runs that some other such text has too, and a link needs an overlap
of threshold / (1 + threshold) of the two sizes together. So no link between
classes that share a bucket is lost, while a bucket of one class, or of texts too
different to link, costs its size; what is left of a large bucket is dealt to
cells of two slices each. Classes are connected components. A text is known by
its whole digest; two that share the 64 bits used as a node get other numbers.

Defined results: a null text is empty; texts without a word are equal to each
other and like no other; texts under five words have one run of all their words;
equal rows share a class; class_id is the smallest doc_id of the class, null if
all are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import common as C
from kinweave.llm.components import components


@dataclass(frozen=True)
class NearDup:
    words: int = 5
    threshold: float = 0.8
    bands: int = 24
    rows: int = 6
    seed: int = 2
    #: Texts of a bucket that are compared with each other in one place; more are dealt to cells, a cell for each two slices.
    slice_texts: int = 512


#: Bins of the overlap bound, two to a slot.
SLOTS = 16
BINS = 2 * SLOTS


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((C.mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def weighted_sets(body: np.ndarray, off: np.ndarray, k: int):
    """(element, row, weight) of the runs of k words of each row, sorted by row and element."""
    start, end, row = C.words_of(body, off)
    h, srow, _ = C.shingles_of(C.segment_hash(body, start, end), row, len(off) - 1, k)
    if not len(h):
        return h, srow, np.zeros(0)
    order = np.lexsort((h, srow))
    h, srow = h[order], srow[order]
    first = np.concatenate(([True], (h[1:] != h[:-1]) | (srow[1:] != srow[:-1])))
    at = np.flatnonzero(first)
    return h[at], srow[at], np.diff(np.concatenate((at, [len(h)]))).astype(np.float64)


def signatures(element: np.ndarray, row: np.ndarray, weight: np.ndarray, n: int, m: int, seed: int) -> np.ndarray:
    """n x m: for each row and component the element that arrives first (0 where a row has none)."""
    best = np.full(n * m, np.inf)
    sig = np.zeros(n * m, np.uint64)
    active, at = np.arange(len(element)), np.zeros(len(element))
    salt = np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    turn = 0
    while len(active):
        turn += 1
        x = C.mix(element[active] ^ salt) + np.uint64(turn * 0x632BE59BD9B4E019 & (1 << 64) - 1)
        at = at - np.log(_uniform(x)) / weight[active]
        place = row[active] * m + (C.mix(x ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(best, place, at)
        won = best[place] == at
        sig[place[won]] = element[active[won]]
        limit = best.reshape(n, m).max(axis=1)
        go = at < limit[row[active]]
        active, at = active[go], at[go]
    return sig.reshape(n, m)


def banded(sig: np.ndarray, how: NearDup) -> np.ndarray:
    """A hash of each band of each row of signatures."""
    odd = C.powers(how.rows + 1, 0xC2B2AE3D27D4EB4F)
    sig = sig.reshape(len(sig), how.bands, how.rows)
    return C.mix((C.mix(sig) * odd[1 : how.rows + 1]).sum(axis=2, dtype=np.uint64) + np.arange(how.bands, dtype=np.uint64))


def sketch(docs: DataFrame, how: NearDup = NearDup()) -> DataFrame:
    """doc_id, digest (of the text; texts without a word have that of the empty one), key (64 bits of it), bands (array of longs; null for texts without a word).

    bands are those of the weighted set and, where a run is repeated, those of the set, null where they are the same.
    """
    C.small_batches(docs.sparkSession)

    def run(batches):
        import hashlib

        import pyarrow as pa

        m = how.bands * how.rows
        for b in batches:
            for i, body, off in C.sub_batches(b.column("text")):
                n = len(off) - 1
                element, row, weight = weighted_sets(body, off, how.words)
                band = banded(signatures(element, row, weight, n, m, how.seed), how)
                # unit weights give other bands only where a run is repeated
                again = np.bincount(row, weight > 1, n) > 0
                at, of = np.cumsum(again) - 1, again[row]
                unit = banded(signatures(element[of], at[row[of]], np.ones(int(of.sum())), int(again.sum()), m, how.seed), how)
                length = how.bands * (1 + again)
                start = np.concatenate(([0], np.cumsum(length)))
                place = np.arange(how.bands)
                flat, none = np.zeros(start[-1], np.uint64), np.zeros(start[-1], bool)
                flat[start[:-1, None] + place] = band
                flat[start[:-1][again][:, None] + how.bands + place] = unit
                none[start[:-1][again][:, None] + how.bands + place] = unit == band[again]
                has = np.bincount(row, minlength=n) > 0
                whole = body.tobytes()
                digests = [hashlib.sha256(whole[off[j] : off[j + 1]]).digest() if has[j] else hashlib.sha256(b"").digest() for j in range(n)]
                key = np.frombuffer(b"".join(d[:8] for d in digests), ">i8").astype(np.int64) if n else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(flat.view(np.int64), mask=none))
                lists = pa.array([x if ok else None for x, ok in zip(lists.to_pylist(), has, strict=True)], pa.list_(pa.int64())) if not has.all() else lists
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, n), pa.array(digests, pa.binary()), pa.array(key), lists], ["doc_id", "digest", "key", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, digest binary, key long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, how: NearDup) -> DataFrame:
    """pairs (a, b) of keys whose texts (key, text) are similar enough."""
    ta = texts.select(F.col("key").alias("ka"), F.col("text").alias("xa"))
    tb = texts.select(F.col("key").alias("kb"), F.col("text").alias("xb"))
    both = pairs.join(ta, F.col("a") == F.col("ka")).drop("ka").join(tb, F.col("b") == F.col("kb")).drop("kb")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i, _, off in C.sub_batches(b.column("xa"), 1 << 20):
                part = b.slice(i, len(off) - 1)
                body_b, off_b = C.utf8(part.column("xb"))
                body_a, off_a = C.utf8(part.column("xa"))
                n = part.num_rows
                ea, ra, _ = weighted_sets(body_a, off_a, how.words)
                eb, rb, _ = weighted_sets(body_b, off_b, how.words)
                e, r = np.concatenate((ea, eb)), np.concatenate((ra, rb))
                order = np.lexsort((e, r))
                e, r = e[order], r[order]
                shared = np.bincount(r[1:][(e[1:] == e[:-1]) & (r[1:] == r[:-1])], minlength=n)[:n]
                union = np.bincount(ra, minlength=n) + np.bincount(rb, minlength=n) - shared
                ok = shared >= how.threshold * union - 1e-9
                ok &= union > 0
                yield pa.RecordBatch.from_arrays([part.column("a").filter(pa.array(ok)), part.column("b").filter(pa.array(ok))], ["a", "b"])

    return both.select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")


def overlap_bounds(texts: DataFrame, how: NearDup, parts: int | None = None) -> DataFrame:
    """key, size (number of different runs), common (how many of them another of the texts has), c0.. (common by bin of hashes).

    Hashes of runs are packed and dealt by hash; each part counts for itself and
    answers with a few numbers for each text.
    """
    parts = SLOTS * (parts or max(1, texts.count() // 32_000))

    def send(batches):
        import pyarrow as pa

        for b in batches:
            for i, body, off in C.sub_batches(b.column("text"), 1 << 22):
                element, row, _ = weighted_sets(body, off, how.words)
                if not len(element):
                    continue
                keys = b.column("key").slice(i, len(off) - 1).to_numpy()[row]
                part = (element % np.uint64(parts)).astype(np.int64)
                o = np.argsort(part, kind="stable")
                element, keys, part = element[o], keys[o], part[o]
                cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                ends = np.concatenate((cut[1:], [len(part)]))
                yield pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), pa.array([element[a:e].tobytes() for a, e in zip(cut, ends, strict=True)], pa.binary()), pa.array([keys[a:e].tobytes() for a, e in zip(cut, ends, strict=True)], pa.binary())], ["part", "runs", "keys"])

    def count(batches):
        import pyarrow as pa

        for rows in C.groups(batches, "part"):
            element = np.concatenate([np.frombuffer(r["runs"], np.uint64) for r in rows])
            key = np.concatenate([np.frombuffer(r["keys"], np.int64) for r in rows])
            _, inverse, n = np.unique(element, return_inverse=True, return_counts=True)
            k, at = np.unique(key, return_inverse=True)
            odd = (element // np.uint64(parts)) % np.uint64(2) == 1
            again = n[inverse] > 1
            columns = [np.bincount(at), np.bincount(at, again & ~odd).astype(np.int64), np.bincount(at, again & odd).astype(np.int64)]
            slot = np.full(len(k), rows[0]["part"] % SLOTS, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(slot), *map(pa.array, columns)], ["key", "slot", "size", "even", "odd"])

    sent = texts.select("key", "text").mapInArrow(send, "part int, runs binary, keys binary")
    got = sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(count, "key long, slot int, size long, even long, odd long")
    bins = [F.sum(F.when(F.col("slot") == i // 2, F.col(("even", "odd")[i % 2])).otherwise(0)).alias(f"c{i}") for i in range(BINS)]
    return got.groupBy("key").agg(F.sum("size").alias("size"), F.sum(F.col("even") + F.col("odd")).alias("common"), *bins)


def classes(docs: DataFrame, how: NearDup = NearDup()) -> DataFrame:
    """One row per document: doc_id, class_id, class_key (of the class, as class_id may be null in several), digest (of its text, as in sketch())."""
    sketched = C.materialise(sketch(docs, how), "near-sketch")
    copies = C.materialise(sketched.groupBy("key", "digest").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands")), "near-copies")
    copies = C.rekeyed(copies, C.renumbered(copies.select("key", "digest")), "digest", "key")
    member = copies.where("bands is not null").select("key", F.posexplode("bands").alias("place", "bucket")).where("bucket is not null").select("key", (F.col("place") % how.bands).alias("band"), "bucket")
    sizes = member.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    several = C.materialise(member.join(sizes, ["band", "bucket"]), "near-several")
    company = several.groupBy("key").agg(F.sum("n").alias("company"))
    weighed = several.join(company, "key")
    heads = weighed.groupBy("band", "bucket").agg(F.max_by("key", F.struct("company", "key")).alias("head"))
    shared = C.materialise(several.join(heads, ["band", "bucket"]).select("band", "bucket", "key", "head"), "near-buckets")
    pairs = shared.where("key <> head").select(F.least("key", "head").alias("a"), F.greatest("key", "head").alias("b")).distinct()
    involved = shared.select(F.col("key").alias("k")).distinct()
    rows = docs.select(_some_id("doc_id").alias("o"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("t", C.digest_of(F.col("text")))
    owner = copies.join(involved, F.col("key") == F.col("k"), "left_semi").select(_some_id("first").alias("f"), "digest", "key")
    texts = rows.join(owner, (F.col("o") == F.col("f")) & (F.col("t") == F.col("digest"))).dropDuplicates(["o", "t"]).select("key", "text")
    texts = C.materialise(texts, "near-texts")
    links = C.materialise(verified(pairs, texts, how), "near-links")
    roots = components(links, "near-star")
    # texts of one bucket in different classes: all such pairs, once
    root = roots.select(F.col("node").alias("n"), "root")
    placed = shared.join(root, F.col("key") == F.col("n"), "left").select("band", "bucket", "key", "head", F.coalesce("root", "key").alias("root"))
    mixed = placed.groupBy("band", "bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band", "bucket")
    placed = C.materialise(placed.join(mixed, ["band", "bucket"]), "near-mixed")
    apart = placed.select(F.col("key").alias("k")).distinct()
    bound = C.materialise(overlap_bounds(texts.join(apart, F.col("key") == F.col("k"), "left_semi"), how), "near-bounds").where(F.col("common") >= how.threshold * F.col("size"))
    able = placed.join(bound.withColumnRenamed("key", "bk"), F.col("key") == F.col("bk")).select("band", "bucket", "key", "root", "head", "size", "common", *[f"c{i}" for i in range(BINS)])
    # a bucket's able texts also limit each other by the smallest size among them
    least = able.groupBy("band", "bucket").agg(F.min("size").alias("least"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band", "bucket", "least")
    share = how.threshold / (1 + how.threshold)
    able = able.join(least, ["band", "bucket"]).where(F.col("common") >= share * (F.col("size") + F.greatest("least", how.threshold * F.col("size"))) - 1e-9)
    able = C.materialise(able, "near-able")
    cells = ["band", "bucket", "lo", "hi"]
    dealt = _cells(able, how.slice_texts)
    x = dealt.select(*cells, F.col("slice").alias("sa"), F.col("key").alias("a"), F.col("root").alias("ra"), "head", F.col("size").alias("na"), F.col("common").alias("ca"), *[F.col(f"c{i}").alias(f"x{i}") for i in range(BINS)])
    y = dealt.select(*cells, F.col("slice").alias("sb"), F.col("key").alias("b"), F.col("root").alias("rb"), F.col("size").alias("nb"), F.col("common").alias("cb"), *[F.col(f"c{i}").alias(f"y{i}") for i in range(BINS)])
    need = share * (F.col("na") + F.col("nb")) - 1e-9
    most = F.least("x0", "y0")
    for i in range(1, BINS):
        most = most + F.least(f"x{i}", f"y{i}")
    enough = (F.least("ca", "cb") >= need) & (most >= need)
    across = x.join(y, cells).where(((F.col("lo") == F.col("hi")) | (F.col("sa") != F.col("sb"))) & (F.col("ra") != F.col("rb")) & (F.col("a") < F.col("b")) & (F.col("a") != F.col("head")) & (F.col("b") != F.col("head")) & enough).select("a", "b").distinct()
    more = C.materialise(verified(across, texts, how), "near-links-2")
    if not more.isEmpty():
        roots = components(links.union(more), "near-star")
    root = roots.select(F.col("node").alias("n"), "root")
    owned = copies.select("key", "digest", "first").join(root, F.col("key") == F.col("n"), "left").select("digest", "first", F.coalesce("root", "key").alias("root"))
    smallest = owned.groupBy("root").agg(F.min("first").alias("class_id"))
    named = C.materialise(owned.select("digest", "root").join(smallest, "root").select(F.col("digest").alias("d"), "class_id", F.col("root").alias("class_key")), "near-classes")
    return sketched.select("doc_id", "digest").join(named, F.col("digest") == F.col("d")).select("doc_id", "class_id", "class_key", "digest")


def _cells(able: DataFrame, slice_texts: int) -> DataFrame:
    """able with slice, lo and hi: a bucket of many texts is cut into slices, and a row goes to the cell of its slice and each other.

    Two texts of one slice meet in the cell (slice, slice), two of different
    slices in theirs, so no place holds more than two slices.
    """
    sizes = able.groupBy("band", "bucket").agg(F.ceil(F.count("*") / slice_texts).alias("slices"))
    dealt = able.join(sizes, ["band", "bucket"]).withColumn("slice", F.pmod(F.xxhash64("key"), F.col("slices")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    return dealt.withColumn("lo", F.least("slice", "other")).withColumn("hi", F.greatest("slice", "other")).drop("slices", "other")


def _some_id(column: str):
    """doc_id for equi-joins: null has a number of its own."""
    return F.coalesce(F.col(column).cast("long"), F.lit(-(1 << 63)).cast("long"))


def near_duplicates(docs: DataFrame, how: NearDup = NearDup()) -> DataFrame:
    return classes(docs, how).select("doc_id", "class_id")


def drop_near_duplicates(docs: DataFrame, how: NearDup = NearDup()) -> DataFrame:
    """The rows of docs, all columns, one of each class: its smallest doc_id (one row of it)."""
    keep = classes(docs, how).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_key").agg(F.min(F.struct(_some_id("class_id").alias("id"), "digest")).alias("one")).select(F.col("one.id").alias("__kw_id"), F.col("one.digest").alias("__kw_digest"))
    keep = C.materialise(keep, "near-kept")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = C.digest_of(F.when(text.rlike(r"[^\x20\x09-\x0D]"), text).otherwise(F.lit("")))
    rows = docs.withColumn("__kw_d", digest).withColumn("__kw_o", _some_id("doc_id"))
    kept = rows.join(keep, (F.col("__kw_o") == F.col("__kw_id")) & (F.col("__kw_d") == F.col("__kw_digest")))
    # by the columns of the join, so that no row is dealt again
    return kept.dropDuplicates(["__kw_o", "__kw_d"]).select(*docs.columns)
