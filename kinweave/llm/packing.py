"""Packing token sequences by minimum bin slack.

A document's tokens are cut into whole windows of `capacity` and one remaining
piece. What is left is a multiset of lengths below the capacity: its histogram
has at most `capacity` rows, whatever the corpus, so the driver may hold it. It
plans windows from the longest remaining length down: a subset-sum dynamic
program over a bitset (an integer's bits, counts split in powers of two) finds
the multiset of remaining lengths that fills the window closest, and its counts
are backtracked. A pattern is repeated as often as its counts last, so each
pattern uses up a length and there are at most `capacity` of them. What a closest
fill leaves empty is padding. Where the lengths don't go together at all (say,
all are just over half a window) padding would grow without bound: once it is
`padding_share` of all windows, lengths that can't be completed join a tail
whose pieces are laid end to end and cut at window borders.

Executors then number the pieces of each length (running counts over chunks of
pieces) and look their window up in the plan. Nothing but counts is shuffled,
apart from the few cut pieces.

Defined results: a null text is empty and has the closing token alone; rows
with equal doc_id are packed as separate documents; an empty table gives an
empty result; columns beside doc_id and text are ignored. Texts of any length
are tokenised whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinweave.llm import common as C


@dataclass(frozen=True)
class Packing:
    capacity: int = 1024
    closing_id: int = 0
    padding_share: float = 0.02
    #: A file of the public tokenizers by name, or an absolute path.
    tokenizer: str = "byte_bpe_50k.tiktoken"


#: Fixed value: the vocabulary's one special token and its id.
SPELLED_OUT = {"<|endoftext|>": 50256}


#: White-space characters in a row from which a text goes to the slower tokenizer; the faster one fails at some 990,000.
LONG_RUN = 100_000


def encoder(name: str):
    """text -> uint32 ids, as tokenizers gives them without special tokens added; those that the text spells out are themselves.

    A .json file is read by tokenizers, a .tiktoken file (the same vocabulary as ranks) by tiktoken, which is several times as fast.
    Its pattern gives up on a run of about a million white-space characters, so a text with a run of LONG_RUN is read
    by tokenizers from the .json file beside the other.
    """
    import os
    import re

    path = name
    if not os.path.isabs(name):
        import public_tokenizers

        path = public_tokenizers.path(name)
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda text: np.asarray(t.encode(text, add_special_tokens=False).ids, np.uint32)
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPELLED_OUT)
    run, whole = re.compile(rf"\s{{{LONG_RUN}}}"), []

    def ids(text: str) -> np.ndarray:
        if len(text) < LONG_RUN or not run.search(text):
            return np.asarray(e.encode(text, allowed_special="all"), np.uint32)
        if not whole:
            whole.append(encoder(name.removesuffix(".tiktoken") + ".json"))
        return whole[0](text)

    return ids


PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, chunk long, piece long, rank long, ids binary"


def tokenise(docs: DataFrame, how: Packing = Packing(), all_ids: bool = False) -> DataFrame:
    """Pieces of every document: whole windows, then the rest with its ids (uint32, little-endian)."""
    C.small_batches(docs.sparkSession)
    cap, closing, name = how.capacity, how.closing_id, how.tokenizer

    def run(batches):
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        chunk, n, ranks, encode = TaskContext.get().partitionId(), 0, np.zeros(cap + 1, np.int64), encoder(name)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "chunk", "piece", "rank", "ids"]
        for batch in batches:
            for i, _, off in C.sub_batches(batch.column("text"), 1 << 21):
                out = [[] for _ in names]
                ids_of = batch.column("doc_id").slice(i, len(off) - 1).to_pylist()
                for doc, text in zip(ids_of, batch.column("text").slice(i, len(off) - 1).to_pylist(), strict=True):
                    ids = np.append(encode(text or ""), np.uint32(closing)).astype("<u4")
                    for s in range(0, len(ids), cap):
                        part = ids[s : s + cap].tobytes()
                        size = len(part) // 4
                        for column, v in zip(out, (doc, s, size, zlib.crc32(part), len(ids), chunk, n, int(ranks[size]), part if all_ids or size < cap else None), strict=True):
                            column.append(v)
                        ranks[size] += 1
                        n += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


# ---- the plan ------------------------------------------------------------------


def fill(counts: dict[int, int], room: int) -> tuple[int, dict[int, int]]:
    """The largest sum of at most room that the multiset counts (length: how many) can make, and one multiset that makes it."""
    mask, bits, taken = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left > 0:
            n = min(step, left)
            taken.append((length, n, bits))
            bits |= (bits << (length * n)) & mask
            left, step = left - n, step * 2
        if bits >> room & 1:
            break
    best = at = bits.bit_length() - 1
    used: dict[int, int] = {}
    for length, n, before in reversed(taken):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + n
            at -= length * n
    return best, used


@dataclass(frozen=True)
class Plan:
    """Rows sorted by (length, first rank): ranks [first, last) of a length; per bin, its sequence and its offset; or tail."""

    length: np.ndarray
    first: np.ndarray
    per: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    tail: np.ndarray
    tail_sequence: int
    sequences: int
    capacity: int

    def place(self, length: np.ndarray, rank: np.ndarray):
        """(sequence, offset, length of the part that fits) of pieces; where the part is shorter the rest begins the next sequence."""
        width = np.int64(1) << 40
        row = np.searchsorted(self.length * width + self.first, length * width + rank, "right") - 1
        nth = rank - self.first[row]
        at = self.offset[row] + nth * length
        tail = self.tail[row]
        sequence = np.where(tail, self.tail_sequence + at // self.capacity, self.sequence[row] + nth // self.per[row])
        offset = np.where(tail, at % self.capacity, self.offset[row] + nth % self.per[row] * length)
        return sequence, offset, np.minimum(length, self.capacity - offset)


def plan(histogram: dict[int, int], capacity: int, padding_share: float = 0.02) -> Plan:
    left = {k: v for k, v in histogram.items() if v > 0}
    budget = padding_share * capacity * -(-sum(k * v for k, v in left.items()) // capacity)
    used = dict.fromkeys(left, 0)
    rows, sequence, tail = [], 0, []
    while left:
        top = max(left)
        left[top] -= 1
        best, counts = fill(left, capacity - top)
        left[top] += 1
        counts[top] = counts.get(top, 0) + 1
        times = min(left[k] // c for k, c in counts.items())
        slack = (capacity - top - best) * times
        if slack > budget:
            tail.append((top, left.pop(top)))
            continue
        budget -= slack
        offset = 0
        for k in sorted(counts, reverse=True):
            c = counts[k]
            rows.append((k, used[k], c, sequence, offset, False))
            used[k] += times * c
            left[k] -= times * c
            offset += k * c
            if not left[k]:
                del left[k]
        sequence += times
    tail_sequence, offset = sequence, 0
    for k, n in tail:
        rows.append((k, used[k], 1, 0, offset, True))
        offset += k * n
    rows.sort()
    columns = [np.array([r[i] for r in rows], np.int64) for i in range(5)]
    return Plan(*columns, np.array([r[5] for r in rows], bool), tail_sequence, sequence + -(-offset // capacity), capacity)


# ---- assignment ----------------------------------------------------------------

PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, how: Packing = Packing()) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = C.materialise(tokenise(docs, how), "pack-pieces")
    return place(pieces, how)


def place(pieces: DataFrame, how: Packing = Packing()) -> DataFrame:
    counts = C.materialise(pieces.groupBy("chunk", "length").agg(F.count("*").alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length: capacity at most
    the_plan = plan(histogram, how.capacity, how.padding_share)
    before = W.partitionBy("length").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select(F.col("chunk").alias("c"), F.col("length").alias("l"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    slim = pieces.drop("ids")
    ranked = slim.join(base, (slim["chunk"] == base["c"]) & (slim["length"] == base["l"])).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "chunk", "piece", (F.col("base") + F.col("rank")).alias("rank"))

    def look_up(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            length = b.column("length").to_numpy().astype(np.int64)
            sequence, offset, part = the_plan.place(length, b.column("rank").to_numpy().astype(np.int64))
            names = ["doc_id", "start", "ids_crc32", "doc_tokens", "chunk", "piece"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(length), pa.array(sequence), pa.array(offset), pa.array(part)], [*names, "length", "sequence_id", "offset", "part"])

    placed = ranked.mapInArrow(look_up, "doc_id long, start long, ids_crc32 long, doc_tokens long, chunk long, piece long, length long, sequence_id long, offset long, part long")
    placed = C.materialise(placed, "pack-placed")
    order = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = placed.where("part = length").select(*order)
    cut = placed.where("part < length").select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "part", F.col("chunk").alias("c"), F.col("piece").alias("p"))
    ids = pieces.where(F.col("ids").isNotNull()).select("chunk", "piece", "ids")
    cut = cut.join(ids, (F.col("c") == F.col("chunk")) & (F.col("p") == F.col("piece"))).drop("c", "p", "chunk", "piece")

    def in_two(batches):
        import zlib

        import pyarrow as pa

        for b in batches:
            rows = []
            for r in b.to_pylist():
                at = r["part"] * 4
                rows.append((r["doc_id"], r["start"], r["part"], zlib.crc32(r["ids"][:at]), r["doc_tokens"], r["sequence_id"], r["offset"]))
                rows.append((r["doc_id"], r["start"] + r["part"], r["length"] - r["part"], zlib.crc32(r["ids"][at:]), r["doc_tokens"], r["sequence_id"] + 1, 0))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(7)], order)

    return whole.unionByName(cut.mapInArrow(in_two, PLACED))
