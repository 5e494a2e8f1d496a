"""Removal of passages that an earlier document has, by blockwise suffix sorting.

A byte goes if a string of `length` bytes that covers it also begins in a
document of smaller doc_id. What has to be sorted are the suffixes of all texts
by their first `length` bytes. That is done block by block:

1. Every window of `length` bytes has an anchor, the smallest hash of the
   `gram`-byte strings in it. Equal windows have equal anchors, so an anchor
   that occurs in one text only rules out all its windows. Tasks send anchors'
   hashes to blocks, packed; blocks answer which are repeated. A hash that a
   task has already seen twice is answered there and sent twice at most, so
   frequent passages cost each task the same.
2. The windows of a repeated anchor are one short string. These strings go to
   the block of their anchor (equal ones of one task: the earliest document's
   only, the others are decided on the spot). A block holds all suffixes that
   may be equal; it is handled in parts, by hash of the anchor, and a part is
   sorted one suffix bucket at a time, a bucket being a range of the first
   eight bytes. Suffixes tied in their first and last eight
   bytes are resolved by ranks of a difference cover (0, 1 modulo 3) of the
   block's positions, computed once: any two suffixes reach the cover after the
   same number of steps, under three, where their ranks are compared. Each class
   of equal suffixes gets its smallest doc_id; later members are marked.
   Suffixes whose hash no other document's suffix has are left out before.
   An anchor with more than `hot` strings would fill a block by itself: its
   windows go one by one to the block of their own hash. Tasks are told of such
   anchors by a table of at most (bytes of the corpus / hot) numbers, and never
   more than most_hot, as `hot` grows with the corpus beyond that.
3. Marked ranges go back to their texts.

Texts that occur in several documents (equal in their whole digest) enter once,
as the one of smallest doc_id; the other documents are wholly removed if they are
long enough. Inside, a text goes by 64 bits of its digest, renumbered where two
texts share them.

Defined results: a null text is empty; a text shorter than `length` keeps all; a
null doc_id comes after all others; rows of equal doc_id never remove each
other's bytes; an empty table gives an empty result; other columns are ignored.
Texts are whole at any length; memory is bounded by a block, a task's unsent
strings and the longest text.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import common as C

LAST = (1 << 63) - 1  # stands for a null doc_id
COVER, PERIOD = (0, 1), 3


@dataclass(frozen=True)
class Suffixes:
    length: int = 50
    gram: int = 20
    block_bytes: int = 64 << 20  # of text for each block, about
    least_blocks: int = 96
    most_tasks: int = 20_000  # a task takes its blocks one by one
    part: int = 1 << 19  # suffixes of a block handled at a time, about
    bucket: int = 1 << 18  # suffixes sorted at a time
    hot: int = 1 << 20  # strings of one anchor, about, beyond which its windows are dealt one by one
    most_hot: int = 1 << 22  # anchors that this is done for and tasks are told of (8 bytes each): of a larger corpus those with more than bytes / most_hot strings
    often: int = 16  # of an anchor in one task, from where on the task tells its count
    key_bits: int = 64  # fewer only in tests


def anchors_of(body: np.ndarray, off: np.ndarray, how: Suffixes):
    """Runs of windows that share an anchor: row, first window, number of windows, anchor's hash."""
    length, gram = how.length, how.gram
    none = np.zeros(0, np.int64)
    n, w = len(body), length - gram + 1
    if n < length:
        return none, none, none, none.astype(np.uint64)
    power = C.powers(n + 1)
    back = C.powers(n + 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(C._value_of_byte()[body] * power[:n], out=prefix[1:])
    h = C.mix((prefix[gram:] - prefix[:-gram]) * back[: n - gram + 1])
    del power, back, prefix
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    have = 1
    while have * 2 <= w:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < w:
        low = np.minimum(low[: len(low) - (w - have)], low[w - have :])
    fits = np.diff(off) - length + 1
    rows = np.flatnonzero(fits > 0)
    fits = fits[rows]
    first = np.concatenate(([0], np.cumsum(fits)[:-1])).astype(np.int64)
    start = np.repeat(off[:-1][rows], fits) + np.arange(int(fits.sum())) - np.repeat(first, fits)
    at = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = at[1:] != at[:-1]
    new[first] = True
    run = np.flatnonzero(new)
    count = np.diff(np.concatenate((run, [len(start)])))
    row = np.repeat(rows, fits)[run]
    return row, start[run] - off[row], count, h[at[run]]


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)


# ---- 1: which anchors are repeated -----------------------------------------------

ANCHORS = "block int, key long, hash binary, place binary, row binary, keys binary, often binary"


def _send(kept, blocks: int, how: Suffixes):
    """Rows for the blocks, and answers known here, from a task's anchors: hash, key number, window."""
    import pyarrow as pa

    h = np.concatenate([x[0] for x in kept])
    key = np.concatenate([x[1] for x in kept])
    place = np.concatenate([x[2] for x in kept])
    # a text's anchors come together: name the runs first
    runs = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    keys, name = np.unique(key[runs], return_inverse=True)
    row = np.repeat(name, np.diff(np.concatenate((runs, [len(key)])))).astype(np.uint32)
    order = np.argsort(h)
    h, row, place = h[order], row[order], place[order].astype(np.uint32)
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    size = np.diff(np.concatenate((at, [len(h)])))
    low, high = np.minimum.reduceat(row, at), np.maximum.reduceat(row, at)
    several = np.repeat(low != high, size)
    out = {c: [] for c in ("block", "key", "hash", "place", "row", "keys", "often")}
    many = size >= how.often
    often, often_size = h[at[many]], size[many]
    sent = ~several
    if several.any():  # answered here; one entry of the smallest and of the largest key number speak for the hash
        r, p = row[several], place[several]
        o = np.argsort(r, kind="stable")
        r, p = r[o], p[o]
        cut = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        for a, b in zip(cut, np.concatenate((cut[1:], [len(r)])), strict=True):
            k = int(keys[r[a]])
            for c, v in zip(out, (k % blocks, k, None, p[a:b].tobytes(), None, None, None), strict=True):
                out[c].append(v)
        i = np.flatnonzero(several)
        sent[i] = (row[i] == np.repeat(low, size)[i]) | (row[i] == np.repeat(high, size)[i])
    h, row, place = h[sent], row[sent], place[sent]
    block = block_of(h, blocks)
    o = np.argsort(block)
    h, row, place, block = h[o], row[o], place[o], block[o]
    cut = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    often_block = block_of(often, blocks)
    for a, b in zip(cut, np.concatenate((cut[1:], [len(block)])), strict=True):
        here = often_block == block[a] if len(often) else slice(0)
        counted = np.stack((often[here].astype(np.uint32), np.minimum(often_size[here], (1 << 32) - 1).astype(np.uint32)), axis=1)
        used, local = np.unique(row[a:b], return_inverse=True)
        small = np.uint16 if len(used) <= 1 << 16 else np.uint32
        for c, v in zip(out, (int(block[a]), None, h[a:b].astype(np.uint32).tobytes(), place[a:b].tobytes(), local.astype(small).tobytes(), keys[used].astype("<i8").tobytes(), counted.tobytes()), strict=True):
            out[c].append(v)
    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array(out[c], k) for c, k in zip(out, kinds, strict=True)], list(out))


def _anchors(rows: DataFrame, blocks: int, how: Suffixes) -> DataFrame:
    """rows: key, text."""

    def run(batches):
        kept, held = [], 0
        for b in batches:
            for i, body, off in C.sub_batches(b.column("text")):
                row, start, _, h = anchors_of(body, off, how)
                keys = b.column("key").slice(i, len(off) - 1).to_numpy()
                if len(row):
                    kept.append((h, keys[row], start))
                    held += len(row)
                if held > 3_000_000:
                    yield _send(kept, blocks, how)
                    kept, held = [], 0
        if held:
            yield _send(kept, blocks, how)

    return rows.mapInArrow(run, ANCHORS)


def _repeated(sent: DataFrame, blocks: int, how: Suffixes) -> DataFrame:
    """key, places (windows whose anchor another text has); of key null: hot anchors, block and the hash's low half as one number."""

    def run(batches):
        import pyarrow as pa

        for rows in C.groups(batches, "block"):
            known = [r for r in rows if r["hash"] is None]
            if known:
                yield pa.RecordBatch.from_arrays([pa.array([r["key"] for r in known], pa.int64()), pa.array([r["place"] for r in known], pa.binary())], ["key", "place"])
            rows = [r for r in rows if r["hash"] is not None]
            if not rows:
                continue
            h = np.concatenate([np.frombuffer(r["hash"], np.uint32) for r in rows])
            told = np.concatenate([np.frombuffer(r["often"], np.uint32).reshape(-1, 2) for r in rows])
            anchors, at = np.unique(np.concatenate((h, told[:, 0])), return_inverse=True)
            hot = anchors[np.bincount(at, np.concatenate((np.ones(len(h)), told[:, 1]))) >= how.hot]
            if len(hot):
                names = (np.int64(rows[0]["block"]) << np.int64(32)) | hot.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([names.tobytes()], pa.binary())], ["key", "place"])
            key = np.concatenate([np.frombuffer(r["keys"], "<i8")[np.frombuffer(r["row"], np.uint16 if len(r["keys"]) <= 8 << 16 else np.uint32)] for r in rows])
            place = np.concatenate([np.frombuffer(r["place"], np.uint32) for r in rows])
            order = np.argsort(h)
            h, key, place = h[order], key[order], place[order]
            at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            size = np.diff(np.concatenate((at, [len(h)])))
            several = np.repeat(np.minimum.reduceat(key, at) != np.maximum.reduceat(key, at), size)
            key, place = key[several], place[several]
            if not len(key):
                continue
            o = np.argsort(key)
            key, place = key[o], place[o]
            cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            end = np.concatenate((cut[1:], [len(key)]))
            yield pa.RecordBatch.from_arrays([pa.array(key[cut]), pa.array([place[a:b].tobytes() for a, b in zip(cut, end, strict=True)], pa.binary())], ["key", "place"])

    answers = sent.repartition(min(blocks, how.most_tasks), "block").sortWithinPartitions("block").mapInArrow(run, "key long, place binary")
    return answers.groupBy("key").agg(F.collect_list("place").alias("places"))


# ---- 2: suffixes of repeated anchors ---------------------------------------------

STRINGS = "block int, key long, doc binary, keys binary, place binary, count binary, fine binary, bytes binary, marks binary"


def _pack_strings(parts: list, blocks: int, how: Suffixes):
    """Rows for the blocks, and ranges decided here, from a task's strings.

    Of equal strings those of the earliest document go on; the windows of the
    others are decided.
    """
    import pyarrow as pa

    body = np.concatenate([p[0] for p in parts])
    shift = np.concatenate(([0], np.cumsum([len(p[0]) for p in parts])[:-1]))
    at = np.concatenate([p[1] + x for p, x in zip(parts, shift, strict=True)])
    place, count, block, doc, key, fine = (np.concatenate([p[i] for p in parts]) for i in range(2, 8))
    size = count + how.length - 1
    power, back = C.powers(len(body) + 1), C.powers(len(body) + 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
    prefix = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(C._value_of_byte()[body] * power[:-1], out=prefix[1:])
    h = C.mix((prefix[at + size] - prefix[at]) * back[at] + size.astype(np.uint64))
    del power, back, prefix
    order = np.lexsort((doc, h))
    h, d = h[order], doc[order]
    first = np.concatenate(([True], h[1:] != h[:-1]))
    head = np.flatnonzero(first)[np.cumsum(first) - 1]  # the earliest of each group
    late = np.flatnonzero(d > d[head])
    if len(late):  # equal hashes are not taken for equal strings
        x, y = order[late], order[head[late]]
        same = size[x] == size[y]
        late, x, y = late[same], x[same], y[same]
        equal = body[C.ragged(at[x], size[x])] == body[C.ragged(at[y], size[x])]
        if len(late):
            late = late[np.logical_and.reduceat(equal, np.concatenate(([0], np.cumsum(size[x])[:-1])))]
    decided = np.zeros(len(h), bool)
    decided[late] = True
    out = {c: [] for c in ("block", "key", "doc", "keys", "place", "count", "fine", "bytes", "marks")}
    x = order[decided]
    if len(x):
        x = x[np.argsort(key[x], kind="stable")]
        pairs = np.stack((place[x], place[x] + count[x] - 1 + how.length), axis=1).astype("<u4")
        cut = np.flatnonzero(np.concatenate(([True], key[x][1:] != key[x][:-1])))
        for a, b in zip(cut, np.concatenate((cut[1:], [len(x)])), strict=True):
            k = int(key[x[a]])
            for c, v in zip(out, (k % blocks, k, None, None, None, None, None, None, pairs[a:b].tobytes()), strict=True):
                out[c].append(v)
    x = order[~decided]
    x = x[np.argsort(block[x], kind="stable")]
    text = body[C.ragged(at[x], size[x])]
    ends = np.concatenate(([0], np.cumsum(size[x])))
    cut = np.flatnonzero(np.concatenate(([True], block[x][1:] != block[x][:-1]))) if len(x) else []
    for a, b in zip(cut, np.concatenate((cut[1:], [len(x)])) if len(x) else [], strict=True):
        y = x[a:b]
        row = (int(block[y[0]]), None, doc[y].astype("<i8").tobytes(), key[y].astype("<i8").tobytes(), place[y].astype("<u4").tobytes(), count[y].astype("<u4").tobytes(), fine[y].tobytes(), text[ends[a] : ends[b]].tobytes(), None)
        for c, v in zip(out, row, strict=True):
            out[c].append(v)
    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 7)
    return pa.RecordBatch.from_arrays([pa.array(out[c], k) for c, k in zip(out, kinds, strict=True)], list(out))


def _one_by_one(body: np.ndarray, first: np.ndarray, count: np.ndarray, how: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Every window of strings (first byte, number of windows): its first byte, and a hash of its bytes."""
    at = C.ragged(first, count)
    return at, C.segment_hash(body, at, at + how.length)


def _strings(rows: DataFrame, blocks: int, how: Suffixes, hot=None) -> DataFrame:
    """rows: key, doc (long), text, places; hot: a broadcast sorted array of hot anchors."""

    def run(batches):
        parts, held = [], 0
        for b in batches:
            for i, body, off in C.sub_batches(b.column("text")):
                part = b.slice(i, len(off) - 1)
                row, start, count, h = anchors_of(body, off, how)
                wanted = [np.frombuffer(b"".join(x or []), np.uint32) for x in part.column("places").to_pylist()]
                want = np.concatenate([np.int64(j) << np.int64(32) | w.astype(np.int64) for j, w in enumerate(wanted)]) if wanted else np.zeros(0, np.int64)
                take = np.isin(row << np.int64(32) | start, want)
                row, start, count, h = row[take], start[take], count[take], h[take]
                if not len(row):
                    continue
                if hot is not None:
                    name = (block_of(h, blocks) << np.int64(32)) | (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
                    at = np.minimum(np.searchsorted(hot.value, name), len(hot.value) - 1)
                    single = hot.value[at] == name
                    windows, wh = _one_by_one(body, (off[row] + start)[single], count[single], how)
                    owner = np.repeat(row[single], count[single])
                    row, start = np.concatenate((row[~single], owner)), np.concatenate((start[~single], windows - off[owner]))
                    count, h = np.concatenate((count[~single], np.ones(len(wh), np.int64))), np.concatenate((h[~single], wh))
                parts.append((body, off[row] + start, start, count, block_of(h, blocks), part.column("doc").to_numpy()[row], part.column("key").to_numpy()[row], (h >> np.uint64(8)).astype(np.uint8)))
                held += len(body) + 60 * len(row)
                if held > 16 << 20:
                    yield _pack_strings(parts, blocks, how)
                    parts, held = [], 0
        if parts:
            yield _pack_strings(parts, blocks, how)

    return rows.mapInArrow(run, STRINGS)


def _cover_steps() -> dict:
    """(residue, residue) -> the least number of steps that takes both into the cover."""
    return {(a, b): next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for a in range(PERIOD) for b in range(a, PERIOD)}


def earliest(text: np.ndarray, start: np.ndarray, doc: np.ndarray, length: int, bucket: int) -> np.ndarray:
    """For each suffix (its first `length` bytes lie in text), the smallest doc among the suffixes equal to it in these bytes.

    text ends with eight more bytes than any suffix needs.
    """
    best = doc.copy()
    if not len(start):
        return best
    power, back = C.powers(len(text) + 1), C.powers(len(text) + 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
    prefix = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(C._value_of_byte()[text] * power[:-1], out=prefix[1:])
    h = (prefix[start + length] - prefix[start]) * back[start]
    del power, back, prefix
    order = np.argsort(h)
    h = h[order]
    cut = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    own = doc[order]
    apart = np.minimum.reduceat(own, cut) != np.maximum.reduceat(own, cut)
    keep = order[np.repeat(apart, np.diff(np.concatenate((cut, [len(h)]))))]
    if not len(keep):
        return best
    start = start[keep]
    eight = np.lib.stride_tricks.sliding_window_view(text, 8)

    def word(at):
        return np.ascontiguousarray(eight[at]).view(">u8").reshape(-1).astype(np.uint64)

    # ranks of the cover's positions by length - PERIOD + 1 bytes
    reach, steps = length - PERIOD + 1, _cover_steps()
    covered = np.zeros(len(text), bool)
    for d in range(PERIOD):
        covered[start + d] = True
    sample = np.flatnonzero(covered)
    sample = sample[np.isin(sample % PERIOD, COVER)]
    words = [word(sample + min(x, reach - 8)) for x in range(0, reach, 8)]
    by = np.lexsort(words[::-1])
    differs = np.zeros(len(sample), bool)
    for v in words:
        s = v[by]
        differs[1:] |= s[1:] != s[:-1]
    rank = np.zeros(len(text), np.int64)
    rank[sample[by]] = np.cumsum(differs)
    del words
    head = word(start)
    order = np.argsort(head)
    sorted_head = head[order]
    a = 0
    while a < len(order):  # one suffix bucket: a range of first eight bytes
        b = min(a + bucket, len(order))
        b = int(np.searchsorted(sorted_head, sorted_head[b - 1], "right"))
        at, hd = order[a:b], sorted_head[a:b]
        a = b
        p = start[at]
        tail = word(p + length - 8)
        o = np.lexsort((tail, hd))
        at, p, tail, hd = at[o], p[o], tail[o], hd[o]
        group = np.cumsum(np.concatenate(([False], (hd[1:] != hd[:-1]) | (tail[1:] != tail[:-1]))))
        own = doc[keep[at]]
        low = own.copy()
        residue = p % PERIOD
        for (x, y), d in steps.items():
            m = np.flatnonzero((residue == x) | (residue == y))
            if not len(m):
                continue
            key = group[m] * np.int64(len(sample) + 1) + rank[p[m] + d]
            s = np.argsort(key)
            k = key[s]
            cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            least = np.repeat(np.minimum.reduceat(own[m][s], cut), np.diff(np.concatenate((cut, [len(k)]))))
            low[m[s]] = np.minimum(low[m[s]], least)
        best[keep[at]] = low
    return best


def _marks(strings: DataFrame, blocks: int, how: Suffixes) -> DataFrame:
    """key, marks: ranges of bytes (first, end) as uint32 pairs."""

    def run(batches):
        import pyarrow as pa

        for rows in C.groups(batches, "block"):
            known = [r for r in rows if r["doc"] is None]
            if known:
                yield pa.RecordBatch.from_arrays([pa.array([r["key"] for r in known], pa.int64()), pa.array([r["marks"] for r in known], pa.binary())], ["key", "marks"])
            rows = [r for r in rows if r["doc"] is not None]
            if not rows:
                continue
            doc, key = (np.concatenate([np.frombuffer(r[c], "<i8") for r in rows]) for c in ("doc", "keys"))
            place, count = (np.concatenate([np.frombuffer(r[c], "<u4") for r in rows]).astype(np.int64) for c in ("place", "count"))
            fine = np.concatenate([np.frombuffer(r["fine"], np.uint8) for r in rows]).astype(np.int64)
            text = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
            del rows
            size = count + how.length - 1
            first = np.concatenate(([0], np.cumsum(size)[:-1]))
            parts = max(1, -(-int(count.sum()) // how.part))
            which = fine * parts // 256
            for i in range(parts):
                m = np.flatnonzero(which == i)
                if len(m):
                    yield from part_marks(text[C.ragged(first[m], size[m])], doc[m], key[m], place[m], count[m])

    def part_marks(text, doc, key, place, count):
        import pyarrow as pa

        text = np.concatenate((text, np.zeros(8, np.uint8)))
        first = np.concatenate(([0], np.cumsum(count + how.length - 1)[:-1]))
        entry = np.repeat(np.arange(len(doc)), count)
        nth = np.arange(len(entry)) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count)
        best = earliest(text, first[entry] + nth, doc[entry], how.length, how.bucket)
        hit = best < doc[entry]
        # runs of marked windows of an entry
        prev = np.concatenate(([False], hit[:-1] & (entry[1:] == entry[:-1])))
        nxt = np.concatenate((hit[1:] & (entry[1:] == entry[:-1]), [False]))
        begin, last = np.flatnonzero(hit & ~prev), np.flatnonzero(hit & ~nxt)
        if not len(begin):
            return
        k = key[entry[begin]]
        lo, hi = place[entry[begin]] + nth[begin], place[entry[last]] + nth[last] + how.length
        o = np.argsort(k, kind="stable")
        k, pairs = k[o], np.stack((lo[o], hi[o]), axis=1).astype("<u4")
        cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        end = np.concatenate((cut[1:], [len(k)]))
        yield pa.RecordBatch.from_arrays([pa.array(k[cut]), pa.array([pairs[a:b].tobytes() for a, b in zip(cut, end, strict=True)], pa.binary())], ["key", "marks"])

    found = strings.repartition(min(blocks, how.most_tasks), "block").sortWithinPartitions("block").mapInArrow(run, "key long, marks binary")
    return found.groupBy("key").agg(F.collect_list("marks").alias("marks"))


# ---- all together -----------------------------------------------------------------


def marked(docs: DataFrame, how: Suffixes = Suffixes()) -> tuple[DataFrame, DataFrame]:
    """(texts: __kw_key, __kw_first (smallest doc_id with the text), __kw_marks; docs with __kw_key and __kw_doc)."""
    C.small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn("__kw_text", text)
    rows = rows.withColumn("__kw_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("__kw_digest", C.digest_of(F.col("__kw_text")))
    rows = rows.withColumn("__kw_key", C.key_of(F.col("__kw_digest"), how.key_bits))
    firsts = rows.groupBy(F.col("__kw_key").alias("key"), F.col("__kw_digest").alias("digest")).agg(F.min("__kw_doc").alias("first"), F.max(F.octet_length("__kw_text").cast("long")).alias("size"))
    firsts = C.materialise(firsts, "suffix-texts")
    new = C.renumbered(firsts.select("key", "digest"))
    firsts, rows = C.rekeyed(firsts, new, "digest", "key"), C.rekeyed(rows, new, "__kw_digest", "__kw_key")
    total = firsts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    how = replace(how, hot=max(how.hot, int(total // how.most_hot) + 1))
    blocks = int(max(total // how.block_bytes, how.least_blocks))
    slim = rows.where(F.octet_length("__kw_text") >= how.length).select(F.col("__kw_key").alias("key"), F.col("__kw_doc").alias("doc"), F.col("__kw_text").alias("text"))
    repeated = C.materialise(_repeated(_anchors(slim.select("key", "text"), blocks, how), blocks, how), "suffix-repeated")
    named = repeated.where("key is null").select(F.explode("places")).collect()  # a number for each hot anchor
    hot = None
    if named:
        hot = docs.sparkSession.sparkContext.broadcast(np.sort(np.concatenate([np.frombuffer(r[0], np.int64) for r in named])))
    sources = repeated.join(firsts.select(F.col("key").alias("k"), "first"), F.col("key") == F.col("k")).select("k", "first", "places")
    candidates = slim.join(sources, (F.col("key") == F.col("k")) & (F.col("doc") == F.col("first"))).select("key", "doc", "text", "places")
    marks = C.materialise(_marks(_strings(candidates, blocks, how, hot), blocks, how), "suffix-marks")
    C.forget(repeated)
    texts = firsts.select("key", "first").join(marks.withColumnRenamed("key", "k"), F.col("key") == F.col("k"), "left").select(F.col("key").alias("__kw_k"), F.col("first").alias("__kw_first"), F.col("marks").alias("__kw_marks"))
    return texts, rows


def _kept(text: bytes, copy: bool, marks: list, length: int):
    """(remaining bytes, removed, spans)."""
    n = len(text)
    if copy and n >= length:
        return b"", n, 1
    if not marks or copy:
        return text, 0, 0
    pairs = np.frombuffer(b"".join(marks), "<u4").reshape(-1, 2).astype(np.int64)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, pairs[:, 0], 1)
    np.add.at(step, pairs[:, 1], -1)
    gone = np.cumsum(step[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def _applied(docs: DataFrame, how: Suffixes, with_text: bool, carry: list[str]) -> DataFrame:
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    if with_text:
        docs = docs.select(F.struct(*carry).alias("__kw_row"), "doc_id", "text")
    texts, rows = marked(docs, how)
    if with_text:
        slim = rows.select("__kw_row", "__kw_text", "__kw_doc", "__kw_key")
        kept, kept_type = "__kw_row", "struct<" + ",".join(f"`{c}`:{fields[c]}" for c in carry) + ">"
    else:
        slim = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "__kw_text", "__kw_doc", "__kw_key")
        kept, kept_type = "doc_id", "bigint"
    joined = slim.join(texts, F.col("__kw_key") == F.col("__kw_k")).select(kept, "__kw_text", (F.col("__kw_doc") > F.col("__kw_first")).alias("copy"), "__kw_marks")

    def run(batches):
        import hashlib

        import pyarrow as pa

        for b in batches:
            for i, body, off in C.sub_batches(b.column("__kw_text"), 1 << 22):
                part, whole = b.slice(i, len(off) - 1), body.tobytes()
                got = [_kept(whole[off[j] : off[j + 1]], c, m, how.length) for j, (c, m) in enumerate(zip(part.column("copy").to_pylist(), part.column("__kw_marks").to_pylist(), strict=True))]
                columns = [part.column(kept), pa.array(np.diff(off)), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()), pa.array([hashlib.sha256(g[0]).hexdigest() for g in got], pa.string())]
                names = [kept, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    columns.append(pa.array([g[0].decode("utf-8", "ignore") for g in got], pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"{kept} {kept_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return joined.mapInArrow(run, schema)


def repeats(docs: DataFrame, how: Suffixes = Suffixes()) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return _applied(docs, how, False, [])


def remove_repeats(docs: DataFrame, how: Suffixes = Suffixes()) -> DataFrame:
    """docs with the remaining bytes as text (a character that lost a byte is dropped) and n_chars to match; null texts stay null."""
    names, kinds = docs.columns, dict(docs.dtypes)
    got = _applied(docs, how, True, names)
    text = F.when(F.col("__kw_row")["text"].isNotNull(), F.col("kept_text"))
    columns = [text.alias(c) if c == "text" else F.length(text).cast(kinds[c]).alias(c) if c == "n_chars" else F.col("__kw_row")[c].alias(c) for c in names]
    return got.select(*columns)
