import struct
import zlib

import numpy as np
import pytest
from conftest_llm import same
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm import packing as X

FAST, PLAIN = X.encoder("byte_bpe_50k.tiktoken"), X.encoder("byte_bpe_50k.json")


def contract_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_by_the_contract():
    a, b = X.encoder("byte_bpe_50k.json"), X.encoder("byte_bpe_50k.tiktoken")
    end, contract = "<|endoftext|>", contract_ids()
    for t in ("", " ", "a\n\n b", f"{end} x", f"hi {end} there", f"a  {end}{end}\n b", f"{end}  ", end[:-1], "日本語é  \t\r\n", "it's 12345", "x" * 3000, "\u0000�😀"):
        assert a(t).tolist() == b(t).tolist() == contract(t)
    assert b(f"hi {end} there").tolist() == [5303, 220, 50256, 612]


RUN = 3_000_000
LONG = ["a" * RUN, "\n" * RUN, " " * RUN, "\t" * RUN, "\u2003" * (RUN // 3), f"one two{' ' * RUN}<|endoftext|> three.", "\r\n" * (RUN // 2) + "x", ("word" + "\n" * 150_000) * 5, "." * RUN, "7" * RUN]


def test_long_runs(spark):
    """Runs of three million characters: every id is there, in pieces of the contract's ids."""
    contract = contract_ids()
    assert all(FAST(t).tolist() == contract(t) for t in ("x" + " " * n for n in (X.LONG_RUN - 1, X.LONG_RUN, X.LONG_RUN + 1)))
    rows = [(i, t) for i, t in enumerate([*LONG, "short", None, ""])]
    pieces = {}
    for r in X.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert len(pieces) == len(rows)
    for i, t in rows:
        ids, at = np.array([*contract(t or ""), 0], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["<|endoftext|>", " ", "\n", "  ", "'s", "12", "é"]), st.text(max_size=6)), max_size=12))
def test_ids_of_any_text(parts):
    text = "".join(parts)
    assert FAST(text).tolist() == PLAIN(text).tolist()


def check(rows, corpus, cap):
    enc = contract_ids()
    want = sorted((d is None, d or 0, len(enc(t or "")) + 1) for d, t, *_ in corpus)
    per_seq, got = {}, {}
    for r in rows:
        per_seq.setdefault(r.sequence_id, []).append((r.offset, r["length"]))
        got.setdefault((r.doc_id is None, r.doc_id or 0, r.doc_tokens), 0)
        got[r.doc_id is None, r.doc_id or 0, r.doc_tokens] += r["length"]
    for v in per_seq.values():
        at = 0
        for o, n in sorted(v):
            assert o == at and n > 0
            at += n
        assert at <= cap
    total = {}
    for w in want:
        total[w] = total.get(w, 0) + w[2]
    assert got == total
    least = -(-sum(w[2] for w in want) // cap)
    assert set(per_seq) == set(range(len(per_seq))) and least <= len(per_seq) <= 1.02 * least + 1
    for r in rows:
        texts = {t or "" for d, t, *_ in corpus if d == r.doc_id}
        parts = [[*enc(t), 0][r.start : r.start + r["length"]] for t in texts if len(enc(t)) + 1 == r.doc_tokens]
        assert r.ids_crc32 in [zlib.crc32(struct.pack(f"<{len(p)}I", *p)) for p in parts]


def test_every_id_once(docs, corpus, clashing, nothing):
    got = X.pack(docs)
    check(got.collect(), corpus, 1024)
    assert same(got.select("doc_id", "start", "doc_tokens").distinct().where("start = 0"), X.pack(clashing).select("doc_id", "start", "doc_tokens").distinct().where("start = 0"))
    assert X.pack(nothing).count() == 0
    small = X.Packing(capacity=64)
    check(X.pack(docs, small).collect(), corpus, 64)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), max_size=8), st.integers(0, 40))
def test_fill_is_the_best_subset(counts, room):
    best, used = X.fill(counts, room)
    reach = {0}
    for n, c in counts.items():
        reach |= {a + n * k for a in list(reach) for k in range(1, c + 1)}
    assert best == max(x for x in reach if x <= room)
    assert sum(n * k for n, k in used.items()) == best and all(used[n] <= counts[n] for n in used)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 30), min_size=1, max_size=12))
def test_plan_places_all(histogram):
    p = X.plan(histogram, 32)
    length = np.repeat(list(histogram), list(histogram.values()))
    rank = np.concatenate([np.arange(v) for v in histogram.values()])
    seq, off, part = p.place(length.astype(np.int64), rank.astype(np.int64))
    fill = np.zeros((p.sequences, 33), int)
    for s, o, n, k in zip(seq, off, length, part, strict=True):
        fill[s, o : o + k] += 1
        if k < n:
            fill[s + 1, : n - k] += 1
    assert fill.max() == 1 and fill[:, 0].all() and not fill[:, 32].any()
    assert (np.diff(fill, axis=1) <= 0).all()  # gapless from 0
    least = -(-int(length.sum()) // 32)
    assert least <= p.sequences <= 1.02 * least + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 30), min_size=1, max_size=12))
def test_every_window_is_the_closest_fill(histogram):
    """Replayed: with padding allowed, each window holds the longest piece left and the best multiset for the rest; nothing is cut."""
    p = X.plan(histogram, 32, 1.0)
    rows = sorted(zip(p.sequence, -p.length, p.length, p.per, strict=True))
    assert not p.tail.any()
    left, windows = dict(histogram), {}
    for s, _, n, c in rows:
        windows.setdefault(int(s), {})[int(n)] = int(c)
    starts = [*sorted(windows), p.sequences]
    for s, nxt in zip(starts, starts[1:], strict=False):
        for _ in range(nxt - s):
            top = max(k for k, v in left.items() if v)
            assert top in windows[s]
            left[top] -= 1
            assert sum(n * c for n, c in windows[s].items()) == top + X.fill(left, 32 - top)[0]
            left[top] += 1
            for n, c in windows[s].items():
                left[n] -= c
                assert left[n] >= 0
    assert not any(left.values())


def test_unknown_tokenizer(docs):
    with pytest.raises(Exception):
        X.pack(docs, X.Packing(tokenizer="/nowhere.tiktoken"))
