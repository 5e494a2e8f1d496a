import hashlib
import random

import numpy as np
import pytest
from conftest_llm import same

from kinweave.llm import suffixes as X


def removed(rows, n=50):
    """doc_id, bytes and a mark for each byte that goes, of each (doc_id, text)."""
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        d = X.LAST if d is None else d
        for p in range(len(b) - n + 1):
            k = b[p : p + n]
            first[k] = min(first.get(k, d), d)
    for d, t in rows:
        b, own = (t or "").encode(), X.LAST if d is None else d
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < own:
                gone[p : p + n] = b"\1" * n
        yield d, b, gone


def brute(rows, n=50):
    out = []
    for d, b, gone in removed(rows, n):
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def kept_text(rows):
    """doc_id and remaining text of each row; a character that lost a byte is dropped, null stays null."""
    marks = removed([r[:2] for r in rows])
    return [(r[0], None if r[1] is None else bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")) for r, (_, b, gone) in zip(rows, marks, strict=True)]


def test_against_brute_force(docs, corpus, clashing, nothing):
    got = X.repeats(docs)
    assert sorted(map(tuple, got.collect()), key=str) == brute([c[:2] for c in corpus])
    assert same(got, X.repeats(clashing))
    assert X.repeats(nothing).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_periodic_and_overlapping(spark, seed):
    r = random.Random(seed)
    pool = ["ab" * 60, "a" * 200, "é" * 70, "xyz" * 40 + "q"]
    rows = []
    for i in range(40):
        t = "".join(r.choice(pool)[r.randrange(20) : r.randrange(40, 120)] for _ in range(r.randint(0, 4))) + ("" if r.random() < 0.5 else str(r.random()) * 6)
        rows.append((r.randrange(25), t))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    how = X.Suffixes(least_blocks=3, bucket=64, part=500)
    assert sorted(map(tuple, X.repeats(df, how).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("how", [X.Suffixes(hot=2, least_blocks=3), X.Suffixes(hot=30, often=2, least_blocks=2), X.Suffixes(key_bits=3), X.Suffixes(key_bits=0, hot=5), X.Suffixes(hot=1, most_hot=3, least_blocks=2)])
def test_hot_anchors_and_clashing_keys(docs, corpus, spark, how):
    """Frequent passages between ever different words; texts whose keys are the same."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdef") for _ in range(5))
    more = [(2000 + i, " ".join([word() for _ in range(r.randint(0, 8))] + ["one and the same phrase"] + [word() for _ in range(8)] + ["one and the same phrase"] + ["tail tail tail"] * (i % 4))) for i in range(60)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    assert sorted(map(tuple, X.repeats(df, how).collect()), key=str) == brute([*(c[:2] for c in corpus), *more])


def test_bucket_sort_kernel():
    r = np.random.default_rng(4)
    text = np.concatenate((r.integers(97, 99, 3000).astype(np.uint8), np.tile(r.integers(97, 101, 90).astype(np.uint8), 12), np.zeros(8, np.uint8)))
    start = np.arange(0, len(text) - 8 - 50)
    doc = r.integers(0, 50, len(start))
    whole = text.tobytes()
    least = {}
    for s, d in zip(start, doc, strict=True):
        k = whole[s : s + 50]
        least[k] = min(least.get(k, d), d)
    want = np.array([least[whole[s : s + 50]] for s in start])
    for bucket in (7, 1000):
        assert (X.earliest(text, start, doc, 50, bucket) == want).all()


def test_texts(docs, nothing):
    out = X.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    row = out.where("doc_id = 26").first()
    assert row.text == "" and row.n_chars == 0
    assert out.where("text is null").count() == docs.where("text is null").count()
    assert X.remove_repeats(nothing).count() == 0
