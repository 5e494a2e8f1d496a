import hashlib
import random

import pytest
from conftest_llm import same
from pyspark.sql import functions as F

from kinweave.llm import winnowing as X


def test_edited_texts_and_order(docs, corpus, clashing, nothing):
    got = X.edited_fingerprints(docs)
    rows = got.collect()
    assert len(rows) == len(corpus)
    ids = [c for c in corpus if c[0] is not None and c[0] > 5]
    order = sorted(ids, key=lambda x: -x[0])
    by_id = {r.doc_id: r for r in rows}
    for x, y in zip(order, order[1:], strict=False):
        t, n = x[1] or "", y[1] or ""
        h = len(t) // 2
        edited = t[: len(t) - h] + n[:h]
        assert by_id[x[0]].n_chars == len(t)
        assert by_id[x[0]].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    prints = {}
    for c, r in ((c, by_id[c[0]]) for c in ids):
        assert prints.setdefault(c[1] or "", r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert same(got, X.edited_fingerprints(clashing))
    assert X.edited_fingerprints(nothing).count() == 0
    one = docs.where("doc_id = 7")
    r = X.edited_fingerprints(one).first()
    t = corpus[7][1]
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 2] + t[: len(t) // 2]).encode()).hexdigest()


def test_parts_do_not_change_the_order(docs):
    got = X.edited_fingerprints(docs)
    for how in (X.Winnow(quantiles=1, part_rows=3), X.Winnow(quantiles=7, quantile_rows=2, part_rows=2), X.Winnow(quantile_rows=1, part_rows=1), X.Winnow(quantiles=5, quantile_rows=2, sent_parts=0)):
        assert same(got, X.edited_fingerprints(docs, how))


def brute(text, how=X.Winnow()):
    """(hash, position) pairs, each hash by the definition of the polynomial."""
    k, w = how.k, how.w
    if not text:
        return []
    if len(text) < k:
        return [(sum((ord(c) + 1) * X.BASE ** (len(text) - 1 - j) for j, c in enumerate(text)) % X.PRIME, 0)]
    h = [sum(ord(c) * pow(X.BASE, k - 1 - j, X.PRIME) for j, c in enumerate(text[i : i + k])) % X.PRIME for i in range(len(text) - k + 1)]
    out = []
    for i in range(max(1, len(h) - w + 1)):
        win = h[i : i + w]
        m = min(win)
        at = i + max(j for j, x in enumerate(win) if x == m)
        if (m, at) not in out[-1:]:
            out.append((m, at))
    return out


def test_fingerprint_against_brute_force(docs, corpus):
    how = X.Winnow(k=8, w=4)
    got = {r.doc_id: [(x.hash, x.position) for x in r.fingerprint] for r in X.fingerprints(docs, how).collect()}
    got_wide = {r.doc_id: [(x.hash, x.position) for x in r.fingerprint] for r in X.fingerprints(docs).collect()}
    for c in corpus:
        if c[0] is not None and c[0] > 5:
            assert got[c[0]] == brute(c[1] or "", how) and got_wide[c[0]] == brute(c[1] or ""), c[0]


def test_every_column_against_brute_force(docs, corpus):
    """Likenesses, both fingerprints and the edited text of every document whose neighbour is certain."""
    by_id = {r.doc_id: r for r in X.edited_fingerprints(docs).collect()}
    order = sorted((c for c in corpus if c[0] is not None and c[0] > 5), key=lambda x: -x[0])

    def likeness(a, b):
        a, b = {h for h, _ in a}, {h for h, _ in b}
        return len(a & b) / len(a | b) if a | b else 1.0

    for x, y in zip(order, order[1:], strict=False):
        t, n, r = x[1] or "", y[1] or "", by_id[x[0]]
        h = len(t) // 2
        prints = [brute(z) for z in (t, t[: len(t) - h] + n[:h], n)]
        assert [r.fingerprint, r.edited_fingerprint] == [" ".join(f"{a:X}:{b:X}" for a, b in p) for p in prints[:2]]
        assert (r.near_edited, r.near_next) == (likeness(prints[0], prints[1]), likeness(prints[0], prints[2]))


@pytest.mark.parametrize("script", ["日本語の文章を書きました仮名交じり", "abcdefghijklmnop0123456789+/ABCDEF"])
def test_passages_without_spaces_match_at_any_offset(spark, script):
    r = random.Random(1)
    text = lambda n: "".join(r.choice(script) for _ in range(n))
    shared = text(47)
    df = spark.createDataFrame([(i, text(100 + i) + shared + text(90)) for i in range(20)], "doc_id long, text string")
    sets = [{x.hash for x in z.fingerprint} for z in X.fingerprints(df).collect()]
    assert all(a & b for a in sets for b in sets)


def test_guarantee(spark):
    shared = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, "a b c d e f g h i j " + shared + " k l m n"), (2, shared + " z y x w v u t s")], "doc_id long, text string")
    a, b = (set(x.hash for x in r.fingerprint) for r in X.fingerprints(df).collect())
    assert a & b


def test_spliced_is_the_fingerprint_of_the_whole(spark):
    r = random.Random(4)
    how = X.Winnow(k=4, w=4)
    rows = []
    for i in range(300):
        a, b = ("".join(r.choice("ab" if i % 2 else "abcdefgé日") for _ in range(r.randrange(40))) for _ in range(2))
        rows.append((i, a, b, r.randint(0, len(a)), r.randint(0, len(b))))
    df = spark.createDataFrame(rows, "i long, a string, b string, m long, n long")
    for c in ("a", "b"):
        df = df.withColumn(f"found_{c}", X.choices(F.col(c), how))
    got = df.select("i", X.positions(X.spliced(F.col("a"), F.col("found_a"), F.col("m"), F.col("b"), F.col("found_b"), F.col("n"), how)).alias("f")).collect()
    want = {i: brute(a[:m] + b[:n], how) for i, a, b, m, n in rows}
    for x in got:
        assert [(c.hash, c.position) for c in x.f] == want[x.i], rows[x.i]
