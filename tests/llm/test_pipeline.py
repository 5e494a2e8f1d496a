import math
import os
import zlib
from collections import Counter

import pytest
import test_minhash
import test_packing
import test_suffixes
import xxhash
from conftest_llm import words_of

import corpus_pipeline as P
from kinweave.llm import langid, mixing, packing, queries


def test_stages(spark, docs, clashing, nothing, tmp_path):
    for i, start in enumerate((clashing, nothing)):
        tmp_path = tmp_path / str(i)
        df = start
        for i, (name, stage) in enumerate(P.STAGES):
            df = stage(spark, df, "")
            if i < len(P.STAGES) - 1:
                assert df.columns == start.columns, name
            path = str(tmp_path / f"{name}-{start.count()}")
            df.write.parquet(path)
            df = spark.read.parquet(path)
        assert (df.count() > 0) == (start is not nothing)


def test_other_results_outlive_stages(spark, docs):
    """Frames held unread keep their scratch tables while stages run: those of queries, and those of another run."""
    before = list(P._alone)
    held = packing.pack(docs)
    assert P._alone == before
    token = P._of_run.set([])
    of_run = P.packed_sequences(spark, docs, "")
    P._of_run.reset(token)
    alone = P.packed_sequences(spark, docs, "")
    made = list(P._alone)
    P.mixing_sources(spark, docs, "").count()
    assert made and not set(made) & set(P._alone)  # swept by the next stage
    assert held.count() == of_run.count() > 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        alone.count()


# ---- brute-force versions of the stages, on lists of rows (doc_id, text, lang, source, n_chars) ----


def log_sum(xs):
    top = max(xs)
    return top if top == -math.inf else top + math.log(sum(math.exp(x - top) for x in xs))


def arcs(word, p, longest):
    """For each place the (length, piece) that may stand there; None is the unknown character."""
    return [[(n, x if x in p else None) for n in range(1, min(longest, len(word) - i) + 1) for x in [word[i : i + n]] if x in p or n == 1] for i in range(len(word))]


def forward(word, p, longest):
    a = [0.0] + [-math.inf] * len(word)
    for i, here in enumerate(arcs(word, p, longest)):
        for n, x in here:
            a[i + n] = log_sum([a[i + n], a[i] + math.log(p[x])])
    return a


def brute_languages(rows, how=langid.LangId()):
    pieces = langid.pieces_of(how)
    longest = max(map(len, pieces))
    learned = {}
    for d, t, lang, *_ in rows:
        if lang is not None and t is not None and d is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            learned.setdefault(lang, Counter()).update(langid.LETTERS.findall(t.lower()))
    models = {}
    for lang, counts in learned.items():
        p = dict.fromkeys(pieces, 1 / len(pieces)) | {None: how.unknown}
        for _ in range(how.iterations):
            used = dict.fromkeys(pieces, 0.0)
            for w, n in counts.items():
                w = "▁" + w
                a, b = forward(w, p, longest), [-math.inf] * len(w) + [0.0]
                for i in range(len(w) - 1, -1, -1):
                    for k, x in arcs(w[i:], p, longest)[0]:
                        rest = math.log(p[x]) + b[i + k]
                        b[i] = log_sum([b[i], rest])
                        if x is not None:
                            used[x] += n * math.exp(a[i] + rest - a[-1])
            whole = sum(used.values())
            p = {k: (1 - how.smoothing) * v / whole + how.smoothing / len(pieces) for k, v in used.items()} | {None: how.unknown}
        models[lang] = p
    scores = {}
    out = []
    for row in rows:
        words = langid.LETTERS.findall((row[1] or "").lower())
        if words:
            logs = []
            for lang, p in models.items():
                for w in words:
                    if (lang, w) not in scores:
                        scores[lang, w] = forward("▁" + w, p, longest)[-1]
                logs.append(sum(scores[lang, w] for w in words))
            if 1 / sum(math.exp(x - max(logs)) for x in logs) >= 0.5:
                out.append(row)
    return out


def brute_mixing(rows, mix=mixing.Mix()):
    """The mix replayed: targets by filling up, slots, permutations and streams by the same hash, in plain loops."""

    def hashed(*values):
        h = 42
        for v in values:
            if v is not None:
                data = v.encode() if isinstance(v, str) else v[1].to_bytes(v[0], "little", signed=True)
                h = xxhash.xxh64(data, seed=h & (1 << 64) - 1).intdigest()
        return h - (1 << 64) if h >> 63 else h

    i4, i8 = (lambda x: (4, x)), (lambda x: None if x is None else (8, x))
    sources = sorted({r[3] for r in rows if r[3] is not None}) + ([None] if any(r[3] is None for r in rows) else [])
    own = {s: sorted(((hashed(i8(r[0]), i8(hashed(r[1])), i4(mix.seed)), r) for r in rows if r[3] == s), key=lambda x: (x[0], x[1][0] is not None, x[1][0] or 0)) for s in sources}
    buckets = max(1, len(rows) // mix.rows_per_bucket)
    assert buckets == 1
    size = {s: sum(len(words_of(r[1])) for _, r in own[s]) for s in sources}
    weight = {s: mix.weights[i % 3] for i, s in enumerate(sources)}
    target, left, open_ = {}, min(mix.share, mix.most) * sum(size.values()), set(sources)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > mix.most * size[s]}
        for s in over or open_:
            target[s] = min(level * weight[s], mix.most * size[s])
            left -= target[s]
        open_ -= over or open_
    blocks = {s: -(-size[s] // mix.block_words) for s in sources if size[s]}
    quota = {s: int(math.floor(target[s] / size[s] * blocks[s] + 0.5)) for s in blocks}
    total = sum(quota.values())
    edges, at = [], 0
    for s in sources:
        if quota.get(s):
            edges.append((s, at / total, (at + quota[s]) / total))
            at += quota[s]
    drawn = Counter()
    for i in range(total):
        u = ((hashed(i8(i // mix.shard_slots), i8(i % mix.shard_slots), i4(mix.seed)) & (1 << 64) - 1) >> 11) / (1 << 53)
        drawn[next(s for s, lo, hi in edges if lo <= u < hi)] += 1
    taken = {}
    for s, n in quota.items():
        assert drawn[s] >= 0  # draws beyond the quota are void, those short of it come from the last shard: all numbers below it occur
        for j in range(n):
            turn, x = j // blocks[s], j % blocks[s]
            for r in range(1, mix.rounds + 1):
                key = [i4(mix.seed), s, i8(turn), i4(r)]
                other = (hashed(*key) % blocks[s] - x) % blocks[s]
                if hashed(*key, i8(max(x, other)), i4(1)) & 1:
                    x = other
            taken[s, turn, x] = True
    out = []
    for s in sources:
        start = 0
        for _, r in own[s]:
            words = words_of(r[1])
            for turn in range(3):
                chosen = [w for i, w in enumerate(words) if (s, turn, (start + i) // mix.block_words) in taken]
                if chosen:
                    out.append((r[0], tuple(chosen), r[2], r[3]))
            start += len(words)
    return out


def test_each_stage_against_brute_force(spark, docs, corpus, tmp_path):
    """Every stage on what the one before kept."""
    rows, df, got = [tuple(r) for r in corpus], docs, {}
    key = lambda r: tuple((v is None, str(v)) for v in r)
    for name, stage in P.STAGES:
        out = stage(spark, df, "")
        path = str(tmp_path / name)
        out.write.parquet(path)
        df = spark.read.parquet(path)
        got = [tuple(r) for r in df.collect()]
        if name == "language_id":
            assert sorted(got, key=key) == sorted(brute_languages(rows), key=key)
        elif name == "near_duplicates":
            classes = {}
            for r, (_, c) in zip(sorted(rows, key=lambda r: str(r[:2])), sorted(test_minhash.labelled([r[:2] for r in rows]), key=lambda x: str(x[0])), strict=True):
                classes.setdefault(c, []).append(r)
            assert len(got) == len(classes)
            for members in classes.values():
                least = min((r[0] for r in members if r[0] is not None), default=None)
                assert sum(g in members and g[0] == least for g in got) >= 1
        elif name == "repeated_passages":
            want = sorted((test_suffixes.kept_text(rows)), key=key)
            assert sorted((r[:2] for r in got), key=key) == want and all(r[4] == (None if r[1] is None else len(r[1])) for r in got)
        elif name == "mixing":
            assert sorted(((r[0], tuple(words_of(r[1])), r[2], r[3]) for r in got), key=key) == sorted(brute_mixing(rows), key=key)
        else:
            test_packing.check(df.collect(), rows, 1024)
        rows = got


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_registered(spark):
    import duckdb

    assert [int(k[2:].split("_")[0]) for k in queries.QUERIES] == list(range(1, 11))
    con = duckdb.connect()
    con.sql("create view pages as select * from '/root/testdata/sf0.001/pages.parquet'")
    got = sorted(map(tuple, queries.op10_warc(spark, "/root/testdata/sf0.001").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    assert got == sorted(con.sql(f"select page_id, payload_bytes, payload_digest, record_type, refers_to from ({queries.OP10_SQL})").fetchall())
