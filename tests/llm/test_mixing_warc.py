import base64
import gzip
import hashlib
import io
import random

import pytest
from conftest_llm import same, words_of
from pyspark.sql import functions as F

from kinweave.llm import mixing, warc


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total = min(1.5 * sum(sizes.values()), 2.0 * sum(sizes.values()))
    open_, target, left = set(names), {}, total
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix(docs, corpus, clashing, nothing):
    got = mixing.taken(docs)
    rows = got.collect()
    assert len(rows) == len(corpus)
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in rows) == sorted((c[0] is None, c[0] or 0, len(words_of(c[1]))) for c in corpus)
    sizes = {}
    for c in corpus:
        sizes[c[3]] = sizes.get(c[3], 0) + len(words_of(c[1]))
    want = brute_targets(sizes)
    took = {}
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        took[r.source] = took.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(took[s] - t) <= 64 + 0.02 * t, (s, took[s], t)
    assert same(got, mixing.taken(docs)) and same(got, mixing.taken(clashing.repartition(5)))
    assert mixing.taken(nothing).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 1000, None: 5}, {"a": 7}, {"x": 0, "y": 50}, {f"s{i:02}": (i * 37) % 100 + 1 for i in range(20)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), [F.lit(5), F.lit("s")], 24).alias("p"))
        got = [r.p for r in df.collect()]
        assert sorted(got) == list(range(n))
    assert got != sorted(got)


def test_draws_meet_quotas(spark):
    mix = mixing.Mix(shard_slots=32)
    per = spark.createDataFrame([("a", 1000, 2000.0), ("b", 5000, 2500.0), (None, 64, 100.0)], "source string, source_size long, target double")
    q = {r.source: r for r in mixing.quotas(per, mix).collect()}
    rows = mixing.draws(per, mix).collect()
    for s, x in q.items():
        own = [r for r in rows if r.source == s]
        assert len(own) == x.quota
        for p in {r["pass"] for r in own}:
            blocks = [r.block for r in own if r["pass"] == p]
            assert len(set(blocks)) == len(blocks) and set(blocks) <= set(range(x.n_blocks))
    assert len({(r.shard, r.slot, r.source) for r in rows}) == len(rows)


def test_mixed_texts(docs, nothing):
    out = mixing.mixed_texts(docs)
    assert out.columns == docs.columns
    words = sum(len(words_of(r.text)) for r in out.collect())
    assert words == mixing.taken(docs).agg(F.sum("taken")).first()[0]
    full = {(r.doc_id, r.text) for r in docs.where("source = 's2'").collect()}
    assert any((r.doc_id, r.text) in full for r in out.collect())
    assert mixing.mixed_texts(nothing).count() == 0


PAGES = "page_id long, url string, html string, key int"


def pages(spark):
    same_html = "<p>" + "dup" * 50
    rows = [(i, f"http://h/{i}", f"<html>{i} é {'x' * (i * 997 % 5000)}", 1) for i in range(60)]
    rows += [(100, None, same_html, 1), (90, "http://a\r\nb", same_html, 1), (95, "u", same_html, 1), (101, "u", None, 1), (102, "u", "", 1), (103, "u", "\x1f\x08 WARC/1.1\r\n", 1), (104, "u", "y" * 200_000, 1), (None, "n", "null id", 1), (105, "u", "null id", 1)]
    return spark.createDataFrame(rows, PAGES), rows


@pytest.mark.parametrize("split", [97, 4096, 1 << 23])
def test_round_trip(spark, tmp_path, split):
    df, rows = pages(spark)
    got = warc.round_trip(df.repartition(3), str(tmp_path / "w"), split_bytes=split, with_payload=True).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    by_id = {r.page_id: r for r in got}
    for i, url, html, _ in rows:
        b, r = (html or "").encode(), by_id[i]
        assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        lead = first.get(html or "")
        assert (r.record_type, r.refers_to) == (("response", None) if i == lead else ("revisit", lead))
        assert (None if r.payload is None else bytes(r.payload)) == (b if i == lead else None)
        assert r.url == (url and url.replace("\r", "%0D").replace("\n", "%0A"))
    part = next((tmp_path / "w/archives").glob("*.gz"))
    assert gzip.decompress(part.read_bytes()).startswith(b"WARC/1.1\r\n")


def test_small_payloads_are_no_revisits(spark, tmp_path):
    df, _ = pages(spark)
    got = warc.round_trip(df, str(tmp_path / "w"), min_bytes=1000)
    assert got.where("record_type = 'revisit'").count() == 0
    assert warc.round_trip(df.limit(0), str(tmp_path / "e")).count() == 0


def test_false_magic_is_passed():
    rec = warc.record_bytes(1, "u", b"body", b"d" * 20, None, False, "2024")
    data = b"\x1f\x8b\x08junk" + warc.gzip_member(b"not a record") + warc.gzip_member(rec) + warc.gzip_member(rec)[:-9]
    w = warc._Window(io.BytesIO(data), len(data), 16)
    got = list(warc.records_in(w, 0, len(data), len(data)))
    assert len(got) == 1 and got[0][2].endswith(b"body")


@pytest.mark.parametrize("split", [100_000, 1 << 23])
def test_headers_of_any_length(spark, tmp_path, split):
    r = random.Random(0)
    urls = {1: "http://h/" + "".join(r.choice("abcdefghij0123456789") for _ in range(3 << 20)), 2: "http://h/" + "a" * (3 << 20), 3: "http://h/é"}
    df = spark.createDataFrame([(i, u, f"page {i}") for i, u in urls.items()], "page_id long, url string, html string")
    assert {x.page_id: x.url for x in warc.round_trip(df.coalesce(1), str(tmp_path / "w"), split_bytes=split).collect()} == urls


def test_lost_records_are_an_error(spark, tmp_path):
    df, rows = pages(spark)
    manifest = warc.write_warc(df.coalesce(1), str(tmp_path / "w"))
    path = next((tmp_path / "w/archives").glob("*.gz"))
    data = bytearray(path.read_bytes())
    data[10] ^= 255
    path.write_bytes(bytes(data))
    with pytest.raises(ValueError, match="add up"):
        warc.complete(warc.read_warc(manifest), manifest)
