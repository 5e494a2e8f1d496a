import json

import pytest
from pyspark.sql import functions as F

from kinweave.operators import catalog, matrix
from kinweave.sources import http, platform, readers, sinks
from kinweave.streaming.resume import stream_new


def test_readers(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1, "b": "x"}\n\n{bad\n{"a": 2, "b": "y"}\n')
    t = readers.json_lines(spark, str(p), "a long, b string").cache()
    assert t.where("_corrupt is not null").count() == 1 and t.where("_corrupt is null").count() == 2
    assert readers.json_lines(spark, str(p), "a long, b string", "skip").where("a is not null").count() == 2
    assert readers.raw_and_parsed(spark, str(p), "a long, b string").count() == 3
    m = tmp_path / "m.json"
    m.write_text(json.dumps({"k1": {"spotify": "u1"}, "k2": {"spotify": "u2"}}))
    assert {tuple(r) for r in readers.json_map(spark, str(m)).collect()} == {("k1", "spotify", "u1"), ("k2", "spotify", "u2")}
    c = tmp_path / "c.csv"
    c.write_text("id,n\n a ,5\na,x\n,1\nb, 7\n")
    assert sorted(tuple(r) for r in readers.csv_text(spark, str(c), "id", ("n",)).collect()) == [("a", None), ("b", 7)]
    assert dict(tuple(r) for r in readers.csv_map(spark, str(c), "id", "n").where("id = 'b'").collect()) == {"b": " 7"}
    i = tmp_path / "ids.txt"
    i.write_text("x\n\n y \n")
    assert [r.mbid for r in readers.id_list(spark, str(i)).orderBy("pos").collect()] == ["x", "y"]
    df = spark.createDataFrame([('[{"a":1},{"a":2}]',), ('{"a":3}',)], "s string")
    assert [[x.a for x in r[0]] for r in df.select(readers.array_or_object("s", "a long")).collect()] == [[1, 2], [3]]


def test_sinks(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "repeat('x', 50) as t")
    sinks.json_shards(df.coalesce(1), str(tmp_path / "s"), 2000)
    assert len(list((tmp_path / "s").glob("part-*"))) > 2 and spark.read.json(str(tmp_path / "s")).count() == 100
    for _ in range(2):
        sinks.append_new(spark.range(5).selectExpr("cast(id as string) k"), str(tmp_path / "a"), "k")
    assert spark.read.json(str(tmp_path / "a")).count() == 5
    m = spark.createDataFrame([("b", "spotify", "u2"), ("a", "spotify", 'q"1')], "k string, n string, v string")
    sinks.json_map(m, "k", "n", "v", str(tmp_path / "m"))
    text = next((tmp_path / "m").glob("part-*.txt")).read_text()
    assert json.loads(text) == {"a": {"spotify": 'q"1'}, "b": {"spotify": "u2"}} and text.index('"a"') < text.index('"b"')
    sinks.id_list(m, "k", str(tmp_path / "i"))
    sinks.csv(m, str(tmp_path / "c"), ["k"])
    assert readers.csv(spark, str(tmp_path / "c"), "k string").count() == 2


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i, keys in enumerate((["a", "b"], ["b", "c"])):
        (src / f"{i}.json").write_text("".join(json.dumps({"k": k}) + "\n" for k in keys))
        stream_new(spark, str(src), "k string", "k", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.k for r in spark.read.schema("k string").json(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_http_logic():
    import io
    import urllib.error

    calls, waits = [], []

    class Reply(io.BytesIO):
        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

    def opener(request, timeout):
        calls.append(request.full_url)
        if len(calls) == 1:
            raise urllib.error.HTTPError(request.full_url, 429, "slow", {"Retry-After": "3"}, None)
        if len(calls) == 2:
            raise urllib.error.URLError("down")
        return Reply(b'{"items": [1, null, 2]}')

    assert http.get_json("http://x", opener=opener, sleep=waits.append) == {"items": [1, None, 2]} and waits == [3.0, 1.0]
    store = {"p1": {"items": [{"a": 1}, None], "next": "p2"}, "p2": {"items": [{"a": 2}], "next": None}}
    assert [x["a"] for x in http.pages("p1", "items", "next", store.get)] == [1, 2]
    t = http.Token(lambda: ("v", 100.0), clock=lambda: 0.0)
    assert t.get() == "v"
    assert [p.value for p in http._Reader({"ids": ",".join("abc"), "batch": "2", "url": "u{ids}"}).partitions()] == ["a,b", "c"]


def test_feature_sets():
    assert len(matrix.feature_sets(["releases_total", "degree", "n2v_0"])) == 7


@pytest.fixture(scope="module")
def server():
    """A small service: tokens that are refused once, counted and linked pages, searches."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, urlparse

    issued = []

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def reply(self, code, body):
            data = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_POST(self):
            issued.append(1)
            self.reply(200, {"access_token": "old" if len(issued) == 1 else "good", "expires_in": 3600})

        def do_GET(self):
            url = urlparse(self.path)
            q = {k: v[0] for k, v in parse_qs(url.query).items()}
            if url.path == "/artists":
                if self.headers.get("Authorization") != "Bearer good":
                    return self.reply(401, {})
                return self.reply(200, {"artists": [None if i == "x" else {"id": i, "followers": {"total": 7} if i != "b" else None, "popularity": 3} for i in q["ids"].split(",")]})
            if url.path == "/tracks":
                n, at = int(q["limit"]), int(q["offset"])
                return self.reply(200, {"items": [{"id": f"t{i}", "name": "n"} for i in range(at, min(at + n, 7))]})
            if url.path == "/chart":
                return self.reply(200, {"artists": {"artist": [{"name": f"p{q['page']}-{i}", "mbid": "", "listeners": "5"} for i in range(4)]}})
            if url.path == "/linked":
                page = int(q.get("page", "1"))
                return self.reply(200, {"items": [{"id": f"{q['a']}-{page}"}, {"id": "same"}], "next": f"http://{self.headers['Host']}/linked?a={q['a']}&page={page + 1}" if page < 3 else None})
            if url.path == "/search":
                return self.reply(200, {"artists": {"items": [{"id": q["q"] + str(i), "score": 50 + i} for i in range(3)]}})
            return self.reply(200, {"id": "w", "error": 6, "message": "none"})

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_platform_over_http(spark, server):
    ids = spark.createDataFrame([("a",), ("b",), ("x",), ("a",), (None,)], "k string").coalesce(1)
    plan = http.Plan(f"{server}/artists?ids={{ids}}", "artists", token_url=f"{server}/token", client="c", secret="s")
    got = platform.metrics(http.fetch(ids, "k", plan, 2))
    assert sorted(map(tuple, got.collect())) == [("a", 7, 3), ("b", 0, 3)]
    one = spark.createDataFrame([("q",)], "k string")
    t = platform.tracks(http.fetch(one, "k", http.Plan(f"{server}/tracks?a={{ids}}&offset={{offset}}&limit={{limit}}", limit=3)))
    assert [(r.position, r.track_id) for r in t.orderBy("position").collect()] == [(i + 1, f"t{i}") for i in range(7)]
    c = platform.chart(http.fetch(one, "k", http.Plan(f"{server}/chart?page={{page}}&limit={{limit}}", "artists.artist", limit=4, most=6)), 6)
    assert [(r["rank"], r.name, r.mbid) for r in c.orderBy("rank").collect()] == [(i + 1, f"p{i // 4 + 1}-{i % 4}", None) for i in range(6)]
    al = platform.albums(http.fetch(one, "k", http.Plan(f"{server}/linked?a={{ids}}", next="next")))
    assert sorted(r.id for r in al.collect()) == ["q-1", "q-2", "q-3", "same"]
    hits = http.fetch(one, "k", http.Plan(f"{server}/search?q={{ids}}", "artists.items"), 1)
    assert platform.first_hit(hits).first().id == "q0" and platform.best_hit(hits, 51).first().id == "q2"
    stats = http.fetch(one, "k", http.Plan(f"{server}/stats?mbid={{ids}}", ""), 1)
    assert tuple(platform.listener_stats(stats).first()) == ("q", None, None)
    spark.dataSource.register(http.HttpSource)
    read = spark.read.format("paged_http").option("url", f"{server}/artists?ids={{ids}}").option("ids", "a,b").option("item", "artists").option("token_url", f"{server}/token").load()
    assert platform.metrics(read).count() == 2


def test_lookups_are_validated(spark):
    facts = spark.createDataFrame([("Q1", "P434", "0" * 8 + "-0000-0000-0000-" + "0" * 12)], "item string, property string, value string")
    assert catalog.lookup_by_id(facts, facts.first().value).first().item == "Q1"
    assert catalog.lookup_by_id(facts, "' or 1=1").count() == 0


def test_hits_at_one_place(spark):
    """Of hits at one place (and of one score) the shortest, then the smallest id is taken, in whatever order rows come."""
    rows = [("q", 5, f"o{i}", 30) for i in (100_008, 7, 200_011, 5)] + [("q", 9, "o1", 20), ("r", 2, "b", 40), ("r", 2, "a", 40), ("s", 1, None, 50), ("s", 1, "z", 50)]
    for order in (rows, rows[::-1]):
        hits = spark.createDataFrame([(q, n, json.dumps({"id": i, "score": score})) for q, n, i, score in order], "request string, ordinal long, body string").coalesce(1)
        for got in (platform.first_hit(hits), platform.best_hit(hits)):
            assert {r.request: r.id for r in got.collect()} == {"q": "o5", "r": "a", "s": "z"}


def test_credits_are_counted_in_rounds(spark):
    """Works, authors and credits of each recording, nulls and repeats as in a count of distinct values; no join holds a recording's credits one a row."""
    recorded = spark.createDataFrame([(f"r{i % 7}", f"w{i % 5}") for i in range(40)] + [("r0", None), ("lone", "nobody")], "recording_id string, work_id string")
    credited = spark.createDataFrame([(f"w{i % 5}", f"m{i % 3}" if i % 4 else None, "ab"[i % 2] if i % 3 else None) for i in range(30)], "work_id string, mbid string, relation string")
    plain = recorded.join(credited, "work_id").groupBy("recording_id").agg(F.countDistinct("work_id"), F.countDistinct("mbid"), F.countDistinct("mbid", "relation"))
    got = platform.credit_counts(recorded, credited, 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and got.columns == ["recording_id", "works", "authors", "credits"]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_shards_never_exceed_their_cap(spark, tmp_path):
    """A few long rows among many short ones, and one longer than the cap: by bytes written."""
    import os

    rows = [(i, "x" * (1500 if i % 1000 == 7 else 5 + i % 11)) for i in range(3000)] + [(9999, "y" * 9000)]
    df = spark.createDataFrame(rows, "i long, t string").coalesce(2)
    path = str(tmp_path / "capped")
    sinks.json_shards(df, path, 4000)
    files = [os.path.join(path, f) for f in os.listdir(path) if f.startswith("part-")]
    sizes = sorted(map(os.path.getsize, files))
    assert sizes[-1] > 9000 and all(n <= 4000 for n in sizes[:-1])
    assert sum(sizes) / 4000 * 3 > len(sizes)  # and are mostly well filled
    assert sorted(map(tuple, spark.read.schema("i long, t string").json(path).collect())) == sorted(rows)
    sinks.json_shards(df.limit(0), str(tmp_path / "none"), 4000)
    assert spark.read.schema("i long, t string").json(str(tmp_path / "none")).count() == 0


def test_harvest_goes_on_where_it_ended(spark, tmp_path):
    """A service that breaks down in the middle: what was finished is not asked for again, nothing is missed, no answer comes twice."""
    import threading
    from collections import Counter
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, urlparse

    from kinweave.streaming import resume

    asked, broken = [], [True]

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def do_GET(self):
            some = parse_qs(urlparse(self.path).query)["ids"][0].split(",")
            bad = broken[0] and len(asked) >= 40
            if not bad:
                asked.extend(some)
            data = json.dumps({"items": [{"id": i} for i in some]}).encode()
            self.send_response(500 if bad else 200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    ids, out, ck = (str(tmp_path / x) for x in ("ids", "out", "ck"))
    known = spark.range(100).selectExpr("concat('i', id) AS k")
    assert resume.id_files(known.union(known.limit(5)).union(spark.sql("SELECT CAST(NULL AS STRING)")), "k", ids, 10) == 100
    plan = http.Plan(f"http://127.0.0.1:{s.server_port}/?ids={{ids}}", tries=1)
    run = lambda: resume.harvest(spark, ids, plan, out, ck, files=1, batch=5, per_second=200.0).awaitTermination()
    with pytest.raises(Exception, match="500"):
        run()
    finished = {x.id for x in spark.read.schema("body string").json(out).selectExpr("get_json_object(body, '$.id') AS id").collect()}
    assert finished
    broken[0] = False
    run()
    got = Counter(x.id for x in spark.read.schema("body string").json(out).selectExpr("get_json_object(body, '$.id') AS id").collect())
    assert got == Counter(f"i{i}" for i in range(100))
    times = Counter(asked)
    assert all(times[i] == 1 for i in finished) and max(times.values()) <= 2
    before = len(asked)
    run()
    assert len(asked) == before
    resume.id_files(spark.sql("SELECT 'late' AS k"), "k", ids)
    run()
    assert asked[before:] == ["late"]
    s.shutdown()


def test_stream_forgets_old_keys(spark, tmp_path):
    from kinweave.streaming.resume import stream_new as new

    src = tmp_path / "in"
    src.mkdir()
    go = lambda: new(spark, str(src), "k string, t timestamp", "k", str(tmp_path / "out"), str(tmp_path / "ck"), "t", "1 hour").awaitTermination()
    for i, rows in enumerate(([("a", "2020-01-01T00:00:00")] * 2, [("a", "2020-01-01T00:30:00"), ("b", "2020-01-03T00:00:00")], [("c", "2020-01-03T01:00:00"), ("b", "2020-01-03T00:10:00")])):
        (src / f"{i}.json").write_text("".join(json.dumps({"k": k, "t": t}) + "\n" for k, t in rows))
        go()
    assert sorted(r.k for r in spark.read.schema("k string").json(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_last_value_over_files(spark, tmp_path):
    for name, rows in (("b.csv", "k,v\na,3\n"), ("a.csv", "k,v\na,1\na,2\nb,9\n" + "".join(f"x{i},{i}\n" for i in range(500)))):
        (tmp_path / name).write_text(rows)
    got = {r.k: r.v for r in readers.csv_map(spark, str(tmp_path), "k", "v").collect()}
    assert got["a"] == "3" and got["b"] == "9" and len(got) == 502
