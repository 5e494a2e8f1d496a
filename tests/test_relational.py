import pytest
from pyspark.sql import functions as F

from kinweave.operators import catalog, ergm, matrix, model, relational


def test_nearest_rank(spark):
    for values, p25, p75 in (([10, 20, 30, 40, 50], 20, 40), ([10, 20], 10, 20)):
        r = spark.createDataFrame([(values,)], "v array<int>").select(relational.nearest_rank(F.col("v"), 0.25), relational.nearest_rank(F.col("v"), 0.75)).first()
        assert tuple(r) == (p25, p75)


def test_quantile_and_scaling(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (1000.0,)], "x double")
    assert [r.x for r in relational.below_quantile(df, "x", 0.995).orderBy("x").collect()] == [1.0, 2.0]
    z = relational.z_scores(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double"), ["a", "b"]).collect()
    assert [r.a_z for r in z] == [-1.0, 1.0, 0.0] and {r.b_z for r in z} == {0.0}


def test_assembly(spark):
    base = spark.createDataFrame([("1", "A", 5), ("2", "B", 5), ("3", "C", 5)], "artist_mbid string, artist_name string, window_years int")
    nodes = spark.createDataFrame([("1", 0.1, 1), ("1", 0.2, 2), ("9", 0.3, 3)], "node string, eigen_centrality double, o int")
    emb = spark.createDataFrame([("1", 1.0)], "artist_mbid string, n2v_0 double")
    met = spark.createDataFrame([("s", 1, 1, "1", 1), ("t", 2, 1, "1", 2)], "artist_id string, followers long, popularity long, artist_mbid string, o int")
    out = matrix.build_final(base, nodes, emb, met, "o")
    assert out.columns[:3] == ["artist_mbid", "artist_name", "artist_id"] and "window_years" not in out.columns and "popularity" not in out.columns
    rows = {r.artist_mbid: r for r in out.collect()}
    assert len(rows) == 3 and (rows["1"].eigencent, rows["1"].artist_id, rows["1"].followers) == (0.1, "t", 2) and rows["2"].eigencent is None
    with pytest.raises(ValueError, match="artist_id"):
        matrix.build_final(base, nodes, emb, met.drop("artist_id"))


def test_clean_and_bins(spark):
    df = spark.createDataFrame([(0, None, ""), (3, 2.0, "FR")], "tracks_total long, label_hhi double, artist_country string")
    a, b = matrix.clean_features(df).collect()
    assert (a.missing_recordings, a.label_hhi, a.artist_country, a.location_country_known) == (True, 0.0, "unknown", False) and b.location_country_known
    bins = relational.quantile_bins(spark.range(100).withColumn("x", F.col("id").cast("double")), "x")
    assert bins.groupBy("bin").count().count() == 10


def test_resume_and_templates(spark):
    todo = spark.createDataFrame([("1", "Ann"), ("2", " Bob "), ("3", "Cy")], "id string, name string")
    done = spark.createDataFrame([("1", None), (None, "BOB")], "id string, name string")
    assert [r.id for r in relational.not_done(todo, done, "id", "name").collect()] == ["3"]
    f = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int")
    e = spark.createDataFrame([("a", "z"), ("b", "z"), ("q", "z")], "u string, v string")
    miss = spark.createDataFrame([("z",), ("q",)], "node string")
    assert [tuple(r) for r in relational.template_rows(miss, e, f, "k").collect()] == [("z", 1, "a")]


def test_catalog(spark):
    ids = [f"00000000-0000-0000-0000-00000000000{i}" for i in range(4)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    t = {
        "artist": df([(1, ids[1], "Ann", 7, None), (2, ids[2], "Bob", None, None)], "id int, gid string, name string, area int, begin_area int"),
        "area": df([(7, "France")], "id int, name string"),
        "link_type": df([(1, "composer"), (2, "vocal")], "id int, name string"),
        "link": df([(10, 1, 2000, None), (11, 2, None, None), (12, 99, None, None)], "id int, link_type int, begin_date_year int, end_date_year int"),
        "l_artist_work": df([(1, 100, 10)], "entity0 int, entity1 int, link int"),
        "l_artist_recording": df([(1, 200, 11), (1, 200, 12)], "entity0 int, entity1 int, link int"),
        "l_recording_work": df([(200, 100)], "entity0 int, entity1 int"),
        "work": df([(100, "W")], "id int, name string"),
        "recording": df([(200, "Rec", 5, 300)], "id int, name string, length int, artist_credit int"),
        "artist_credit": df([(300,)], "id int"),
        "artist_credit_name": df([(2, 300)], "artist int, artist_credit int"),
        "track": df([(200, 400), (200, 401)], "recording int, medium int"),
        "medium": df([(400, 500), (401, 501)], "id int, release int"),
        "release": df([(500, "R", 600), (501, "S", 600)], "id int, name string, release_group int"),
        "release_event": df([(500, 2000, None, None), (500, 2000, 5, 1), (500, None, 1, 1)], "release int, date_year int, date_month int, date_day int"),
        "release_label": df([(500, 700), (500, 701)], "release int, label int"),
        "label": df([(700, "g0", "Lab"), (701, "g1", "Bel")], "id int, gid string, name string"),
        "work_tag": df([(100, 1)], "work int, tag int"),
        "tag": df([(1, "pop")], "id int, name string"),
        "l_artist_url": df([(1, 800, 10), (1, 801, 10)], "entity0 int, entity1 int, link int"),
        "url": df([(800, "http://open.Spotify.com/a"), (801, "http://other")], "id int, url string"),
    }
    cohort = df([(ids[2].upper(), 0), (ids[3], 1), ("{" + ids[1] + "}", 2), (ids[2], 3), ("bad", 4)], "mbid string, pos long")
    docs = catalog.documents(t, cohort).collect()
    assert [d.mbid for d in docs] == [ids[2], ids[3], ids[1]]
    bob, none, ann = docs
    assert none.works == [] and none.artist_name is None
    assert ann.roles == "composer, performer, vocal" and ann.country == "France" and ann.works[0].genres == ["pop"]
    assert [(r.id, r.date, r.label_names) for r in bob.releases] == [(500, "2000-05-01", ["Bel", "Lab"]), (501, None, [])]
    res = catalog.resources(t, cohort)
    assert res.count() == 1 and catalog.resources(t, cohort, True).count() == 2
    assert catalog.url_map(res).first().url == "http://open.Spotify.com/a"


def test_wiki_helpers(spark):
    pairs = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("z", "y")], "child string, parent string")
    assert sorted(r.node for r in catalog.subclasses(pairs, ["a"]).collect()) == ["a", "b", "c"]
    facts = spark.createDataFrame([("q", "N", "child", 3, "singer", None), ("q", "N", "spouse", 5, "actor", "m")], "qid string, name string, relation string, priority int, occupation string, mbid string")
    r = catalog.relatives(facts).first()
    assert (r.relation, r.occupations, r.has_mbid) == ("spouse", ["actor", "singer"], True)
    base = spark.createDataFrame([("1", "x", None)], "k string, a string, b string")
    rich = spark.createDataFrame([("1", None, "y", "z")], "k string, a string, b string, c string")
    assert catalog.with_fallback(base, rich, "k").first().asDict() == {"k": "1", "a": "x", "b": "y", "c": "z"}
    c = spark.createDataFrame([("time", '{"time": "+1990-01-02T00:00:00Z"}'), ("quantity", '{"amount": "+5"}')], "t string, v string")
    assert [r[0] for r in c.select(catalog.claim_value("t", F.col("v"))).collect()] == ["1990-01-02", "5"]
    tr = spark.createDataFrame([("o", " Song", "2001", ["1", "2"], ["Zed", "amy"]), ("o", "song", "2000", ["2", "1"], ["amy", "Zed"])], "owner string, title string, album_date string, artist_ids array<string>, artist_names array<string>")
    w = catalog.grouped_tracks(tr).collect()
    assert len(w) == 1 and w[0].first_release_date == "2000" and [x.name for x in w[0].collaborators] == ["amy", "Zed"]


def test_models(spark):
    assert model.parse_params({"model__max_depth": "8", "name": "cat"}) == {"max_depth": 8, "name": "cat"}
    df = spark.range(60).select("id", (F.col("id") * 2.0 + 1).alias("y"), F.col("id").cast("double").alias("x"), (F.col("id") % 8).alias("years"))
    p = model.pipeline(["x"], "y", kind="linear")
    assert model.cross_validate(df, "id", p, "y", 3).where("r2 < 0.999").count() == 0
    assert model.rank_segment(df, "years", p, 5, ["id"]).count() == df.where("years < 5").count()
    m = p.fit(df)
    assert model.permutation_importance(m, df, ["x"], "y")["x"] > 0
    assert model.grid_search(df, "id", ["x"], "y", [{"regParam": 10.0}, {"regParam": 0.0}], "linear")[0][0] == {"regParam": 0.0}
    folds = spark.createDataFrame([(0, 1.0, 2.0, 0.5), (1, 3.0, 2.0, 0.7)], "fold int, rmse double, mae double, r2 double")
    assert {r.metric: (r["mean"], r.sd) for r in model.fold_summary(folds).collect()} == {"rmse": (2.0, 1.0), "mae": (2.0, 0.0), "r2": (pytest.approx(0.6), pytest.approx(0.1))}
    train = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    assert [r.c_code for r in model.codes(spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string"), ["c"], train).collect()] == [0.0, 1.0, None, None]
    assert [r.feature for r in model.top_importances({"a": 1.0, "b": 3.0, "c": 2.0}, spark, 2).collect()] == ["b", "c"]
    assert model.scaled_linear(["x"], "y").fit(df).transform(df).where("abs(prediction - y) > 0.01").count() == 0


def test_saved_models(spark, tmp_path):
    df = spark.range(30).select((F.col("id") * 3.0).alias("y"), F.col("id").cast("double").alias("x"))
    m = model.pipeline(["x"], "y", kind="linear").fit(df)
    model.save(m, str(tmp_path / "m"), spark.createDataFrame([("rmse", 0.5)], "metric string, value double"))
    assert model.load(str(tmp_path / "m")).transform(df).where("abs(prediction - y) > 0.001").count() == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "m/summary")).first().metric == "rmse" and spark.read.text(str(tmp_path / "m/status")).first().value == "ok"


def test_numbers_and_unions(spark):
    for rows in (7, 100_000):
        got = relational.numbered(spark.range(50), "id", "i", rows).collect()
        assert sorted(r.i for r in got) == list(range(50))
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z", 5.0)], "k int, v string, w double")
    assert sorted(map(tuple, relational.union_latest(a, b, ["k"]).collect())) == [(1, "x", None), (2, "z", 5.0)]


def test_ergm_density(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "u string, v string")
    got = ergm.density_model(e).first()
    assert got.theta == pytest.approx(0.0)
    dy = ergm.sampled_dyads(e, 10.0)
    assert dy.where("edge = 1").count() == 3 and dy.groupBy("u", "v").count().where("count > 1").count() == 0
    assert dy.agg(F.sum("weight")).first()[0] == pytest.approx(6.0)
    x = ergm.change_statistics(dy, e)
    row = x.where("u = 'a' and v = 'b'").first()
    assert (row.shared, row.gwesp) == (0, 0.0)


@pytest.mark.parametrize("small", [True, False])
def test_change_statistics_are_differences_of_statistics(spark, monkeypatch, small):
    """Each pair's statistics with the pair linked less those without it, computed anew, by held graph and by joins."""
    import math
    import random
    from itertools import combinations

    import helpers as H
    from kinweave.operators import graph_traverse

    if not small:
        monkeypatch.setattr(graph_traverse, "HELD_EDGES", 0)
    r = random.Random(4)
    nodes = range(9)
    edges = sorted({tuple(sorted(r.sample(nodes, 2))) for _ in range(16)})

    def terms(links):
        a = {x: set() for x in nodes} | H.adjacency(links)
        partners = {(u, v): len(a[u] & a[v]) for u, v in combinations(nodes, 2)}
        weighted = lambda n, d: math.exp(d) * (1 - (1 - math.exp(-d)) ** n)
        return sum(weighted(partners[e], 0.5) for e in links), sum(weighted(len(a[x]), 0.8) for x in nodes), sum(weighted(n, 0.5) for n in partners.values())

    used = sorted({x for e in edges for x in e})
    pairs = list(combinations(used, 2))
    dy = spark.createDataFrame([(u, v, int((u, v) in edges), 1.0) for u, v in pairs], "u long, v long, edge int, weight double")
    got = {(x.u, x.v): x for x in ergm.change_statistics(dy, spark.createDataFrame(edges, "u long, v long")).collect()}
    for p in pairs:
        rest = [e for e in edges if e != p]
        want = [x - y for x, y in zip(terms([*rest, p]), terms(rest), strict=True)]
        assert (got[p].gwesp, got[p].gwdegree, got[p].gwdsp) == pytest.approx(want), p
