"""What keeps a query's work in proportion to its input: one pass over the rows, tasks by counted rows, no sort of all."""

from pyspark.sql import functions as F

import __spark_entry__
from kinweave import validate
from kinweave.operators import catalog, early, graph_build
from kinweave.plans import catalog_queries, entity_queries, graph_queries

DATA = __spark_entry__.TESTDATA


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_read_rows_once(spark):
    """Before, each rank and level of intervals joined and grouped all recordings again."""
    assert "lineitem" not in plan(entity_queries.yearly_nearest_rank(spark, DATA))


def test_pairs_by_counted_rows(spark, monkeypatch):
    """Tasks follow from the counted pairs; before, a task's share of the pairs grew with the input."""
    m = spark.createDataFrame([(w, n, f"t{w}") for w in range(4) for n in range(6)], "work long, n long, t string")
    monkeypatch.setattr(graph_build, "TASK_ROWS", 10)
    for got in (graph_build.pair_examples(m, "work", "n", "t"), graph_build.size_adjusted_edges(m, "work", "n")):
        assert got.rdd.getNumPartitions() == 7 and got.count() == 15
    assert {r.examples for r in graph_build.pair_examples(m, "work", "n", "t").collect()} == {"t0; t1; t2; t3"}


def test_platform_works_unsorted(spark):
    """Before, all documents were sorted by a constant, in one task, and recordings and releases were nested for nothing."""
    p = plan(catalog_queries.platform_works(spark, DATA))
    assert "rangepartitioning" not in p and "album" not in p.replace("album_date", "")


def test_works_are_rows(spark):
    """Works one a row, equal to the nested ones; before, they were nested, sorted with their documents and taken apart again."""
    got, nested = catalog_queries.catalog_works(spark, DATA), catalog_queries._works(catalog_queries._documents(spark, DATA, "works"))
    assert "inline" not in plan(got) and "rangepartitioning" not in plan(got)
    assert got.columns == nested.columns and sorted(map(str, got.collect())) == sorted(map(str, nested.collect()))


def test_no_order_where_none_is_asked(spark):
    """Before, nested documents were sorted by pos and their order thrown away."""
    assert "rangepartitioning" not in plan(catalog_queries.early_song_features(spark, DATA))
    assert "rangepartitioning" not in plan(catalog_queries.accepted_documents(spark, DATA))


def test_repeats_by_numbers(spark, monkeypatch):
    """Who has a release by several works is found among sorted numbers, in rounds and blocks that follow from counts; before, all rows of artist, work and release were made and sorted."""
    owned = spark.createDataFrame([(a, w) for a in range(1, 7) for w in (10, 11, 12) if (a + w) % 3], "artist_id long, work_id long")
    on = spark.createDataFrame([(10, 1), (11, 1), (12, 1), (11, 2), (12, 3), (10, 4), (12, 4)], "work_id long, release_id long")
    have = sorted((a, r, w) for a, w in owned.collect() for x, r in on.collect() if x == w)
    want = [(a, w, r) for i, (a, r, w) in enumerate(have) if i and have[i - 1][:2] == (a, r)]
    assert want and sorted(map(tuple, catalog.repeats(owned, on).collect())) == sorted(want)
    monkeypatch.setattr(catalog, "TASK_ROWS", 2)
    monkeypatch.setattr(catalog, "ROUND_ROWS", 5)
    assert sorted(map(tuple, catalog.repeats(owned, on).collect())) == sorted(want)


def test_release_texts_before_the_join(spark):
    """Before, each row's mbid, date and labels were made into text after the join that makes the rows."""
    above = plan(catalog_queries.catalog_releases(spark, DATA)).split("Join")[0]
    assert "hex" not in above and "date_format" not in above and "concat_ws" not in above


def test_entities_count_releases_once_a_round(spark, monkeypatch):
    """Releases are counted by work, less those that several works bring; before, all (artist, release) were made and made distinct."""
    asked, real = [], catalog.repeats
    monkeypatch.setattr(catalog, "repeats", lambda *a: asked.append(a) or real(*a))
    catalog_queries.catalog_entities(spark, DATA)
    assert len(asked) == 1


def test_model_rows_by_counted_rows(spark, monkeypatch):
    """Features of artists go to tasks by counted releases, one group of features at a time; before, one plan sorted for all joins in tasks that grew with the input."""
    r = graph_queries.releases(spark, DATA)
    won = early.in_window(r, early.career_window(r))
    x = early.cadence(won, graph_queries.AS_OF).join(early.label_profile(won), "artist").join(early.temporal_controls(r, graph_queries.AS_OF), "artist")
    x = x.join(r.groupBy("artist").agg(F.log1p(F.sum("price") + 1).alias("target")), "artist")
    monkeypatch.setattr(validate, "DEALT_ROWS", r.count() // 9)
    asked, real = [], validate.settings
    monkeypatch.setattr(validate, "settings", lambda s, values: asked.append(values.get("spark.sql.shuffle.partitions")) or real(s, values))
    got = graph_queries._model_rows(spark, DATA)
    assert "10" in asked and "Join" not in plan(got)
    columns = ["artist", "primary_label", "target", "years_active", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in got.columns[4:]]]
    for a, b in zip(got.orderBy("artist").collect(), x.select(*columns).orderBy("artist").collect(), strict=True):
        assert a[:2] == b[:2] and max(abs(p - q) for p, q in zip(a[2:], b[2:], strict=True)) < 1e-9


def test_edges_of_owners_and_people(spark):
    """Pairs among a work's people are made once and counted for all its owners; before, for each owner, from a join read three times."""
    works = spark.createDataFrame([(1, ["a", "b", None]), (2, ["c"]), (3, None), (4, ["a", "b", "c"])], "work long, people array<string>")
    owned = spark.createDataFrame([("x", 1), ("y", 1), ("a", 1), ("x", 2), ("c", 2), ("x", 3), ("y", 4), ("x", 9)], "id string, work long")
    want = {("a", "b"): 4, ("a", "x"): 1, ("b", "x"): 1, ("a", "y"): 2, ("b", "y"): 2, ("c", "x"): 1, ("a", "c"): 1, ("b", "c"): 1, ("c", "y"): 1}
    got = graph_build.owned_work_edges(owned, works, F.col("id"))
    assert {(r.u, r.v): r.weight for r in got.collect()} == want
    assert plan(got).count("owner") > 0 and not any("transform" in x and "owner" in x for x in plan(got).splitlines())


def test_credits_counted_by_batches():
    """Many recordings' credits are sorted as numbers at once, a recording over several batches too; before, functions were called for each credit, in three arrays a recording."""
    import pyarrow as pa

    from kinweave.sources import platform

    rows = [("a", [3, 5, 4]), ("a", [5, 9]), ("b", []), ("c", [7, 6]), ("c", [8]), ("c", [7]), ("d", [2 << 60])]  # many = 3: 3, 6 and 9 are without a relation
    whole = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["recording_id", "__codes"])
    last = (2 << 60) % 3 != 0
    for size in (1, 2, 3, 7):
        got = [tuple(x.values()) for out in platform._counted([whole.slice(i, size) for i in range(0, len(rows), size)], 3) for x in out.to_pylist()]
        assert got == [("a", 2, 2, 2), ("b", 1, 0, 0), ("c", 3, 1, 2), ("d", 1, 1, int(last))]


def test_relations_keep_what_they_need(spark):
    """Before, both sides of platform_relations shuffled all four columns of the lines twice."""
    p = []
    from kinweave.sources import platform

    held, platform.credit_counts = platform.credit_counts, lambda a, b: p.extend([plan(a), plan(b)])
    try:
        catalog_queries.platform_relations(spark, DATA)
    finally:
        platform.credit_counts = held
    assert [x.count("Exchange hashpartitioning") for x in p] == [2, 2] and "l_suppkey" not in p[0]


def test_pairs_are_packed(spark, monkeypatch):
    """A walk's pairs are packed by their two blocks and read by the round that trains them; before, they were rows of two names, all read in each round."""
    from collections import Counter

    import numpy as np

    from kinweave.operators import graph_walks as G

    monkeypatch.setattr(G, "PACK", 3)
    mark = lambda k: ((k % 2) << 32) + k // 2
    walks = [[0, 1, 2, 1], [3, 3, 0, 2], [4, 1, 4, 1], [2, 3, 2, 0]]
    frame = spark.createDataFrame([(str(w[0]), [mark(k) for k in w]) for w in walks], "node string, walk array<long>").coalesce(1)
    want = Counter((r.node, r.context) for r in G.window_pairs(frame.withColumn("walk", F.col("walk").cast("array<string>")), 2).collect())
    got, size = Counter(), 3
    packed = frame.mapInArrow(lambda rows: G._packed(rows, 2, 2), "block int, other int, first long, data binary").collect()
    for r in packed:
        centre, context = np.frombuffer(r.data, np.int32).reshape(2, -1)
        got.update((str((r.block << 32) + int(a)), str((r.other << 32) + int(b))) for a, b in zip(centre, context, strict=True))
    assert got == want and len(packed) <= 4 * -(-len(walks) // size)
    counts = frame.mapInArrow(lambda rows: G._contexts(rows, 2), "mark long, n long").groupBy("mark").agg(F.sum("n").alias("n")).collect()
    assert {str(r.mark): r.n for r in counts} == Counter(b for _, b in want.elements())


def test_weighted_draws():
    """The table gives what a search of the summed weights gives, for even and for very uneven ones; adding keeps repeats."""
    import numpy as np

    from kinweave.operators import graph_walks as G

    r = np.random.default_rng(3)
    for w in (np.ones(7), r.random(1000) ** 9, np.array([1e-9, 5, 1e-9, 1e-9, 1e-9, 1e-9, 3])):
        u = r.random((500, 5))
        upto = np.cumsum(w)
        assert (G._Weighted(w).at(u) == np.minimum(np.searchsorted(upto, u * upto[-1], "right"), len(w) - 1)).all()
    table, at, rows = np.zeros((4, 3), np.float32), np.array([[1, 1], [3, 1]]), np.ones((2, 2, 3), np.float32)
    G._added(table, at, rows)
    assert table[:, 0].tolist() == [0, 3, 0, 1]


def test_ids_by_many_tasks(spark):
    """Ids are read and normalised after they are dealt out, once a row; before, by the one task that scans a small file of customers."""
    p = plan(catalog.cohort_of(catalog_queries.ids(spark, DATA))).split("\n")
    dealt = [i for i, x in enumerate(p) if "REPARTITION_BY_COL" in x]
    work = [i for i, x in enumerate(p) if "regexp_replace" in x or "RLIKE" in x]
    assert len(dealt) == 4 and work and max(work) < min(dealt) and str(p).count("regexp_replace") == 1
    odd = spark.createDataFrame([(" {0A0B0C0D-0102-0304-0506-0708090A0B0C}", 3), ("0a0b0c0d010203040506-0708090a0b0c", 2), ("urn:uuid:0a0b0c0d-0102-0304-0506-0708090a0b0d", 5), (None, 1), ("", 0), ("bad", 4)], "mbid string, pos long")
    assert sorted(map(tuple, catalog.cohort_of(odd).collect())) == [("0a0b0c0d-0102-0304-0506-0708090a0b0c", 2), ("0a0b0c0d-0102-0304-0506-0708090a0b0d", 5)]


def test_pairs_are_shuffled_once(spark):
    """Written and recorded works are put together before the cohort is joined; before, written works were shuffled for that and then again to be made distinct."""
    t = catalog_queries.tables(spark, DATA)
    inp = catalog.entities(t["artist"], catalog.cohort_of(catalog_queries.ids(spark, DATA))).select("artist_id", "mbid")
    with validate.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        p = plan(catalog.work_pairs({k: validate.cut(t[k]) for k in ("link", "link_type", "l_artist_work", "artist_credit", "artist_credit_name", "recording", "l_recording_work")}, validate.cut(inp)))
    assert "hashpartitioning(entity0" not in p and p.index("Union") > p.index("Exchange hashpartitioning(artist_id")
    few = inp.where("artist_id % 3 = 0")
    got = catalog.work_pairs(t, few.union(few))  # an artist named twice has each work once
    written = t["l_artist_work"].where("link <= 4").select("entity0", "entity1")
    recorded = t["recording"].join(t["l_recording_work"], F.col("id") == F.col("entity0")).select(F.col("artist_credit") - 1_000_000, "entity1")
    want = written.union(recorded).distinct().toDF("artist_id", "work_id").join(few, "artist_id").select("artist_id", "mbid", "work_id")
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_lines_by_one_sort(spark):
    """Of lines with equal numbers the first is told by a window; before, by an aggregation of structs, made twice over sorted rows."""
    got = catalog_queries._lines(spark, DATA)
    assert "Aggregate" not in plan(got)
    li = spark.read.parquet(f"{DATA}/lineitem.parquet")
    want = {}
    for r in sorted(map(tuple, li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate").collect())):
        want.setdefault(r[:2], r)
    assert len(want) < li.count()
    assert sorted(map(tuple, got.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate").collect())) == sorted((*r[:3], *r[4:]) for r in want.values())
