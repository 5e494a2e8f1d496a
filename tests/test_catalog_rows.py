"""Queries of the catalog's rows against the nested documents, whose arrays they don't build."""

from pyspark.sql import functions as F

import __spark_entry__
from kinweave.operators import catalog, early, graph_build
from kinweave.plans import catalog_queries as Q
from kinweave.plans import pipeline
from kinweave.validate import cut

DATA = __spark_entry__.TESTDATA


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(str, df.collect()))


def test_recordings_are_no_arrays(spark):
    """A work's recordings meet its artists in the last join; before, they were shuffled for each artist and nested."""
    got = Q.catalog_recordings(spark, DATA)
    nested = Q._documents(spark, DATA, "recordings").select("mbid", F.inline("recordings")).withColumnRenamed("id", "rec_id")
    assert "Aggregate" not in plan(got) and "Generate" not in plan(got)
    assert got.columns == nested.columns and rows(got) == rows(nested)


def test_entities_are_counted(spark):
    """Counts without documents; before, all recordings and releases of each artist were nested to be counted."""
    got = Q.catalog_entities(spark, DATA)
    nested = catalog.nested_counts(Q._documents(spark, DATA), ["artist_name", "country", "region_city", "roles", "pos"])
    assert "collect_list" not in plan(got)
    assert got.columns == nested.columns and rows(got) == rows(nested)


def test_shared_releases_count_once(spark):
    """An artist with two works on one release has it once; in rounds that hold some, or no, artists."""
    owned = spark.createDataFrame([(a, bytes([a] * 16), w) for a in (1, 2, 3) for w in (10, 11, 12) if a + w != 15], "artist_id long, id16 binary, work_id long")
    listed = cut(spark.createDataFrame([(10, 1, "x", 5, 7), (11, 2, "y", None, 7), (12, 3, "z", 6, 7), (12, 3, "z", 6, 8), (10, 4, "v", 1, 7)], "work_id long, rec_id long, rec_name string, length_ms long, release_id long"))
    mbid = {a: "-".join([f"{a:02x}" * 4, *[f"{a:02x}" * 2] * 3, f"{a:02x}" * 6]) for a in (1, 2, 3, 4)}
    cohort = spark.createDataFrame([(m, a) for a, m in mbid.items()], "mbid string, pos long")
    described = spark.createDataFrame([(a, mbid[a], f"n{a}", 0) for a in (1, 2, 3)], "artist_id long, mbid string, artist_name string, pos long")
    work = spark.createDataFrame([(w, "") for w in (10, 11, 12)], "id long, name string")
    got = catalog.entity_counts(cohort, described, owned, listed, work, 5).collect()
    assert [tuple(r)[1:] for r in got] == [("n1", 1, 3, 5, 2, 18.0), ("n2", 2, 3, 5, 2, 18.0), ("n3", 3, 2, 3, 1, 6.0), (None, 4, 0, 0, 0, 0.0)]


def test_releases_are_no_arrays(spark):
    """Releases one a row, equal to the nested ones; before, all were nested for each artist."""
    got = Q.catalog_releases(spark, DATA)
    nested = Q._documents(spark, DATA, "releases").select("mbid", F.inline("releases")).withColumnRenamed("id", "release_id")
    nested = nested.withColumns({c: F.concat_ws("|", c) for c in ("label_ids", "label_names")})
    assert "inline" not in plan(got)
    assert got.columns == nested.columns and rows(got) == rows(nested)


def test_edges_without_documents(spark, monkeypatch):
    """Edges of the catalog equal those of nested documents, with long lists of people dealt to blocks too."""
    want = rows(graph_build.cowork_edges(Q._documents(spark, DATA)))
    got = Q.cowork_edges(spark, DATA)
    assert "releases" not in plan(got) and "recordings" not in plan(got)
    assert rows(got) == want
    monkeypatch.setattr(graph_build, "PEOPLE", 2)
    assert rows(Q.cowork_edges(spark, DATA)) == want


def test_documents_written_in_rounds(spark, monkeypatch):
    """Documents of many rounds, and of one, equal those of one plan; the rounds follow from counted rows."""
    t, ids = Q.tables(spark, DATA), Q.ids(spark, DATA)
    want = Q._documents(spark, DATA)
    owned, listed = catalog.owned(t, ids), catalog.listed(t)
    n = owned.join(listed, "work_id").count()
    assert catalog.rounds_for(owned, listed, n // 3) in (3, 4) and catalog.rounds_for(owned, listed) == 1
    got = catalog.written_documents(t, ids, rows=n // 2 + 1)
    assert got.columns == want.columns and rows(got) == rows(want)
    some = catalog.written_documents(t, ids, ("works",))
    assert rows(some) == rows(Q._documents(spark, DATA, "works"))


def test_edges_of_a_run_come_from_the_catalog(spark):
    t, ids = Q.tables(spark, DATA), Q.ids(spark, DATA)
    docs = Q._documents(spark, DATA)
    features = docs.where("pos % 2 = 0").select(F.col("mbid").alias("artist_mbid"))
    kept = docs.join(features.select(F.col("artist_mbid").alias("mbid")), "mbid", "left_semi")
    assert rows(pipeline.catalog_edges(t, features)) == rows(graph_build.cowork_edges(kept))


def test_nested_by_work(spark):
    """What a work adds is put together once, and documents that are only digested are not written; before, each artist's rows were gathered one by one, and written."""
    t, ids = Q.tables(spark, DATA), Q.ids(spark, DATA)
    works = catalog.by_work(t, catalog.listings(t), catalog.release_facts(t), catalog.ARRAYS)
    assert works.count() == works.select("work_id").distinct().count()
    sizes = [F.size(c).cast("long").alias(f"n_{c}") for c in catalog.ARRAYS]
    got = catalog.written_documents(t, ids, rows=1 << 17, kept=lambda docs: docs.select("mbid", *sizes))
    assert got.columns == ["mbid", "n_works", "n_recordings", "n_releases"]
    assert rows(got) == rows(Q.catalog_entities(spark, DATA).select(*got.columns))


def test_features_in_rounds(spark):
    """Features of a round's documents, which go with the round, equal those of all documents at once; before, all were written first."""
    t, ids = Q.tables(spark, DATA), Q.ids(spark, DATA)
    kept = lambda docs: early.temporal_controls(docs.select(F.col("mbid").alias("artist"), F.explode("works").alias("w")).select("artist", F.col("w.first_release_date").cast("date").alias("date")), "2002-01-01")
    got = catalog.written_documents(t, ids, ("works",), rows=1 << 12, kept=kept, again=True)
    assert got.count() > 0 and rows(got) == rows(kept(Q._documents(spark, DATA, "works")))
