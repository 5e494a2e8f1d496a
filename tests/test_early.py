import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from kinweave.operators import early
from kinweave.plans import pipeline
from kinweave.schemas import ARTIST_DOC, EARLY_COLUMNS

D = dt.date


def rel(spark, dates, labels=None):
    rows = [("a", i, d, (labels or ["L"] * len(dates))[i]) for i, d in enumerate(dates)]
    return spark.createDataFrame(rows, "artist string, id long, date date, label string")


def cadence(spark, dates, years=5):
    r = rel(spark, dates)
    return early.cadence(early.in_window(r, early.career_window(r, years=years)), "2030-01-01").first()


def test_window(spark):
    w = early.career_window(rel(spark, [D(2004, 2, 29)])).first()
    assert (w.debut_date, w.window_cutoff_date) == (D(2004, 2, 29), D(2009, 2, 28))
    assert cadence(spark, [D(2000, 1, 1), D(2005, 1, 1)]).releases_total == 1
    works = spark.createDataFrame([("a", D(1990, 1, 1))], "artist string, date date")
    assert early.career_window(rel(spark, [D(2000, 1, 1)]), works).first().debut_date == D(2000, 1, 1)
    assert early.career_window(rel(spark, [None]), works).first().debut_date == D(1990, 1, 1)


def test_cadence(spark):
    one = cadence(spark, [D(2000, 1, 1)])
    assert one.avg_days_between_releases is None and one.gap_std_days is None and one.release_velocity_releases_per_day is None and one.front_loading_index == 1.0
    same = cadence(spark, [D(2000, 1, 1)] * 2)
    assert same.release_velocity_releases_per_day is None and same.avg_days_between_releases == 0.0 and same.gap_std_days == 0.0
    assert cadence(spark, [D(2000, 1, 1), D(2000, 1, 11), D(2000, 1, 16)]).release_velocity_releases_per_day == pytest.approx(0.12857142857142856)


def test_labels(spark):
    r = rel(spark, [D(2000, 1, 1), D(2000, 2, 1)], ["B", "A"])
    p = early.label_profile(early.in_window(r, early.career_window(r))).first()
    assert (p.primary_label, p.label_hhi, p.label_churn, p.label_diversity_count, p.all_labels_str) == ("A", 0.5, 1, 2, "b, a")


def test_genres_titles_roles(spark):
    g = early.genre_profile(spark.createDataFrame([("a", "x"), ("a", "y"), ("a", None)], "artist string, genre string")).first()
    assert g.genre_entropy == pytest.approx(math.log(2)) and g.primary_genre == "x" and g.genre_count == 2
    t = early.duration_title_profile(spark.createDataFrame([("a", "Song (Remix)", 5), ("a", None, 7)], "artist string, name string, length_ms long")).first()
    assert t.remix_rate == 0.5 and t.duration_ms_median == 6.0
    r = early.role_profile(spark.createDataFrame([("a", " Writer, writer,producer"), ("b", None)], "artist string, roles string")).orderBy("artist").collect()
    assert (r[0].primary_role, r[0].all_roles_str, r[1].primary_role) == ("writer", "writer, producer", "unknown")


def test_filters(spark):
    def sane(dates):
        return spark.createDataFrame([(dates,)], "d array<date>").select(early.gap_sane(F.col("d"))).first()[0]

    assert not sane([D(1950, 1, 1), D(1970, 1, 2), D(1971, 1, 1)])
    assert sane([D(1950, 1, 1), D(1999, 1, 1)])
    start = D(2000, 1, 1)
    works = [(start, ["me"]), (start + dt.timedelta(1825), ["me", "you"])]
    df = spark.createDataFrame([(works,)], "w array<struct<date: date, collaborators: array<string>>>")
    assert df.select(early.early_collaborator(F.col("w"), F.lit(start), F.lit("me"))).first()[0]
    assert not df.select(early.early_collaborator(F.col("w"), F.lit(start), F.lit("me"), 1824)).first()[0]


DOC = ("m1", "Ann", "Writer, singer", "FR", "Paris",
       [(1, "w", "2000-01-05", ["pop", "rock"], [("m1", "writer"), ("m2", "composer")]), (2, "v", None, [], [("m1", "writer")])],
       [(10, "Song remix", 1000, 1, 100), (11, None, 3000, 2, 101)],
       [(100, "R", "2000-01-01", 5, ["l1"], ["Lab"]), (101, "S", "2001-01-01", 6, [], [])])


def test_features_of_documents(spark):
    empty = ("m9", "Zed", "", None, None, [], [], [])
    docs = spark.createDataFrame([DOC, empty], ARTIST_DOC)
    rows = {r.artist_mbid: r for r in early.features(docs, "2020-01-01").collect()}
    assert list(early.features(docs, "2020-01-01").columns) == list(EARLY_COLUMNS)
    a, z = rows["m1"], rows["m9"]
    assert (a.releases_total, a.tracks_total, a.collab_track_rate, a.unique_collaborator_count, a.primary_label, a.genre_count, a.primary_role, a.remix_rate) == (2, 2, 0.5, 2, "Lab", 2, "singer", 0.5)
    assert (z.releases_total, z.debut_date, z.primary_role) == (0, None, "unknown")
    assert [r.mbid for r in pipeline.accepted(docs).collect()] == ["m1"]
