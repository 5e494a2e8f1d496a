"""Documents and features made in rounds that share the works' arrays, against those of one plan."""

from pyspark.sql import functions as F

import __spark_entry__
from kinweave.operators import catalog, early
from kinweave.plans import catalog_queries as Q
from kinweave.plans.entity_queries import AS_OF, rounded
from kinweave.validate import cut

DATA = __spark_entry__.TESTDATA


def rows(df):
    return sorted(map(str, df.collect()))


def odd(spark):
    """Tables with names that have the words, missing lengths and names, works of two dates, releases without a date."""
    t = Q.tables(spark, DATA)
    k, r, w = F.col("id"), t["recording"], t["work_first_release_date"]
    name = F.when(k % 7 == 0, F.lit("Late REMIX")).when(k % 7 == 1, F.lit("acoustic remix")).when(k % 7 != 2, F.col("name"))
    t["recording"] = r.withColumns({"name": name, "length": F.when(k % 5 != 0, F.col("length"))})
    t["work_first_release_date"] = w.union(w.where("work_id % 3 = 0").select("work_id", F.date_add("first_date", 400)))
    t["release_event"] = t["release_event"].where("release % 4 <> 0")
    return t


def test_features_stay_in_their_row(spark):
    """Features are functions of a row's arrays; before, all recordings and releases were written as documents and shuffled several times."""
    t, ids = odd(spark), Q.ids(spark, DATA).where("pos < 20 or pos > 50000000")
    want = early.features(cut(catalog.documents(t, ids, ordered=False).drop("pos")), AS_OF)
    doubles = [c for c, kind in want.dtypes if kind == "double"]
    parts = catalog.written_parts(t, ids, early.work_parts, lambda docs: docs, rows=1 << 19)
    got = early.measured(parts, AS_OF)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.dtypes == want.dtypes and got.where("remix_rate > 0 and acoustic_rate > 0").count() > 0
    assert rows(rounded(got, *doubles)) == rows(rounded(want, *doubles))


def test_rounds_share_works(spark, monkeypatch):
    """A round joins nothing, and rounds don't grow with the input; before, each joined all works' arrays again, and their number followed the rows alone."""
    t, ids = Q.tables(spark, DATA), Q.ids(spark, DATA)
    owned, listed = catalog.owned(t, ids), catalog.listed(t)
    total, each = catalog.pair_rows(owned, listed), listed.count()
    monkeypatch.setattr(catalog, "NESTED_ROWS", 1)
    monkeypatch.setattr(catalog, "OWNERS", 3)
    plans = []

    def kept(docs):
        plans.append(docs._jdf.queryExecution().optimizedPlan().toString())
        return docs

    got = catalog.written_documents(t, ids, kept=kept)
    assert 1 < len(plans) == -(-total // each) and not any("Join" in p for p in plans)
    assert rows(got) == rows(Q._documents(spark, DATA))
