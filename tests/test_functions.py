import datetime as dt

from pyspark.sql import functions as F

from kinweave.functions import scalars as S


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column).first()[0]


def test_dates(spark):
    D = dt.date
    for text, strict, loose in [("2001-05-07", D(2001, 5, 7), D(2001, 5, 7)), ("2001-05", None, D(2001, 5, 1)), ("2001", None, D(2001, 1, 1)), ("2001-02-30", None, None), ("", None, None), (None, None, None), ("bad", None, None)]:
        assert one(spark, text, S.strict_date("s")) == strict
        assert one(spark, text, S.loose_date("s")) == loose
    assert one(spark, "2001-05-07", S.precision_date("s", F.lit("month"))) == D(2001, 5, 1)
    assert one(spark, "2001-05-07", S.ordinal(S.loose_date("s"))) == D(2001, 5, 7).toordinal()
    assert one(spark, "1949", S.plausible_year("s", 1950, 2020)) is None


def test_text(spark):
    assert one(spark, "\t A b\n", S.clean("s")) == "a b"
    assert one(spark, " ;, Rock|Pop", S.first_token("s")) == "Rock"
    assert one(spark, None, S.first_token("s")) == ""
    assert one(spark, "lead vocal, writer", S.role_class("s")) == "writer"
    assert one(spark, "engineer", S.role_class("s")) == "production"
    assert one(spark, "  ", S.role_class("s")) == ""
    assert one(spark, "Trap", S.alias_genre("s")) == "Hip Hop"
    assert one(spark, "https://x.y/artist/0123456789abcdefABCDEF?si=1", S.base62_id("s")) == "0123456789abcdefABCDEF"
    assert one(spark, "https://x.y/artist/short", S.base62_id("s")) is None
    assert one(spark, "{0A0B0C0D-0102-0304-0506-0708090A0B0C}", S.uuid("s")) == "0a0b0c0d-0102-0304-0506-0708090a0b0c"
    assert one(spark, "nothing", S.uuid("s")) is None


def test_labels_and_sets(spark):
    df = spark.createDataFrame([([], ["x"]), (["N", "M"], ["x"]), ([], [])], "names array<string>, ids array<string>")
    assert [r[0] for r in df.select(S.canonical_label(F.col("names"), F.col("ids"))).collect()] == ["x", "N", ""]
    df = spark.createDataFrame([([" Writer", "writer", "producer", ""],)], "x array<string>")
    assert df.select(S.ordered_set_text(F.col("x"))).first()[0] == "writer, producer"
