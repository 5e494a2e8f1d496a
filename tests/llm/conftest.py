import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(r.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars): copies, near copies, shared passages, nulls, empty, long, repeated rows and equal ids."""
    r = random.Random(5)
    passage = words(r, 25)
    base = [words(r, r.randint(30, 120)) for _ in range(25)]
    texts = list(base)
    texts += [base[0], base[0], base[1]]  # copies
    near = base[2].split(" ")
    near[-1] = "changed"
    texts += [" ".join(near)]
    texts += [f"{words(r, 20)} {passage}\n{words(r, 15)}.", f"{passage} {words(r, 30)}", words(r, 3000) + " " + passage]
    texts += [None, "", "  \n\t", "one", "two words", "x" * 3000, "日本語 のテキスト。" * 10, "1 2 3 !!", "a b c d"]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("s1", "s2", None)[i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3]]  # repeated rows
    rows += [(4, words(r, 40), "en", "s1", 1)]  # another text of the same id
    rows += [(None, words(r, 40), "en", "s2", 1), (None, base[5], "fr", "s9", 1)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with more columns, named like internal ones."""
    from pyspark.sql import functions as F

    more = ["key", "size", "score", "block", "row", "start", "fingerprint", "kept", "taken", "class_id", "piece", "length", "a", "b", "word", "digest", "bucket", "__kw_text"]
    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(more)])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


