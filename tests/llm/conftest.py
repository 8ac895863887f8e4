import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()),
    # names that the operators use inside
    ("block", T.StringType()), ("bucket", T.IntegerType()), ("ids", T.StringType()), ("tag", T.IntegerType()), ("bytes", T.StringType()), ("start", T.StringType()),
)])


def _make(spark, rows):
    """Documents from (doc_id, text, lang, source), with columns of clashing names."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", 1, "y", None, "z", "s") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: _make(spark, rows)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank texts, one very long text, ties, repeated rows and ids, odd letters."""
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta,", "épée", "naïve.", "zoë", "x", "42", "don't", "mu", "nu", "xi"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, long = prose(40), prose(30_000)
    rows = [
        (None, None, None, None), (None, passage, "en", "a"), (0, None, None, "a"), (1, "", "en", None), (2, " \t\n ", "en", "b"), (3, "one", "fr", "b"),
        (4, "a b c", "en", "b"), (4, "a b c", "en", "b"), (5, passage, "en", "a"), (6, passage, "en", "a"), (7, prose(9) + "\n" + passage + "\n" + prose(9), "de", "a"),
        (8, long, "en", "a"), (9, "aaaa" * 60, "en", "c"), (10, "aaaa" * 60 + "b", "en", "c"), (-3, "日本語のテキスト " * 12, "ja", "c"), (11, "😀👍🏽é" * 30, None, "c"),
        (12, "same id, first text " + prose(30), "en", "d"), (12, "same id, other text " + prose(30), "en", "d"), (2**40, passage + " tail", "en", "d"),
    ]
    near = passage.split() + prose(60).split()
    for k in range(6):
        changed = list(near)
        changed[50 + k] = "changed"
        rows.append((100 + k, " ".join(changed), "en", "e"))
    return rows


@pytest.fixture(scope="session")
def edge(make, edge_rows):
    return make(edge_rows)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
