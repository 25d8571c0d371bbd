import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
EXTRA = ("n_words", "kept", "shard", "chunk", "body", "doc", "key", "h", "slot", "block", "position", "bucket", "cls", "size", "h1", "ids")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with exact and near copies, shared passages, nulls, empty, short and long texts, repeated rows."""
    rng = random.Random(5)
    rows, passage = [], prose(rng, 60)
    for i in range(60):
        rows.append((i, prose(rng, rng.randrange(20, 220)), rng.choice(["en", "fr", None]), rng.choice(["a", "a", "b", None]), 0))
    base = prose(rng, 150)
    for i in range(60, 80):
        words = base.split()
        words[rng.randrange(len(words))] = f"x{i}"
        rows.append((i, " ".join(words), "en", "a", 0))
    for i in range(80, 95):
        rows.append((i, prose(rng, 40) + "\n" + passage + " " + prose(rng, 30), "en", "b", 0))
    rows += [(95, None, "en", "a", None), (96, "", None, None, 0), (97, "one", "en", "a", 3), (98, "one  TWO", "en", "a", 8), (99, "one two", "fr", "c", 7),
             (100, prose(rng, 20_000), "en", "a", 0), (101, rows[3][1], "en", "a", 0), (102, " \t\n ", "en", "a", 4), rows[5], rows[5]]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS)


@pytest.fixture(scope="session")
def wide(docs):
    """The same documents among columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(f"own {c}") for c in EXTRA})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
