import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use themselves
        T.StructField("spans", T.StringType()),
        T.StructField("hits", T.IntegerType()),
        T.StructField("_text", T.StringType()),
    ]
)


def rows_of(texts, start=0):
    return [(start + k, t, "en", "src0", None if t is None else len(t), "x", k, "y") for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts_or_rows):
        rows = [x if isinstance(x, tuple) else None for x in texts_or_rows]
        if any(r is None for r in rows):
            rows = rows_of(texts_or_rows)
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def prose():
    rng = random.Random(5)
    words = ["".join(rng.choice(["th", "er", "on", "an", "re", "ti"]) for _ in range(rng.randint(1, 3))) for _ in range(120)]

    def text(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(words) for _ in range(n))

    return text


#: Texts that every operator must take: null, empty, white space, odd ones, a very long one.
ODD = [None, "", "   \n\t", "a", "Ä ö ß 漢字  x", "a\x00b", "퟿\U0001f600" * 3, "word " * 60_000, "x" * 200_000, "same text here again", "same text here again"]
