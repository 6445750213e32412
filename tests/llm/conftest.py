"""Small tables with the awkward cases every operator must stand."""

import pytest
from pyspark.sql import functions as F

# Names that operators use inside themselves.
CLASHES = "id key key2 row root anchor hash value vector list cell start length spans kept found fingerprint component_id ids lang_pred score rank _row _spans _key _found _rank".split()
LONG = " ".join(f"word{place % 977}x{place}" for place in range(30_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away."),
    (1, "The quick brown fox jumps over the lazy dog and runs away."),
    (2, "The quick brown fox jumps over the lazy dog and runs away."),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (None, "A text without an id, that is all."),
    (None, None),
    (6, "é 日本語 🙂 <|endoftext|> ½ 3.14 'll"),
    (7, LONG),
    (8, "12345 !!! 67890"),
    (9, "x"),
    (-3, LONG + " end"),
]


def table(spark, rows, schema, clashes=True):
    frame = spark.createDataFrame(rows, schema).repartition(3)
    return frame.withColumns({name: F.lit("clash") for name in CLASHES if name not in frame.columns}) if clashes else frame


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(key, text, "en" if place % 2 else None, "s", None if text is None else len(text)) for place, (key, text) in enumerate(TEXTS)]
    return table(spark, rows, "doc_id long, text string, lang string, source string, n_chars long").cache()


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.where("doc_id = 77777")


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows, schema: table(spark, rows, schema)
