import pytest

ODD = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (None, "no id here at all", None, None),
    (3, "the same words again and again in one short text that has more than twenty words so that it is not too short for rules", "en", "a"),
    (4, "the same words again and again in one short text that has more than twenty words so that it is not too short for rules", "en", None),
    (4, "the same words again and again in one short text that has more than twenty words so that it is not too short for rules", "en", None),
    (5, " \n\t ", None, "a"),
    (6, "x" * 300_000, "de", "b"),
    (7, "word " * 30_000, "de", "b"),
    (8, "\u00e9t\u00e9 na\u00efve \U0001f600 text \x00 with \ufffd odd characters " * 20, "fr", "b"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, and extra columns whose names operators use themselves."""
    rows = [(*r, "kept", 1.0, 7) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string, score double, n_words int").cache()


@pytest.fixture(scope="session")
def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").cache()
