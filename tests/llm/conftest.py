import pytest

FOLDER = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 8000


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def texts(corpus):
    """doc_id -> text, null as empty."""
    return {r["doc_id"]: r["text"] or "" for r in corpus.collect()}


CLASH = "row bigint, run int, size bigint, name string, key bigint, node bigint, score double, kept boolean, spans string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with names the operators use."""
    rows = [
        (1, "one two three four five six", "en", "a"), (2, "one two three four five six", "en", "a"),
        (3, None, None, None), (4, "", "de", "b"), (5, " \t\n ", None, "b"), (6, LONG, "en", "a"),
        (7, LONG + "end", "en", None), (None, "no id here", "en", "a"), (None, None, None, None),
        (8, "twice", "fr", "b"), (8, "twice", "fr", "b"), (9, "x", None, "a"), (10, "éè \U0001f600 café", "fr", ""),
    ]
    extra = (None,) * 9
    schema = f"doc_id bigint, text string, lang string, source string, {CLASH}, n_chars bigint"
    return spark.createDataFrame([(*r, *extra, len(r[1] or "")) for r in rows], schema)


@pytest.fixture(scope="session")
def no_rows(odd):
    return odd.limit(0)
