import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from texts; ids count up from 1, or are given as pairs."""

    def make(*texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts, 1)]
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)

    return make


@pytest.fixture
def awkward(documents):
    """Nulls, empty and very long texts, ties, repeated rows, and columns named like those that operators make."""
    from pyspark.sql import functions as F

    long = " ".join(f"word{i % 977} tail{i % 31}" for i in range(20_000))
    docs = documents((1, None), (2, ""), (3, "  \t\n "), (4, "one"), (5, "one"), (5, "one"), (6, long), (7, long + " end"), (None, "no id here at all"), (8, "a " * 3000), (9, "x" * 50_000), (10, "é ñ ü <|endoftext|> 日本語"))
    return docs.withColumns({c: F.lit("clash") for c in ("chunk", "recipe", "kept", "bucket", "ids", "score", "band", "stats", "text_key", "n", "part")})


@pytest.fixture
def none(documents):
    return documents()
