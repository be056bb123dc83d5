import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

# Nulls, empty and blank texts, ties, repeated rows, clashing names.
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (None, "a row without id"), (4, "one"), (4, "one"),
    (5, "Café ÀÉ <|endoftext|> don't\n\n x ² ½ \x1f\x85　 😀"), (6, "word " * 3000),
]


@pytest.fixture
def docs(spark):
    """Make documents from (doc_id, text) pairs, with columns whose names clash with inner ones."""
    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, DOCS)
        for extra in ("row", "code", "keys", "w", "spans", "known", "_found", "id", "a", "b"):
            df = df.selectExpr("*", f"1 AS {extra}")
        return df

    return make


@pytest.fixture
def odd(docs):
    return docs(ODD)
