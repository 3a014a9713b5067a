from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A frame of documents from texts or (id, text) pairs, with columns that clash with helpers' names."""

    def of(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        made = spark.createDataFrame([(i, t, "en", None if i == 3 else f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS)
        return made.selectExpr("*", "1 AS _id", "2 AS _words", "3 AS n_words", "'x' AS h", "'y' AS `a.b`")

    return of
