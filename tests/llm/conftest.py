"""Rows with everything that may go wrong: NULLs, empty and long texts, repeats, and columns with clashing names."""

import pytest

SCHEMA = "doc_id long, text string, lang string, path string, blob string, key long, n long, host string, item string"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "x", "y", "z", 1, 2, "h", "i") for i, t in rows], SCHEMA)

    return make
