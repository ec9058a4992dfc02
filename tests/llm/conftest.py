import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    return SF


@pytest.fixture
def docs(spark):
    """Makes documents with the usual columns and some of clashing names."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), 1, "x", 2) for i, t in rows]
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, batch int, score string, bucket int"
        return spark.createDataFrame(full, schema)

    return make
