from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A function from (doc_id, text) pairs to a documents table."""

    def make(pairs):
        rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture
def as_tables(tmp_path):
    """A function that writes tables as the driver does and gives their folder."""

    def write(**frames):
        for name, df in frames.items():
            df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
