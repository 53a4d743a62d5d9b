import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from texts, or from (doc_id, text) pairs, with columns whose names could clash."""

    def make(rows, extra="score double, kept boolean, bucket long, node long, word string, key long, label int"):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        names = len(extra.split(","))
        full = [(i, t, "en", "s", len(t) if t is not None else None, *[None] * names) for i, t in rows]
        return spark.createDataFrame(full, f"{SCHEMA}, {extra}")

    return make
