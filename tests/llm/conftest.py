import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (id, text); ``n_words``, ``set``, ``id`` and ``log_weight`` are extra columns with clashing names."""

    def make(rows, extra=False):
        full = [(i, t, ("en", "fr")[k % 2] if k % 5 else None, "s", None) for k, (i, t) in enumerate(rows)]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            df = df.selectExpr("*", "'x' as n_words", "'y' as `set`", "'z' as id", "'u' as log_weight", "'v' as n_lines", "'w' as `group`")
        return df

    return make


LONG = " ".join(f"word{k % 977}" for k in range(60_000))
EDGES = [(None, "no id here at all"), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (5, LONG), (6, LONG), (7, "é" * 500), (8, "a\n" * 50)]


@pytest.fixture(scope="session")
def edge_rows():
    return EDGES
