import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from texts or (text, lang, source) tuples, ids from 0, with columns whose names operators use themselves."""

    def make(rows, extra=True):
        full = [(i, *(r if isinstance(r, tuple) else (r, "en", "s")), len((r[0] if isinstance(r, tuple) else r) or "")) for i, r in enumerate(rows)]
        frame = spark.createDataFrame(full, SCHEMA)
        if extra:
            names = ["id", "key", "n", "weight", "copies", "rule", "kept", "n_words", "spans", "score", "host", "_s", "_h", "block", "component"]
            frame = frame.selectExpr("*", *[f"'mine' AS `{n}`" for n in names])
        return frame

    return make


@pytest.fixture
def edge_texts():
    return [None, "", " ", "\n\n", "a", "é", "123 !", "A b C d e", "x " * 5, "word " * 30_000, "ab\tcd\u2028ef  gh\n", "😀 ok 😀", "A b C d e", "A b C d e"]
