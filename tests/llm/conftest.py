from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, kept string, n_words long"
EMPTY = "empty"


def document_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns that clash with the operators' own."""
    base = " ".join(f"word{i} and" for i in range(80))
    near = base.replace("word7 and", "word7 or")
    long = " ".join(f"l{i % 5000}x" for i in range(30_000))
    texts = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (3, near, "en", None),
        (4, None, None, "a"),
        (5, "", "de", "b"),
        (6, " \n\t ", "de", "b"),
        (7, long, "en", "a"),
        (8, "tiny text", None, None),
        (9, "#### | $$$ 1234 &&&", "fr", "c"),
        (10, "same line\nsame line\nsame line\n" * 20, "de", "c"),
        (10, "same id, another text " + base, "de", "c"),
        (11, "été naïve ß ΣΑΣ 你好 <|endoftext|> ▁x", "fr", "é"),
        (None, base, "en", "a"),
        (None, None, None, None),
        (12, "a" * 700, "en", "b"),
        (13, near, "en", "z"),
        (13, near, "en", "z"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), 1, "x", -1) for i, t, lang, s in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(document_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def records(df):
    return [r.asDict() for r in df.collect()]


def read(path, name):
    import pyarrow.parquet as pq

    return pq.read_table(f"{path}/{name}.parquet").to_pylist()
