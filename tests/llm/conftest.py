import pytest


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names are used inside."""
    long = " ".join(f"word{i % 977} is number {i}" for i in range(20_000))
    rows = [
        (1, "The first text of this small table, mail a.b@mail1.example.com today.", "en", "s0", "x"),
        (2, "The first text of this small table, mail a.b@mail1.example.com today.", "en", "s0", "y"),
        (2, "The first text of this small table, mail a.b@mail1.example.com today.", "en", "s0", "y"),
        (3, None, None, None, None),
        (4, "", "en", "s1", "z"),
        (5, " \n\t ", "de", "s1", "z"),
        (6, long, "en", None, "z"),
        (7, "!!! 123 $$$", None, "s2", "z"),
        (None, "A text without an id.", "fr", "s2", "z"),
    ]
    names = "doc_id bigint, text string, lang string, source string"
    clashes = ["_id", "fp", "cluster", "kind", "score", "e", "node", "wide", "_row", "id", "content", "_h", "n"]
    return spark.createDataFrame([(*r, *[r[4]] * (len(clashes) - 1)) for r in rows], f"{names}, " + ", ".join(f"`{c}` string" for c in clashes))


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.filter("false")
