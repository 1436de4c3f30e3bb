import pytest

LONG = "lorem ipsum dolor " * 20_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and columns with clashing names."""
    rows = [
        (1, "Hello, World! hello"),
        (2, None),
        (3, ""),
        (4, " \t\n "),
        (5, "Hello, World! hello"),
        (5, "Hello, World! hello"),
        (None, "Hello, World! hello"),
        (None, None),
        (6, LONG),
        (7, "x" * 100_000),
        (8, "été <|endoftext|> naïve\x1c ΣΑΣ İ 漢字 😀"),
    ]
    extra = ("id", "row", "name", "value", "score", "doc", "h1", "body", "path", "piece", "kept", "token", "ids")
    made = [(*r, None if i == 0 else "src", i, *["?"] * len(extra)) for i, r in enumerate(rows)]
    schema = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    return spark.createDataFrame(made, schema).repartition(3, "n_chars")


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.where("doc_id > 1000")
