import pytest


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


ODD = [
    (1, "One line of plain words that goes on for a while, as clean prose does, and that says more than twenty words in all of it.", "en", "s", 1),
    (1, "One line of plain words that goes on for a while, as clean prose does, and that says more than twenty words in all of it.", "en", "s", 1),
    (2, "", "en", "s", 0),
    (3, None, None, None, None),
    (None, "no id here", "en", None, 10),
    (None, None, None, None, None),
    (4, " \t\n\r\x0b\x0c \n", "en", "s", 8),
    (5, "word " * 40_000, "en", "s", 200_000),
    (6, "x" * 300_000, "en", "s", 300_000),
    (7, "é ß 漢字 \u00a0 \u2028 \x1c 1 😀 <|endoftext|> \ud7ff", "xx", "s", 1),
    (8, "\n".join(["same line of text"] * 500), "en", "s", 9),
    (-9, "0123456789 " * 50, "en", "s", 9),
]
#: Names that operators use for their own columns.
CLASHES = ("kept", "size", "slot", "fp", "shard", "score", "line", "leaf", "at", "key", "template", "vslot", "q", "block", "start", "row", "root", "rank")


@pytest.fixture(scope="session")
def odd(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(*row, *("own" for _ in CLASHES)) for row in ODD], schema)
