import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Extra columns named like the operators' own.
CLASHES = ["key", "place", "node", "size", "rank", "copies", "row", "_key", "words", "piece"]
DOCS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
        *[StructField(c, StringType()) for c in CLASHES],
    ]
)
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
PROSE = " ".join(f"alpha{i} beta{i % 7} gamma{i % 11}" for i in range(40))


def doc(doc_id, text, source="s1", lang="en"):
    return (doc_id, text, lang, source, None if text is None else len(text), *["clash"] * len(CLASHES))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source]) rows, with clashing extra columns."""

    def make(rows):
        return spark.createDataFrame([doc(*r) for r in rows], DOCS)

    return make


#: Nulls, empty and white-space texts, a very long text, ties, repeated rows, odd characters.
ODD_ROWS = [
    (1, PROSE),
    (1, PROSE),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, LONG),
    (6, PROSE),
    (7, PROSE + " tail", None),
    (8, "éèçß ñ 漢字 😀 á \u0085   x"),
    (9, "one"),
    (None, "no id here"),
    (None, None, None),
    (10, "Ha ha " * 60),
]


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    return make_docs(ODD_ROWS)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])


@pytest.fixture(scope="session")
def odd_rows():
    return ODD_ROWS
