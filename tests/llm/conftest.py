import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int, slice string, h string, rank string, fp string, score string, root string, mark string, none int, row int"
PROSE = "the cat and the dog went to the house of a friend and it was on the road that they saw by the river with a boat for this is as to be in "


def docs_of(spark, rows):
    """A documents table with extra columns whose names operators might use."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 7, "s", "h", "r", "f", "x", "root", "m", 1, 2) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 5000} the and of" for i in range(60_000))
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n \r ", None, None), (4, long, "en", "a"), (5, PROSE * 6, "en", "b"), (5, PROSE * 6, "en", "b"),
        (None, PROSE * 6, "en", "b"), (None, None, None, None), (6, "x", "de", "a"), (7, "éà 漢字 😀 <|endoftext|>", "fr", None), (8, "a\0b", "en", "a"),
        (9, "12 34 !!", "en", "a"), (10, "Q" * 30_000, "de", "c"), (5, "another text with that id", "en", "b"), (11, "one two", "es", "a"),
    ]
    return rows


@pytest.fixture
def edge_docs(spark, edge_rows):
    return docs_of(spark, edge_rows)


@pytest.fixture
def no_docs(spark):
    return docs_of(spark, [])
