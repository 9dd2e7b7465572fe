import pytest


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def documents(spark):
    """Real documents with the awkward rows that every operator must bear."""
    import support

    return spark.read.parquet(f"{support.SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and columns whose names clash with operators' own."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, "alpha beta gamma delta epsilon", "en", "s", 30, 1),
        (2, None, None, None, None, None),
        (3, "", "en", "s", 0, 3),
        (4, "   \n\t ", "de", None, 6, 4),
        (5, long, "en", "s", len(long), 5),
        (6, long, None, "s", len(long), 6),
        (None, "alpha beta gamma delta epsilon", "en", "s", 30, 7),
        (1, "alpha beta gamma delta epsilon", "en", "s", 30, 1),
        (8, "Ünïcode 漢字 \x00 \x85 ½ İ", "fr", "s", 20, 8),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label long").selectExpr("*", "label as node", "label as key", "label as part", "label as removed", "label as hub", "label as size")
