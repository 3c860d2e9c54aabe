import pytest


@pytest.fixture(scope="session")
def documents_table(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, equal rows, and columns
    whose names clash with results."""
    long = " ".join(f"wort{i % 997} été{i}." for i in range(30000))
    prose = "one two three four five six seven eight nine ten eleven twelve " * 3
    rows = [(1, None, "en", "src1", None, 0.5, 3), (2, "", None, "src2", 0, None, 1), (3, " \n\t ", "de", None, 4, 0.1, 1),
            (4, long, "fr", "src0", len(long), 0.2, 2), (5, prose, "en", "src0", 9, 0.3, 2), (6, prose, "en", "src0", 9, 0.3, 2),
            (7, prose + "end", None, None, None, None, None), (8, "a b c", "en", "other", 5, 1.0, 0),
            (None, prose, "en", "src0", 9, 0.3, 2), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, score double, shard int").repartition(3)
