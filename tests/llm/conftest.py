import pytest
from pyspark.sql import Row

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


DOC_FIELDS = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, rank string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing columns."""
    long = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    base = "The quick brown fox jumps over the lazy dog and runs far away from here today"
    rows = [
        (1, base, "en", "a", 10, "x", "y", "z"),
        (1, base, "en", "a", 10, "x", "y", "z"),
        (2, None, None, None, None, None, None, None),
        (3, "", "en", "b", 0, "", "", ""),
        (4, " \t\n\x0b ", "en", "b", 5, "", "", ""),
        (5, long, "en", "c", len(long), "", "", ""),
        (6, long, "en", None, len(long), "", "", ""),
        (None, base, "en", "a", 10, "x", "y", "z"),
        (7, " x\u0085y ́ \U0001f600 <|endoftext|>it's \x1c z", "xx", "\U0001f600", 1, "", "", ""),
        (8, base + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "en", "", 1, "", "", ""),
        (9, "x" * 50_000, "en", "a", 1, "", "", ""),
    ]
    return spark.createDataFrame([Row(*r) for r in rows], DOC_FIELDS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_FIELDS)
