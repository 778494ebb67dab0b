import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, shared ids, and columns with names used inside."""
    long = " ".join(f"word{i % 997} and the of" for i in range(20_000))
    rows = [
        (1, None, "en", 1), (2, "", None, 2), (3, " \t\n\x0b", "en", None), (4, "Re.", "fr", 1), (None, "A text without an id, in one line.", "en", 1),
        (None, "A text without an id, in one line.", "en", 1), (5, "The same row stands here twice, word for word.", "en", 1),
        (5, "The same row stands here twice, word for word.", "en", 1), (5, "But this one has only the id of the others.", "en", 2),
        (6, long, "en", 1), (7, long + " end", "en", 1), (8, "12345 67890 !!! ...", "de", 1), (9, "x" * 3000, None, 1), (10, "é漢字🙂 " * 200, "es", 1),
    ]
    fields = "doc_id bigint, text string, lang string, tk int"
    df = spark.createDataFrame(rows, fields)
    return df.selectExpr("*", "1 as id", "'x' as row", "'y' as _row", "2 as fp", "0 as `a.b`", "text as key", "lang as component", "3 as score")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
