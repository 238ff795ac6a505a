import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, blank and long texts, ties, repeated rows, an extra column with a clashing name."""
    long = " ".join(f"w{i % 977} x{i}" for i in range(20_000))
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, "   \t\n\x0b ", "en", None, 5),
        (4, "one", "en", "a", 3),
        (5, long, "en", "a", len(long)),
        (6, long, "en", "b", len(long)),
        (7, "Two words", None, "b", 9),
        (7, "Two words", None, "b", 9),
        (8, "été déjà vu \U0001d518 " * 30, "fr", "\U00010000", 10),
        (None, "no key here but some words", "en", "￿", 10),
    ]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", k int, t string")
