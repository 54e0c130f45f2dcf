import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(9000))
PASSAGE = " ".join(f"shared{i}" for i in range(30))



@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank, very long, repeated and near-equal texts."""
    rows = [
        (1, "The cat sat on the mat. " + PASSAGE + " End of it.", "en", "a", 1),
        (2, "Another start here. " + PASSAGE + " other end.", "en", "a", 1),
        (3, None, "en", "a", None), (4, "", None, "b", 0), (5, "  \n\t ", "en", None, 5),
        (6, LONG, "en", "b", 9), (7, "Der Hund und die Katze, von dem Haus.\nAlle Rechte.", "de", "b", 3),
        (8, "Mail jo.doe@x-y.example.com or +1 (017) 555-7713, ip 10.0.0.300 10.0.0.30.1, card 4111 1111 1111 1111 é.", "en", "c", 2),
        (8, "Mail jo.doe@x-y.example.com or +1 (017) 555-7713, ip 10.0.0.300 10.0.0.30.1, card 4111 1111 1111 1111 é.", "en", "c", 2),
        (9, "short", "en", "c", 1), (10, "short", "en", "c", 1), (11, "Short", "en", "a", 1),
        (None, "a text without id " + PASSAGE, "en", "a", 1), (12, "1234 5678", "en", "a", 1),
        (13, PASSAGE + " " + PASSAGE, "en", "a", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows above, with extra columns whose names clash with results."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(odd_rows, SCHEMA)
    extra = ["score", "row", "fp", "queue", "block", "kind", "word", "component_id", "base", "h", "label", "id"]
    return df.withColumns({c: F.lit("x") for c in extra}).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
