import sys

import pytest

sys.path.insert(0, "/".join(__file__.split("/")[:-3]))
SMALL = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, size int"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls everywhere, empty and long texts, repeated rows and columns whose names clash."""
    same = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, same, "en", "a", 1, "x", 1), (1, same, "en", "a", 1, "x", 1), (2, same.upper() + " thirteen", "en", None, 1, "x", 1),
        (3, None, None, "a", None, None, None), (4, "", "fr", "b", 0, "", 0), (5, " \t\n ", "fr", "b", 0, "", 0), (None, "lone words here", None, None, None, None, None),
        (6, "le la les des une pour dans avec " * 20_000, "fr", "b", 1, "x", 1), (7, "x" * 300_000, "en", None, 1, "x", 1), (8, "12345 67890 !!!", "en", "a", 1, "x", 1),
        (9, "mail me.now@host.example.com or +1 (743) 555-3824, 10.0.0.255, 4111 1111 1111 1111", "en", "c", 1, "x", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
