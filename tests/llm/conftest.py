import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

LONG = "wort " * 3000 + "ende"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing extra columns."""
    a = " ".join(f"w{i}" for i in range(120))
    b = " ".join(["x"] + [f"w{i}" for i in range(20, 110)] + ["y"] * 70)
    rows = [(1, a, "en", "h", 3), (1, a, "en", "h", 3), (2, b, None, "h", None), (3, None, "en", None, 0), (4, "", "en", "h", 0),
            (None, a, "en", "h", 1), (None, None, None, None, None), (5, LONG, "de", "g", 1), (6, LONG + " x", "de", "g", 1),
            (7, "  \n\t ", "en", "h", 1), (8, a.upper(), "en", "h", 1), (9, "a b " * 90, "en", "h", 1), (10, "b a " * 90, "en", "h", 1),
            (11, "é日本 \x00 #%&|<> ok. " * 9, "en", "h", 1), (2, a + " z", "en", "h", 1)]
    out = [(i, t, lang, s, n, "k", 1, [1]) for i, t, lang, s, n in rows]
    return spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long, "
                                      "key string, kept long, spans array<int>")


@pytest.fixture(scope="session")
def edge_rows(edge_docs):
    return [tuple(r) for r in edge_docs.collect()]

