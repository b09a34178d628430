"""Documents with odd rows, for the tests of this folder."""

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, d string, ids int, score string, part int, own int, "
          "size int, copies int, fp int, key int, tie int, doc int, words int, n_lines int, salt int, label int, nth int, tid int")
EXTRA = (None,) * 17


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns."""
    long = " ".join(f"w{k % 977} the of" for k in range(30_000)) + "\n" + "x" * 5_000
    rows = [(1, "The house and the dog.\nshared line", "en", "a", None), (2, None, None, None, None), (3, "", "en", "a", 0),
            (4, "Der Hund und das Haus.\nshared line", "de", "b", 37), (4, "Der Hund und das Haus.\nshared line", "de", "b", 37),
            (None, "no id here", "en", None, 10), (None, None, None, None, None), (5, "12 34 !!", "en", "b", 8), (6, long, "en", "a", len(long)),
            (7, "  two  spaces \t and\x0bmore▁ \n \n", None, "c", 3), (8, "Der Hund und das Haus.\nshared line", "de", "c", 37)]
    rows += [(20 + k, f"text number {k} of some words here\nshared line", "en", "a", 1) for k in range(12)]
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
