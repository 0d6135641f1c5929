from __future__ import annotations

import pytest

#: Columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, key string, n_lines long, band string, context long, chunk int, _text string, score string, n int, drop string, a long, class string"


def _rows(texts):
    return [(i, t, "en", "s", len(t or ""), 7, "r", "k", 5, "b", 1, 2, "x", "y", 3, "z", 4, "c") for i, t in texts]


PROSE = "The quick brown fox jumps over the lazy dog and runs to the river, where it is quiet and the water is cold. "
#: Nulls, empty and white texts, copies, ties, repeats, a long text, odd characters.
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n \x0b\r\x0c"),
    (4, "one"),
    (5, "one two"),
    (6, "ONE\ntwo"),
    (7, PROSE * 3),
    (8, PROSE * 3),
    (8, PROSE * 3),
    (9, PROSE.upper() * 3),
    (10, "A shared line of more than twenty characters\n" * 3 + "own line ten"),
    (11, "  a shared line of more than twenty CHARACTERS  \nown line eleven"),
    (12, "a SHARED line of more than twenty characters\nÄ line of exactly 20ch\n"),
    (13, "".join(f"word{k} " for k in range(20000))),
    (14, "".join(f"word{k} " for k in range(20000)) + "end"),
    (15, "ab" * 3000),
    (16, "é中\U0001f600\x00" * 300 + "tail"),
    (17, "\n\n\n"),
    (18, "12345 67890 !!! ### $$$ %%% 12345"),
    (19, "".join(f"{k} and the " for k in range(500))),
    (20, "x" + PROSE * 5 + "y"),
    (None, PROSE * 2 + "null id"),
    (-5, "minus five " + PROSE),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(_rows(ODD), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def made(spark):
    """Rows of the wide schema from (doc_id, text) pairs."""
    return lambda texts: spark.createDataFrame(_rows(texts), SCHEMA)
