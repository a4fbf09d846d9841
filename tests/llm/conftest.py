import pytest
from llm_texts import DOCS, prose, words

# columns that a careless operator would overwrite or confuse with its own
EXTRA = ", node string, kept string, first int, content int, line string, pos int, n_words int, piece int, key string"


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing columns."""
    base = prose(1, 120)
    near = base.replace(base.split()[30], "altered", 1)
    passage = " ".join(words(2, 70))
    rows = [
        (1, base, "en", "a"), (2, near, "en", "a"), (3, base, "en", "b"), (3, base, "en", "b"),
        (4, None, "en", "a"), (5, "", None, None), (6, " \n\t ", "de", "a"), (None, prose(3, 80), "en", None),
        (None, prose(3, 80), "en", None), (7, prose(4, 6000), "en", "a"), (8, "x", "en", "a"),
        (9, prose(5, 60) + "\n" + passage, "de", "a"), (10, passage + "\n" + prose(6, 60), "de", "a"),
        (10, prose(7, 90), "de", "b"), (11, "one\n\none\r\ntwo", None, "a"), (12, "%%% $$$ " * 60, "en", "a"),
        (13, prose(8, 100) + "\r\n" + prose(9, 30), "en", "a"), (14, prose(8, 100), "en", "a"),
    ]
    full = [(*r, len(r[1]) if r[1] is not None else None, "n", "k", 1, 2, "l", 3, 4, 5, "q") for r in rows]
    return spark.createDataFrame(full, DOCS + EXTRA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS + EXTRA)
