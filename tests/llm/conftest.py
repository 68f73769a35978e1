import pytest

ODD = [
    (1, "plain words here and there", "en", "a", 26),
    (2, None, None, None, None),
    (3, "", "", "", 0),
    (4, "plain words here and there", "en", "a", 26),
    (4, "plain words here and there", "en", "a", 26),
    (5, "  spaced\t\n out \x0b text  ", "en", "b", 20),
    (6, "spaced out text", "en", "b", 15),
    (None, "no id at all", "en", None, 12),
    (7, "<|endoftext|> marks <|endoftext|><|startoftext|>", "xx", "c", 30),
    (8, "İstanbul ΣΑΣ ﬁx état 漢字 🙂    it's we'LL 12345", "xx", "c", 30),
    (9, "long " * 30000, "en", "c", 150000),
    (10, "x" * 5000, "en", "c", 5000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, long and repeated texts, a null id, and columns whose names clash with inner ones."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id string, task int, _digest string"
    return spark.createDataFrame([(*r, "x", 1, None) for r in ODD], schema).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
