import pytest

#: Null, empty, blank and odd texts, ties, repeated rows, a very long text, and columns whose names clash with results.
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "a", 0),
    (2, "alpha  beta gamma delta epsilon zeta eta theta", "a", 1),
    (3, None, "b", 2),
    (4, "", None, 3),
    (5, " \n\t ", "b", 4),
    (6, "one\ntwo\nthree\nfour\nfive", "a", 5),
    (7, "zero\none\ntwo\nthree\nfour", "a", 6),
    (7, "zero\none\ntwo\nthree\nfour", "a", 6),
    (None, "a row without an id, <|endoftext|> inside", "a", 7),
    (9, "mail me at jo.doe@mail.example.com or +1 (555) 010-9999, card 4111 1111 1111 1111, host 10.0.0.300 or 10.0.0.3", "c", 8),
    (10, "word " * 30_000, "a", 9),
    (11, "ÄÖÜ naïve café Σίσυφος 日本語 x\x1cy", "a", 10),
    (12, "The the THE\r\nthe\x0bthe", "a", None),
]
SCHEMA = "doc_id long, text string, source string, kept int"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
