import pytest

LONG = " ".join(f"w{i % 997}q{i % 13}" for i in range(20000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, blanks of many kinds, and extra columns that operators use inside."""
    rows = [
        (1, "The cat sat on the mat again and again, the cat sat on the mat", "en", "a"), (1, "The cat sat on the mat again and again, the cat sat on the mat", "en", "a"),
        (2, None, "en", "a"), (3, "", None, None), (None, "a text without an id but with words enough to count ten of them", "en", None), (4, "x" * 50000, "de", "b"), (5, LONG, "en", "a"), (6, LONG, "en", "b"),
        (7, "é 😀 nbsp\x0bword\x1fsep   İstanbul ÀÉ", "fr", "c"), (8, " \t\n\x0b\f\r ", "fr", "c"), (9, "<|endoftext|> special <|endoftext|>", "en", "a"), (None, None, None, None),
    ]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return made.selectExpr("*", "1 AS own", "2 AS key", "3 AS n", "'z' AS spans", "5 AS fp", "6 AS rank", "7 AS held_out", "8 AS ids", "9 AS id", "10 AS log", "11 AS limit", "12 AS n_chars")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
