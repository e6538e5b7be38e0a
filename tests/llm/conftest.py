import pytest

LONG = ("lorem ipsum dolor sit amet " * 12_000).strip()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns
    whose names the operators also use inside."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en"),
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en"),      # a repeated row
        (2, "The quick brown fox jumps over the lazy dog near the river bank today", None),      # an equal text
        (2, "another text of the same id", "en"),
        (None, None, None), (None, "", "en"), (3, "", None), (4, None, "en"), (None, "text without an id", "en"),
        (5, LONG, "en"), (6, "a", "en"), (7, " \t\n", "en"), (8, "é ü 日本語 \U0001F600 İſK ½", "xx"),
        (9, 'password = "abcdef123456" and <|endoftext|> MIT License', "en"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    clash = ["id", "row", "key", "part", "fp", "spans", "license", "shard", "score", "bucket", "_text", "_row", "_fp", "_rules", "_words", "toxicity", "host", "rule"]
    return df.selectExpr("*", "cast(length(text) as bigint) AS n_chars", *[f"'{c}' AS {c}" for c in clash])


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
