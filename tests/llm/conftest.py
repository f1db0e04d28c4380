import pytest

SCHEMA = "doc_id bigint, text string, lang string, score string, _row int, id int, list int"


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows with nulls, empty and very long texts, ties and repeated rows, and extra columns with clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    texts = [
        (1, "The quick brown fox jumps over the lazy dog and runs away"),
        (2, "the quick  brown fox jumps over\tthe lazy dog and runs away"),
        (3, None),
        (4, ""),
        (5, " "),
        (6, long),
        (7, long + " tail"),
        (8, "one"),
        (8, "one"),
        (9, "two words"),
        (None, "nobody's text"),
        (10, "line a\nline b\n\nLINE A \n line b"),
        (11, "The quick brown fox jumps over the lazy dog and runs away"),
        (12, "日本語 テキスト é ñ <|endoftext|> x"),
    ]
    return spark.createDataFrame([(i, t, "en", "s", 1, 2, 3) for i, t in texts], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
