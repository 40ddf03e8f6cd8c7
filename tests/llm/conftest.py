import pytest

LONG = " ".join(f"word{i % 977}x{i}" for i in range(3000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))


@pytest.fixture(scope="session")
def rows():
    """doc_id, text, lang, source, n_chars and a clashing extra column: nulls, empties, ties, repeats, long texts."""
    texts = [
        None,
        "",
        " \t\n",
        "Hello World",
        "hello world",
        "HELLO world",
        LONG,
        LONG + " tail",
        "start " + PASSAGE + " end of one",
        "other beginning " + PASSAGE + " and another end",
        PASSAGE + " " + PASSAGE,
        "a b c d e f g h i j k l",
        "a a a a a a a a a a a a a a a",
        "line one here\nline one here\n\nline two ### here",
        "ÉTÉ <|endoftext|> Σ 中文字  x",
        "one",
        "a b c d e f g h i j k l",
    ]
    out = [(i, t, "en" if i % 2 else None, "s", 0 if t is None else len(t), f"k{i}") for i, t in enumerate(texts)]
    return [*out, out[3]]  # a repeated row


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
