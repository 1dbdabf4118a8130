import pytest

#: Null, empty, blank, short, long, repeated and odd texts; a repeated row; a null id; columns whose names clash with results.
LONG = " ".join(f"word{k % 977} and{k}" for k in range(40_000))
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d"), (6, "x" * 20_000), (7, LONG), (8, "línea é 日本語 😀 ▁ x  y\n\n  z\r\n"), (8, "línea é 日本語 😀 ▁ x  y\n\n  z\r\n"),
    (None, "a row without an id but with some words in it"), (9, "###" * 30), (10, "12 34 !!"), (11, "<|endoftext|> </s> <unk> <0x0A>"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, None if k % 2 else "en", "s", None, "clash", "clash", 5, b"z") for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, lines string, n_words int, sketch binary")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("1 = 0")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
