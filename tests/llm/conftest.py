import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def odd_rows():
    """Nulls in any column, empty and long texts, repeated rows, ties, marks outside ASCII and the BMP."""
    rng = random.Random(4)
    words = ["the", "of", "Über", "naïve", "x" * 50, "𝔘𝔫𝔦", "a.b", "don't", "42", "!!"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = text(60_000)
    same = "\n".join(text(6) for _ in range(8))
    out = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, long), (6, same), (7, same), (8, same + " tail"), (9, "\x00 \x00a"), (10, text(300)), (10, text(5)), (11, same), (11, same), (None, "no id here " * 9), (None, None), (12, "\n\n\n\n"), (13, "!!! ??? ..."), (14, "tail\n" + same)]
    return [(i, t, "en" if t else None, None if i == 7 else "s", None) for i, t in out]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
