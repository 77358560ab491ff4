import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, media string, item_id int, words int, size string"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeforstn") for _ in range(r.randint(1, 9)))
    prose = lambda n: " ".join(word() + r.choice(["", "", ",", ".", ".\n"]) for _ in range(n))
    texts = [None, "", " ", "\n\n", "a", "é　ß 漢字 \U0001f600 x", prose(60), prose(300), prose(12000), "same line\n" * 40, "x" * 70000, "tab\tvt\x0bff\x0c\x1cq", "<|endoftext|> it's 12345 A'LL"]
    texts += [texts[6], texts[7], texts[6]] + [prose(r.randint(1, 200)) for _ in range(30)]
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None, "m", 1, 2, "z") for i, t in enumerate(texts)]
    return rows + [rows[6], rows[6], (None, "null id text", None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
