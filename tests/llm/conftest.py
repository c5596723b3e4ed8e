import random
from zlib import crc32

import pytest

#: Columns beyond the documented ones, with names that operators use for their own.
CLASHING = "key string, score double, label int, fp long, part int, _at int"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Documents with nulls in every column, empty and very long texts, ties and repeats."""
    chance = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "Über", "año", "été", "niño", "the", "and"]
    prose = lambda n: " ".join(chance.choice(words) for _ in range(n))
    texts = [prose(chance.randint(1, 80)) for _ in range(60)]
    texts += [texts[0]] * 25 + [None, None, "", "", " ", "\n\n", "123 456", "¿?", "日本語のテキスト", "a" * 200_000]
    texts += [prose(30_000), "x <|endoftext|> y", "tab\tand  two   spaces\x00 end ▁ <s>", "é" * 5000]
    rows = [
        (at, text, (None, "en", "de")[at % 3], (None, "s")[at % 2], len(text or "") if at % 4 else None)
        + ("k", 0.5, 1, 7, 2, 3)
        for at, text in enumerate(texts)
    ]
    rows += [rows[1], rows[1], (None, *rows[2][1:]), (None, None, None, None, None) + (None,) * 6]
    return spark.createDataFrame(
        rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
    ).repartition(5)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(at, at % 2, int(at % 5 == 0)) for at in range(0, 70)] + [(None, 1, 1), (3, None, None), (4, 0, 1), (4, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(odd_labels):
    return odd_labels.limit(0)


def held(doc_id, divisor, value):
    return crc32(("" if doc_id is None else str(doc_id)).encode()) % divisor == value
