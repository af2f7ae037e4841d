import random

import pytest
from pyspark.sql import types as T

WORDS = "the of and token secret AKIA été straße 数据 a| #x $$ <b> o'neil 42 x".split(" ")


@pytest.fixture
def odd_texts():
    """Nulls, empty and blank texts, ties, repeated lines and words, control characters, one very long text."""
    rng = random.Random(7)
    texts = [None, "", " ", "\n\n", "one", "a b c d e f g h i j", "x " * 400, "same line here\n" * 30, "tail\r\n tail\r\n", "  x \x0b\x0cy"]
    texts += [" ".join(rng.choices(WORDS, k=rng.randint(1, 60))) for _ in range(40)]
    texts += ["\n".join(" ".join(rng.choices(WORDS, k=rng.randint(0, 6))) for _ in range(20)) for _ in range(20)]
    texts += [" ".join(rng.choices(WORDS, k=60_000))]
    return texts + texts[:12]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    def make(texts, sources=None, **extra):
        rows = [(i, t, "en", sources[i] if sources else f"s{i % 3}", len(t) if t else 0) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture
def empty_docs(spark):
    return spark.createDataFrame([], T._parse_datatype_string(DOCS))
