"""Tables that hold what real ones may: nulls, empty and long texts, ties, repeated rows, more columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, root string"


def invented(rng, n):
    return " ".join("".join(rng.choice(["the", "an", "er", "ing", "tion", "of", "Ö", "é"]) for _ in range(rng.randint(1, 3))) + rng.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(3)
    base = [invented(rng, rng.randint(60, 200)) for _ in range(12)]
    near = []
    for t in base[:6]:
        for k in (1, 4, 12):
            w = t.split(" ")
            for _ in range(k):
                w[rng.randrange(len(w))] = invented(rng, 1)
            near.append(" ".join(w))
    odd = [None, "", "   \n ", "a", "a b c", "a b c", "x" * 5000, "word " * 900, "ab " * 300 + base[0], base[0], base[0], base[1] + "\n" + base[2], "\x00nul\x85 é　z", "<|endoftext|> x"]
    return base + near + odd + [t * 40 for t in base[3:5]]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, ["en", "fr", None, "xx"][i % 4], "s", None, "own", "own") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[1], None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
