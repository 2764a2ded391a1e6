import random

import pytest

EXTRA = "size long, rank long, bucket long, n long, key string, component long, words string, place long, chunk long, rep long, `order` long, room long, _id long, _in string, _n long, _copies long, _hash long, shard int"
NEXTRA = len(EXTRA.split(", "))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text, lang, source): plain, near and exact copies, nulls, empty and very long texts, repeated rows."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, make(rng.randint(1, 120)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])) for i in range(60)]
    base = make(100).split()
    for i in range(60, 75):
        near = list(base)
        near[rng.randrange(100)] = "zz"
        rows.append((i, " ".join(near), "en", "a"))
    rows += [(i, rows[3][1], "en", "b") for i in range(75, 80)]
    rows += [(80, None, "en", "a"), (81, "", None, None), (82, " \t\n ", "de", "b"), (83, "one two", "en", "a"), (84, "One TWO", "en", "c")]
    rows += [(85, make(6000), "en", "a"), (86, "line\n" * 30, "de", "b"), (87, "é 中文 😀 <|endoftext|> don't. " * 40, "de", "c")]
    rows += [rows[5], rows[5], (None, make(30), "en", "a"), (None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(*r, *(("k" if t.endswith("string") else 1) for t in EXTRA.split(", "))) for r in texts], "doc_id long, text string, lang string, source string, " + EXTRA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, " + EXTRA)
