import random

import pytest
from pyspark.sql import functions as F

WORDS = "the of and to in is that it was for on are as with his they at be this have from or one had by".split()


@pytest.fixture(scope="session")
def words():
    return WORDS


def prose(rng, n, words=WORDS, extra=400):
    return " ".join(rng.choice(words) if rng.random() < 0.4 else f"w{rng.randint(0, extra)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs():
    """Nulls, empties, copies, near copies, shared passages, one very long text, repeated ids."""
    rng = random.Random(5)
    passage, line = prose(rng, 40, extra=4000), "Shared  Line of Text"
    rows = []
    for i in range(120):
        t = prose(rng, rng.randint(0, 90))
        if i % 3 == 0:
            t = f"{t} {passage} {prose(rng, 5)}"
        if i % 4 == 0:
            t += "\n \t" + (line if i % 8 else line.upper()) + "\r\n" + prose(rng, 4)
        rows.append((i * 7 % 1000, t))
    rows += [(2000 + i, rows[i % 7][1]) for i in range(40)]
    rows += [(3000 + i, rows[1][1].replace("the", "The", 1) + " ende") for i in range(5)]
    rows += [(4000, None), (4001, ""), (4002, "\n\n"), (4003, "  \t "), (4004, "ab" * 400), (4005, "aaaa " * 200),
             (4006, prose(rng, 30000)), (4007, "é ü ß 中文 🙂 " * 30), (4008, "é ü ß 中文 🙂 " * 30),
             (4009, "abc" * 90 + "abd" + "abc" * 90), (4010, "x"), (4011, "a\x0bb\x0c c\x1cd\x85e\xa0f")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, odd_docs):
    """The rows over several partitions, with extra columns whose names clash with those used inside."""
    df = spark.createDataFrame(odd_docs, "doc_id long, text string").repartition(5)
    for c in ("id", "key", "n", "pos", "z", "words", "content", "score"):
        df = df.withColumn(c, F.lit(1))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
