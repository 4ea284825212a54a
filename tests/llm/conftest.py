import random

import pytest
from pyspark.sql import functions as F

WORDS = [
    "".join(random.Random(k).choices("abcdefghiklmnoprstuvwz", k=3 + k % 6)) for k in range(400)
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use for columns of their own.
CLASHING = "counts fp group length size key start norm id line root kept rank gap uid block s n"


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choices(WORDS, k=n))


def odd_rows() -> list[tuple]:
    """Null, empty and very long texts, ties, repeated rows, near copies, odd signs."""
    base = prose(1, 120)
    passage = prose(2, 60)
    texts = [
        base,
        base,
        base.replace(WORDS[3], "changed"),
        prose(3, 40) + "\n" + passage + "\n" + prose(4, 40),
        passage + "\n" + prose(5, 30),
        None,
        "",
        "   \n\t\n ",
        "one",
        prose(6, 20_000),
        "Größe 😀 ünï token='abcdefgh1234' " + "é" * 300,
        "AKIA" + "A1" * 10 + " " + "0123456789abcdef" * 4 + " password: short",
        "\n".join([prose(7, 12)] * 5),
        "\n".join(prose(7, 12) + " " + WORDS[k] for k in range(5)),
        "x" * 5000,
        "<|endoftext|> and more <|endoftext|>",
        "a  b \n c d　e",
    ]
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[3], rows[5], (None, prose(8, 50), None, None, None), (None, None, None, None, 1)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The rows above with more columns, named as the operators name theirs."""
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    for name in CLASHING.split():
        df = df.withColumn(name, F.lit("theirs"))
    return df.repartition(3).persist()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)

