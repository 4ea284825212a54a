import time

import pytest
from pyspark.sql import functions as F

from factlake.functions.numbers import exact_round, fixed2
from factlake.functions.numeric import extract_numbers, extract_years, numeric_conflict_detail
from factlake.functions.similarity import best_similarity
from factlake.functions.text import content_hash, keywords, safe_preview, split_sentences
from factlake.operators.claims import extract_claims, no_claims_status, resolve_coreferences


def _texts(spark, answer, **options):
    df = spark.createDataFrame([(1, answer)], "answer_id long, answer string")
    return [r["text"] for r in extract_claims(df, **options).orderBy("claim_index").collect()]


def _one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


def test_declarative_sentences(spark):
    text = "Lima is the capital of Peru. Peru has 34 million people."
    assert _texts(spark, text) == ["Lima is the capital of Peru.", "Peru has 34 million people."]


@pytest.mark.parametrize(
    "text, kept",
    [
        ("Yes. Lima is the capital of Peru.", ["Lima is the capital of Peru."]),
        ("I think it rains a lot. Lima is the capital of Peru.", ["Lima is the capital of Peru."]),
        ("", []),
        ("Hmm, well...", []),
    ],
)
def test_fragments_and_opinions_fall_out(spark, text, kept):
    assert _texts(spark, text) == kept


def test_at_most_twenty_claims(spark):
    assert len(_texts(spark, " ".join(f"Town {i} is a nice place to be." for i in range(25)))) == 20


def test_coreference_modes(spark):
    text = "Ada Lovelace wrote the first program. She was born in London. it is a large city."
    compat = _texts(spark, text)
    assert compat[1] == "She was born in London."
    assert compat[2] == "She is a large city."
    assert _texts(spark, text, coref="previous")[1] == "Ada Lovelace was born in London."


def test_offsets_count_every_part(spark):
    df = spark.createDataFrame([(1, "Yes. Lima is the capital of Peru.")], "answer_id long, answer string")
    row = extract_claims(df).first()
    assert (row["start_index"], row["end_index"]) == (5, 33)


def test_no_claims_status(spark):
    df = spark.createDataFrame([(1, "Hmm."), (2, "Lima is the capital of Peru.")], "answer_id long, answer string")
    assert [r["answer_id"] for r in no_claims_status(df, extract_claims(df)).collect()] == [1]


def test_text_expressions(spark):
    assert _one(spark, "  ", split_sentences) == []
    assert _one(spark, "One? Two! Three.", split_sentences) == ["One?", "Two!", "Three."]
    assert _one(spark, "That River river and the cat", keywords) == ["river"]
    assert _one(spark, "the cat sat", lambda c: keywords(c, 3)) == ["the", "cat", "sat"]
    assert _one(spark, "a\nb\x1b  c", safe_preview) == "a b c"
    assert _one(spark, "x" * 61, safe_preview) == "x" * 60 + "…"
    assert _one(spark, "abc", content_hash) == "sha:ba7816bf8f01"


@pytest.mark.parametrize("value", [0.125, 0.375, 0.155, 0.005, 0.015, 0.19375, 1.0, 0.0, 2 / 3])
def test_rounding_is_pythons(spark, value):
    assert _one(spark, value, lambda c: exact_round(c, 2), "double") == round(value, 2)
    assert _one(spark, value, lambda c: exact_round(c, 4), "double") == round(value, 4)
    assert _one(spark, value, fixed2, "double") == f"{value:.2f}"


@pytest.mark.parametrize(
    "claim, evidence, detail",
    [
        ("landed in 1967", "landed in 1969", "Year mismatch: claim says 1967, evidence says 1969"),
        ("5 trillion", "3 trillion", "Numeric mismatch: claim '5 trillion' vs evidence '3 trillion' (difference > 15%)"),
        ("3 trillion", "2.9 trillion", None),
        ("no number", "3 trillion", None),
        ("0 people", "0 people", None),
    ],
)
def test_numeric_conflict(spark, claim, evidence, detail):
    df = spark.createDataFrame([(claim, evidence)], "c string, e string")
    c, e = F.col("c"), F.col("e")
    got = df.select(
        numeric_conflict_detail(extract_numbers(c), extract_years(c), extract_numbers(e), extract_years(e))
    ).first()[0]
    assert got == detail


def test_best_similarity(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a", "c"]), (["x"], []), (["q", "r"], ["r", "q", "s"])], "l array<string>, r array<string>")
    got = [r[0] for r in df.select(best_similarity(F.col("l"), F.col("r"))).collect()]
    assert got == pytest.approx([2 / (5**0.5 * 2**0.5), 0.0, 1.0])


def test_scans_in_runs_are_those_in_one(spark):
    """Offsets and the last noun are carried over the ends of runs."""
    sentences = ["Ada wrote the first program."] + [f"He has seen town {i}." if i % 3 else f"towns are {i} in all." for i in range(400)]
    df = spark.createDataFrame([(1, " ".join(sentences)), (2, None), (3, "")], "answer_id long, answer string")
    resolved = df.select(resolve_coreferences(split_sentences(F.col("answer")), "previous").alias("s"), "answer_id")
    want = ["Ada" + s[2:] if s.startswith("He") else s for s in sentences]
    assert [r["s"] for r in resolved.orderBy("answer_id").collect()] == [want, None, []]
    found = extract_claims(df, max_claims=None).orderBy("claim_index").collect()
    at, starts = 0, []
    for s in sentences:
        starts.append(at)
        at += len(s) + 1
    assert len(found) == 401 and [r["start_index"] - starts[0] for r in found][0] == 0
    first = [r for r in found if r["text"].startswith("towns")][0]
    # Compat takes the pronoun itself for the noun, so that lengths stay.
    assert [r["start_index"] for r in found] == starts and first["end_index"] - first["start_index"] == len(first["text"])


def test_a_long_text_takes_no_square_of_its_sentences(spark):
    text = "The harvest was good in the river basin. " * 50_000
    df = spark.createDataFrame([(1, text)], "answer_id long, answer string")
    start = time.perf_counter()
    row = extract_claims(df, max_claims=None).agg(F.count(F.lit(1)), F.max("end_index")).first()
    assert tuple(row) == (50_000, len(text) - 1) and time.perf_counter() - start < 60
