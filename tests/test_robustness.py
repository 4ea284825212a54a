"""Texts and tables that once stopped a job or changed its result."""

import random
import time

import pytest
from pyspark.sql import functions as F

from factlake.functions.numeric import extract_numbers, extract_years
from factlake.functions.pii import pii_spans
from factlake.operators.claims import resolve_coreferences
from factlake.operators.evaluation import evaluate_risk
from factlake.operators.retrieval import KnowledgeIndex, retrieve_evidence, score_entries
from factlake.plans.screen import screen_prompts
from factlake.streaming import feedback_totals_stream, read_totals

FULL = str.maketrans("0123456789", "０１２３４５６７８９")
ARABIC = str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩")


def test_digits_of_other_scripts(spark):
    rnd = random.Random(1)
    texts = ["my card is 4111 1111 1111 1111 now", "in 1999 there were 68 million", "1٩٩٩ and ４.5 percent"]
    texts += [t.translate(table) for t in texts[:2] for table in (FULL, ARABIC)]
    texts += ["".join(rnd.choices("0123٣４９ -.,%", k=30)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(
        pii_spans(F.col("t")).alias("pii"),
        extract_numbers(F.col("t")).alias("numbers"),
        extract_years(F.col("t")).alias("years"),
    ).collect()
    for k in (0, 3, 4):
        assert [s["pii_type"] for s in rows[k]["pii"]] == ["credit_card"]
    for k in (1, 5, 6):
        assert rows[k]["years"] == ([1999] if k == 1 else [])  # a year starts with 1 or 2
        assert 68e6 in [n["value"] for n in rows[k]["numbers"]]
    assert rows[2]["years"] == [1999] and 4.5 in [n["value"] for n in rows[2]["numbers"]]


@pytest.mark.parametrize("hot_df", [0, 1, 3, 256])
def test_retrieval_is_exact_on_near_equal_credibility(spark, hot_df):
    rnd = random.Random(hot_df)
    kb = []
    for k in range(300):
        words = sorted(rnd.sample("river basin harvest revenue rainfall".split(), rnd.randint(1, 3)))
        kb.append((k, "News", f"s{k}", "u", words, 0.9 + rnd.randint(0, 60) * 1e-5))
    kb = spark.createDataFrame(
        kb, "kb_id long, source string, snippet string, url string, keywords array<string>, source_credibility double"
    )
    claims = [(a, 0, " ".join(rnd.sample("river basin harvest revenue rainfall".split(), 2))) for a in range(12)]
    claims = spark.createDataFrame(claims, "answer_id long, claim_index int, text string")
    for k in (1, 3):
        got, all_entries = (
            score_entries(claims, KnowledgeIndex.build(kb, k=n, hot_df=h)).collect()
            for n, h in ((k, hot_df), (300, 1 << 40))
        )
        want = [r for r in all_entries if r["kb_rank"] <= k]
        assert sorted(got) == sorted(want)


def test_missing_evidence_texts(spark):
    kb = spark.createDataFrame(
        [(1, None, None, None, ["river"], None)],
        "kb_id long, source string, snippet string, url string, keywords array<string>, source_credibility double",
    )
    claims = spark.createDataFrame([(1, 0, "the river")], "answer_id long, claim_index int, text string")
    row = retrieve_evidence(claims, KnowledgeIndex.build(kb)).first()
    assert (row["source"], row["snippet"], row["url"]) == ("unknown", "", "")


def test_coreference_is_linear(spark):
    text = ["Lake Volta is large.", *["it is the capital of a region."] * 4000]
    df = spark.createDataFrame([(text,)], "s array<string>")
    df.select(resolve_coreferences(F.slice("s", 1, 20))).collect()
    start = time.perf_counter()
    out = df.select(resolve_coreferences(F.col("s"))).first()[0]
    assert time.perf_counter() - start < 10
    assert out[4000].startswith("Lake Volta is the capital")


def test_previous_looks_back_only(spark):
    text = ["It was Ulm.", "Rome fell.", "It rose.", "They left."]
    df = spark.createDataFrame([(text,)], "s array<string>")
    out = df.select(resolve_coreferences(F.col("s"), "previous")).first()[0]
    assert out[0] == "It was Ulm." and out[2] == "Rome rose." and out[3] == "Rome left."


def test_messages_round_half_to_even(spark):
    df = spark.createDataFrame(
        [("HIGH", 0.125, "LOW")], "expected_risk_level string, risk_score double, risk_level string"
    ).withColumn("predicted_verdicts", F.expr("CAST(array() AS array<struct<verdict: string>>)"))
    issue = evaluate_risk(df).first()["risk_issues"][-1]
    assert "got 0.12" in issue


def test_every_prompt_is_accounted_for(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello there")], "prompt_id long, prompt string")
    done = screen_prompts(df)
    assert [r["prompt_id"] for r in done.results.collect()] == [3]
    problems = {r["prompt_id"]: r["problems"] for r in done.rejected.collect()}
    assert problems == {1: ["prompt is missing"], 2: ["prompt is shorter than 1"]}


def test_totals_keep_every_state(spark, tmp_path):
    rows = spark.createDataFrame([("A", "B"), ("A", "B"), ("A", "C")], "predicted_verdict string, correct_verdict string")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    feedback_totals_stream(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    out = {(r["predicted_verdict"], r["correct_verdict"]): r["count"] for r in read_totals(spark, f"{tmp_path}/out").collect()}
    assert out == {("A", "B"): 2, ("A", "C"): 1}


def test_saved_index_answers_alike(spark, tmp_path):
    kb = [(k, "News", "s", "u", ["river", f"w{k % 7}"], 0.5 + k / 100) for k in range(30)]
    kb = spark.createDataFrame(
        kb, "kb_id long, source string, snippet string, url string, keywords array<string>, source_credibility double"
    )
    claims = spark.createDataFrame([(1, 0, "river w3")], "answer_id long, claim_index int, text string")
    index = KnowledgeIndex.build(kb, hot_df=5)
    index.save(f"{tmp_path}/index")
    again = KnowledgeIndex.load(spark, f"{tmp_path}/index")
    assert sorted(score_entries(claims, index).collect()) == sorted(score_entries(claims, again).collect())
