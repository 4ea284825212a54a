"""Evaluation of derived predictions, metrics, feedback, validation.

Cases are the assistant answers: their claims are the expected claims, the expected
verdicts follow from the claim's number.  Predictions lose, change and add some.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factlake.operators.claims import with_claims
from factlake.operators.evaluation import (
    benchmark_summary,
    case_report,
    case_results,
    claim_recall_simple,
    evaluate_citations,
    evaluate_claims,
    evaluate_risk,
    evaluate_verdicts,
    failed_checks,
    join_predictions,
    match_verdicts,
    predictions_from_reports,
)
from factlake.operators.feedback import correction_counts, feedback_summary
from factlake.operators.metrics import (
    accuracy,
    citation_coverage,
    claim_extraction_f1,
    class_metrics,
    hallucination_rate,
    macro_f1,
)
from factlake.operators.rows import staged, unnest
from factlake.operators.validation import (
    split,
    validate_answers,
    validate_eval_cases,
    validate_feedback,
    validate_ground_requests,
    validate_prompts,
)
from factlake.plans.screen import detect_toxicity
from workloads.base import ANSWERS_SQL, CLAIMS_SQL, SUBMITTED_SQL, answers, pick, sql_pick, submitted, table
from workloads.screening import PROMPTS_SQL, TOXICITY_SQL, prompts

_VERDICTS = ["SUPPORTED", "CONTRADICTED", "NOT_ENOUGH_EVIDENCE"]
_LEVELS = ["LOW", "MEDIUM", "HIGH"]


def _with_claims(spark, sf) -> DataFrame:
    return staged(with_claims(answers(spark, sf)), "claims")


def cases(spark, sf) -> DataFrame:
    return _with_claims(spark, sf).select(
        F.concat(F.lit("case_"), F.col("answer_id"), F.lit("_turn")).alias("case_id"),
        F.col("question").alias("original_question"),
        F.col("answer").alias("generated_answer"),
        F.transform(
            "claims", lambda c: F.struct(c["text"].alias("text"), c["claim_type"].alias("claim_type"))
        ).alias("expected_claims"),
        F.transform(
            "claims",
            lambda c: F.struct(
                c["text"].alias("claim_text"),
                pick(_VERDICTS, F.col("answer_id") + c["claim_index"]).alias("verdict"),
                F.lit(1.0).alias("confidence"),
                F.lit("").alias("reasoning"),
            ),
        ).alias("expected_verdicts"),
        F.array().cast("array<string>").alias("trusted_reference_evidence"),
        pick(_LEVELS, F.col("answer_id")).alias("expected_risk_level"),
        F.lit("").alias("notes"),
    )


def predictions(spark, sf) -> DataFrame:
    """Two predictions per case; the first by ``attempt`` counts."""

    def verdict(c):
        changed = (F.col("answer_id") + c["claim_index"] * 7) % 6 == 0
        return F.struct(
            F.when((F.col("answer_id") + c["claim_index"]) % 11 == 0, F.concat(c["text"], F.lit(" Indeed.")))
            .otherwise(c["text"])
            .alias("claim_text"),
            pick(_VERDICTS, F.col("answer_id") + c["claim_index"] + F.when(changed, 1).otherwise(0)).alias("verdict"),
            F.lit(0.5).alias("confidence"),
            F.when(c["claim_index"] % 2 == 0, F.array(c["claim_index"]))
            .otherwise(F.array().cast("array<int>"))
            .alias("evidence_indices"),
            F.lit("").alias("reasoning"),
        )

    kept = F.filter("claims", lambda c: c["claim_index"] % 5 != 4)
    extra = F.struct(
        F.lit("An unrelated extra claim.").alias("text"),
        F.lit("factual").alias("claim_type"),
        F.lit(0.7).alias("confidence"),
    )
    first = _with_claims(spark, sf).select(
        F.concat(F.lit("case_"), F.col("answer_id"), F.lit("_turn")).alias("case_id"),
        F.concat(
            F.transform(
                kept,
                lambda c: F.struct(
                    F.concat(F.lit(" "), c["text"], F.lit(" ")).alias("text"),
                    c["claim_type"].alias("claim_type"),
                    F.lit(0.95).alias("confidence"),
                ),
            ),
            F.when(F.col("answer_id") % 4 == 0, F.array(extra)).otherwise(F.array()),
        ).alias("extracted_claims"),
        F.transform(kept, verdict).alias("predicted_verdicts"),
        ((F.col("answer_id") % 10).cast("double") / 10).alias("risk_score"),
        pick(_LEVELS, F.col("answer_id") + F.when(F.col("answer_id") % 5 == 0, 1).otherwise(0)).alias("risk_level"),
        F.array().cast("array<string>").alias("citations"),
        F.lit(0).alias("processing_time_ms"),
        F.lit(1).alias("attempt"),
    )
    return first.unionByName(
        first.withColumn("attempt", F.lit(2)).withColumn("risk_level", F.lit("HIGH"))
    )


def _joined(spark, sf) -> DataFrame:
    return join_predictions(cases(spark, sf), predictions(spark, sf), "attempt")


def _results(spark, sf) -> DataFrame:
    return case_results(cases(spark, sf), predictions(spark, sf), "attempt")


def verdict_matches(spark, sf) -> DataFrame:
    return match_verdicts(_joined(spark, sf))


def verdict_scores(spark, sf) -> DataFrame:
    out = evaluate_verdicts(_joined(spark, sf))
    scores = ["verdict_accuracy", "verdict_precision", "verdict_recall", "verdict_f1", "overlap_accuracy"]
    return out.select(
        "case_id", *[F.round(c, 9).alias(c) for c in scores], F.array_join("verdict_issues", "|").alias("issues")
    )


def claim_scores(spark, sf) -> DataFrame:
    return evaluate_claims(_joined(spark, sf)).select(
        "case_id", "n_matched", "claim_accuracy", "claim_precision", "claim_recall", "claim_f1",
        F.array_join("claim_issues", "|").alias("issues"),
    )


def claim_recall(spark, sf) -> DataFrame:
    return claim_recall_simple(_joined(spark, sf))


def citation_scores(spark, sf) -> DataFrame:
    return evaluate_citations(_joined(spark, sf)).select(
        "case_id", "citation_coverage", F.array_join("citation_issues", "|").alias("issues")
    )


def risk_scores_by_case(spark, sf) -> DataFrame:
    return evaluate_risk(_joined(spark, sf)).select(
        "case_id", "risk_level_match", F.round("risk_score_diff", 9).alias("risk_score_diff"),
        "hallucination_rate", F.array_join("risk_issues", "|").alias("issues"),
    )


def benchmark(spark, sf) -> DataFrame:
    out = benchmark_summary(_results(spark, sf)).withColumn(
        "recommendations", F.array_join("recommendations", "|")
    )
    # Means of doubles depend on the order of rows in their last digits.
    means = [c for c in out.columns if c.startswith("mean_") or c.endswith("_rate")]
    return out.withColumns({c: F.round(c, 9) for c in means})


def benchmark_report(spark, sf) -> DataFrame:
    scores = ("verdict_accuracy", "verdict_f1")
    return case_report(_results(spark, sf)).withColumns({c: F.round(c, 9) for c in scores})


def benchmark_failures(spark, sf) -> DataFrame:
    return failed_checks(_results(spark, sf))


def report_predictions(spark, sf) -> DataFrame:
    from workloads.verification import _verified

    reports = _verified(spark, sf).reports
    out = predictions_from_reports(reports, F.concat(F.lit("case_"), "answer_id"))
    return out.select(
        "case_id", F.size("extracted_claims").alias("n_claims"), F.size("predicted_verdicts").alias("n_verdicts"),
        "risk_score", "risk_level", F.array_join("citations", "|").alias("citations"),
    )


def _labelled(spark, sf) -> DataFrame:
    """Three classes from the labels and a guess from the document's length."""
    labels = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    truth = F.when(F.col("toxic") == 1, "CONTRADICTED").when(F.col("quality") == 1, "SUPPORTED").otherwise(
        "NOT_ENOUGH_EVIDENCE"
    )
    return labels.join(docs, "doc_id").select(
        "doc_id", "lang", truth.alias("truth"), pick(_VERDICTS, F.col("n_chars")).alias("guess")
    )


def metrics_by_class(spark, sf) -> DataFrame:
    return class_metrics(_labelled(spark, sf), "truth", "guess")


def metrics_macro(spark, sf) -> DataFrame:
    return macro_f1(class_metrics(_labelled(spark, sf), "truth", "guess")).select(
        F.round("macro_f1", 9).alias("macro_f1")
    )


def metrics_by_language(spark, sf) -> DataFrame:
    truth, guess = F.col("truth"), F.col("guess")
    counts = _labelled(spark, sf).groupBy("lang").agg(
        accuracy(truth, guess).alias("accuracy"),
        hallucination_rate(guess).alias("hallucination_rate"),
        F.count_if(guess == "SUPPORTED").alias("n_supported"),
        F.count_if((guess == "SUPPORTED") & (F.col("doc_id") % 3 > 0)).alias("n_cited"),
        F.count_if(truth == "SUPPORTED").alias("n_expected"),
        F.count_if((truth == guess) & (truth == "SUPPORTED")).alias("n_both"),
    )
    return counts.select(
        "lang", "accuracy", "hallucination_rate",
        citation_coverage(F.col("n_supported"), F.col("n_cited")).alias("coverage"),
        claim_extraction_f1(F.col("n_expected"), F.col("n_supported"), F.col("n_both")).alias("extraction_f1"),
    )


def feedback(spark, sf) -> DataFrame:
    """The toxicity label corrects the toxicity rules."""
    labels = table(spark, sf, "labels")
    # Only what is labelled goes through the rules.
    labelled = prompts(spark, sf).join(labels.select(F.col("doc_id").alias("prompt_id")), "prompt_id", "left_semi")
    flagged = detect_toxicity(labelled, "prompt").select("prompt_id", F.col("toxicity.flag").alias("flag"))
    named = labels.join(flagged, F.col("doc_id") == F.col("prompt_id"))
    return named.select(
        F.col("doc_id").cast("string").alias("request_id"),
        F.lit(0).alias("claim_index"),
        F.when(F.col("flag"), "CONTRADICTED").otherwise("SUPPORTED").alias("predicted_verdict"),
        F.when(F.col("toxic") == 1, "CONTRADICTED").otherwise("SUPPORTED").alias("correct_verdict"),
        F.lit("").alias("comment"),
    )


def feedback_totals(spark, sf) -> DataFrame:
    return feedback_summary(feedback(spark, sf))


def feedback_corrections(spark, sf) -> DataFrame:
    return correction_counts(feedback(spark, sf))


def _problems(checked: DataFrame, key: str) -> DataFrame:
    _, rejected = split(checked)
    return rejected.select(F.col(key).alias("row_id"), F.array_join("problems", "|").alias("problems"))


def rejected_answers(spark, sf) -> DataFrame:
    return _problems(validate_answers(submitted(spark, sf)), "answer_id")


def rejected_prompts(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("prompt_id"), F.col("text").alias("prompt"),
        F.repeat("lang", (F.col("doc_id") % 60 * 100).cast("int")).alias("system_prompt"),
    )
    return _problems(validate_prompts(docs), "prompt_id")


def rejected_requests(spark, sf) -> DataFrame:
    asked = answers(spark, sf).select(
        "answer_id", "question", F.col("answer").alias("initial_answer"), (F.col("answer_id") % 7 - 2).alias("max_iterations")
    )
    return _problems(validate_ground_requests(asked), "answer_id")


def rejected_feedback(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        "doc_id", (F.col("doc_id") % 9 - 2).alias("claim_index"), F.col("text").alias("comment"),
        pick(_VERDICTS + ["MAYBE"], F.col("doc_id")).alias("predicted_verdict"), F.lit("SUPPORTED").alias("correct_verdict"),
    )
    return _problems(validate_feedback(docs, check_verdicts=True), "doc_id")


def rejected_cases(spark, sf) -> DataFrame:
    changed = cases(spark, sf).withColumn(
        "expected_risk_level", F.when(F.length("generated_answer") % 3 == 0, "SEVERE").otherwise(F.col("expected_risk_level"))
    )
    return _problems(validate_eval_cases(changed), "case_id")


QUERIES = {f.__name__: f for f in (
    verdict_matches, verdict_scores, claim_scores, claim_recall, citation_scores, risk_scores_by_case,
    benchmark, benchmark_report, benchmark_failures, report_predictions, metrics_by_class, metrics_macro,
    metrics_by_language, feedback_totals, feedback_corrections, rejected_answers, rejected_prompts,
    rejected_requests, rejected_feedback, rejected_cases,
)}

# ---- SQL -----------------------------------------------------------------------------

_V = "['SUPPORTED', 'CONTRADICTED', 'NOT_ENOUGH_EVIDENCE']"
EVAL_SQL = f"""
{ANSWERS_SQL}, {CLAIMS_SQL},
eval_cases AS (
  SELECT answer_id, 'case_' || answer_id || '_turn' AS case_id, {sql_pick(_LEVELS, 'answer_id')} AS expected_risk_level,
         {sql_pick(_LEVELS, '(answer_id + CASE WHEN answer_id % 5 = 0 THEN 1 ELSE 0 END)')} AS risk_level,
         (answer_id % 10)::DOUBLE / 10.0::DOUBLE AS risk_score FROM answers),
expected_rows AS (
  SELECT case_id, claim_index, text, lower(text) AS claim_key, {sql_pick(_VERDICTS, '(answer_id + claim_index)')} AS verdict
  FROM claims JOIN eval_cases USING (answer_id)),
predicted_rows AS (
  SELECT case_id, claim_index, text,
    lower(text || CASE WHEN (answer_id + claim_index) % 11 = 0 THEN ' Indeed.' ELSE '' END) AS claim_key,
    {sql_pick(_VERDICTS, '(answer_id + claim_index + CASE WHEN (answer_id + claim_index * 7) % 6 = 0 THEN 1 ELSE 0 END)')} AS verdict,
    claim_index % 2 = 0 AS cited
  FROM claims JOIN eval_cases USING (answer_id) WHERE claim_index % 5 <> 4),
matches AS (
  SELECT case_id, claim_key, e.verdict AS expected, p.verdict AS predicted
  FROM (SELECT case_id, claim_key, max_by(verdict, claim_index) AS verdict FROM expected_rows GROUP BY 1, 2) e
  FULL JOIN (SELECT case_id, claim_key, max_by(verdict, claim_index) AS verdict FROM predicted_rows GROUP BY 1, 2) p
  USING (case_id, claim_key)),
classes AS (
  SELECT case_id, c, count(*) FILTER (expected = c AND predicted = c) AS tp,
    count(*) FILTER (expected <> c AND predicted = c) AS fp,
    count(*) FILTER (expected = c AND predicted IS DISTINCT FROM c) AS fn
  FROM matches CROSS JOIN (SELECT unnest({_V}) AS c) GROUP BY 1, 2),
macros AS (
  SELECT case_id, avg(p) AS p, avg(r) AS r, avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) AS f FROM (
    SELECT case_id, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp)::DOUBLE ELSE 0 END AS p,
           tp::DOUBLE / (tp + fn)::DOUBLE AS r FROM classes WHERE tp + fn > 0) GROUP BY 1),
verdict_counts AS (
  SELECT case_id, count(expected) AS n_expected, count(*) FILTER (expected = predicted) AS n_correct,
    count(*) FILTER (expected IS NOT NULL AND predicted IS NOT NULL) AS n_both,
    string_agg(CASE WHEN predicted IS NULL THEN 'Missing prediction for claim: ' || left(claim_key, 80) || '...'
                    WHEN expected IS NULL THEN 'Unexpected prediction for claim: ' || left(claim_key, 80) || '...' END,
               '|' ORDER BY encode(claim_key)) AS issues
  FROM matches GROUP BY 1),
scores AS (
  SELECT case_id,
    CASE WHEN v.case_id IS NULL THEN 1.0::DOUBLE ELSE n_correct::DOUBLE / n_expected::DOUBLE END AS verdict_accuracy,
    coalesce(p, 1.0::DOUBLE) AS verdict_precision, coalesce(r, 1.0::DOUBLE) AS verdict_recall, coalesce(f, 1.0::DOUBLE) AS verdict_f1,
    CASE WHEN n_both > 0 THEN n_correct::DOUBLE / n_both::DOUBLE ELSE 0.0::DOUBLE END AS overlap_accuracy,
    CASE WHEN v.case_id IS NULL THEN 'No verdicts to evaluate' ELSE coalesce(issues, '') END AS issues
  FROM eval_cases LEFT JOIN verdict_counts v USING (case_id) LEFT JOIN macros USING (case_id)),
supported AS (
  SELECT c.case_id, count(*) FILTER (p.verdict = 'SUPPORTED') AS s, count(*) FILTER (p.verdict = 'SUPPORTED' AND cited) AS ci,
    count(*) FILTER (p.verdict <> 'SUPPORTED') AS bad, count(p.verdict) AS n
  FROM eval_cases c LEFT JOIN predicted_rows p USING (case_id) GROUP BY 1),
expected_supported AS (
  SELECT c.case_id, count(*) FILTER (e.verdict = 'SUPPORTED') AS es FROM eval_cases c LEFT JOIN expected_rows e USING (case_id) GROUP BY 1)"""

_DIFF = "abs(risk_score - CASE expected_risk_level WHEN 'LOW' THEN 0.15 WHEN 'MEDIUM' THEN 0.5 ELSE 0.85 END::DOUBLE)"
LABELLED_SQL = f"""
labelled AS (
  SELECT doc_id, lang, CASE WHEN toxic = 1 THEN 'CONTRADICTED' WHEN quality = 1 THEN 'SUPPORTED'
           ELSE 'NOT_ENOUGH_EVIDENCE' END AS truth, {sql_pick(_VERDICTS, 'n_chars')} AS guess
  FROM labels JOIN documents USING (doc_id)),
by_class AS (
  SELECT c AS class, tp + fn AS support, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp)::DOUBLE ELSE 0.0::DOUBLE END AS precision,
    CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn)::DOUBLE ELSE 0.0::DOUBLE END AS recall FROM (
    SELECT c, count(*) FILTER (truth = c AND guess = c) AS tp, count(*) FILTER (truth <> c AND guess = c) AS fp,
           count(*) FILTER (truth = c AND guess <> c) AS fn
    FROM labelled CROSS JOIN (SELECT unnest({_V}) AS c) GROUP BY 1)),
metrics AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1 FROM by_class)"""

FEEDBACK_SQL = f"""
{PROMPTS_SQL}, {TOXICITY_SQL},
feedback AS (
  SELECT CASE WHEN flag THEN 'CONTRADICTED' ELSE 'SUPPORTED' END AS predicted_verdict,
         CASE WHEN toxic = 1 THEN 'CONTRADICTED' ELSE 'SUPPORTED' END AS correct_verdict
  FROM labels JOIN toxic t ON doc_id = prompt_id)"""


def _length_sql(column: str, expr: str, most: int, least: int = 1, optional: bool = False) -> str:
    missing = "NULL" if optional else f"'{column} is missing'"
    return (
        f"CASE WHEN {expr} IS NULL THEN {missing} WHEN length({expr}) < {least} THEN '{column} is shorter than {least}' "
        f"WHEN length({expr}) > {most} THEN '{column} is longer than {most}' END"
    )


def _rejected_sql(key: str, source: str, *problems: str) -> str:
    return f"""SELECT * FROM (SELECT {key} AS row_id, concat_ws('|', {', '.join(problems)}) AS problems FROM {source})
        WHERE problems <> ''"""


ORACLES = {
    "verdict_matches": f"WITH {EVAL_SQL} SELECT * FROM matches",
    "verdict_scores": f"""WITH {EVAL_SQL} SELECT case_id, issues, round(verdict_accuracy, 9) AS verdict_accuracy,
        round(verdict_precision, 9) AS verdict_precision, round(verdict_recall, 9) AS verdict_recall,
        round(verdict_f1, 9) AS verdict_f1, round(overlap_accuracy, 9) AS overlap_accuracy FROM scores""",
    "claim_recall": f"""WITH {EVAL_SQL},
        predicted_texts AS (SELECT case_id, lower(text) AS t FROM predicted_rows
          UNION ALL SELECT case_id, 'an unrelated extra claim.' FROM eval_cases WHERE answer_id % 4 = 0)
        SELECT case_id, CASE WHEN count(DISTINCT claim_index) = 0 THEN 1.0::DOUBLE
            ELSE count(DISTINCT claim_index) FILTER (contains(t, claim_key) OR contains(claim_key, t))::DOUBLE
                 / count(DISTINCT claim_index)::DOUBLE END AS claim_recall_simple
        FROM eval_cases LEFT JOIN expected_rows USING (case_id) LEFT JOIN predicted_texts USING (case_id) GROUP BY 1""",
    "citation_scores": f"""WITH {EVAL_SQL} SELECT case_id,
        CASE WHEN s = 0 THEN 1.0::DOUBLE ELSE ci::DOUBLE / s::DOUBLE END AS citation_coverage,
        concat_ws('|', CASE WHEN ci < s THEN (s - ci) || ' supported claim(s) missing citations' END,
          CASE WHEN es > 0 AND s = 0 THEN 'No supported claims found but expected some' END,
          CASE WHEN es > s THEN 'Missed ' || (es - s) || ' expected supported claims' END) AS issues
        FROM supported JOIN expected_supported USING (case_id)""",
    "risk_scores_by_case": f"""WITH {EVAL_SQL} SELECT case_id, expected_risk_level = risk_level AS risk_level_match,
        round({_DIFF}, 9) AS risk_score_diff, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE bad::DOUBLE / n::DOUBLE END AS hallucination_rate,
        concat_ws('|', CASE WHEN expected_risk_level <> risk_level THEN
            'Risk level mismatch: expected ' || expected_risk_level || ', got ' || risk_level END,
          CASE WHEN {_DIFF} > 0.3::DOUBLE THEN 'Risk score poorly calibrated: expected ~' ||
            CASE expected_risk_level WHEN 'LOW' THEN '0.15' WHEN 'MEDIUM' THEN '0.50' ELSE '0.85' END ||
            ', got ' || printf('%.2f', risk_score) || ' (diff: ' || printf('%.2f', {_DIFF}) || ')' END) AS issues
        FROM eval_cases JOIN supported USING (case_id)""",
    "metrics_by_class": f"WITH {LABELLED_SQL} SELECT * FROM metrics",
    "metrics_macro": f"WITH {LABELLED_SQL} SELECT round(avg(f1), 9) AS macro_f1 FROM metrics",
    "metrics_by_language": f"""WITH {LABELLED_SQL}, counts AS (
        SELECT lang, count(*) FILTER (truth = guess)::DOUBLE / count(*)::DOUBLE AS accuracy,
          count(*) FILTER (guess <> 'SUPPORTED')::DOUBLE / count(*)::DOUBLE AS hallucination_rate,
          count(*) FILTER (guess = 'SUPPORTED')::DOUBLE AS s, count(*) FILTER (guess = 'SUPPORTED' AND doc_id % 3 > 0)::DOUBLE AS ci,
          count(*) FILTER (truth = 'SUPPORTED')::DOUBLE AS e, count(*) FILTER (truth = guess AND truth = 'SUPPORTED')::DOUBLE AS b
        FROM labelled GROUP BY 1)
        SELECT lang, accuracy, hallucination_rate, CASE WHEN s = 0 THEN 1.0::DOUBLE ELSE least(ci / s, 1.0::DOUBLE) END AS coverage,
          CASE WHEN e = 0 AND s = 0 THEN 1.0::DOUBLE WHEN e = 0 OR s = 0 OR b = 0 THEN 0.0::DOUBLE
               ELSE 2 * (b / e) * (b / s) / ((b / e) + (b / s)) END AS extraction_f1 FROM counts""",
    "feedback_totals": f"""WITH {FEEDBACK_SQL}
        SELECT 'total' AS correction, count(*) AS n FROM feedback UNION ALL
        SELECT predicted_verdict || '→' || correct_verdict, count(*) FROM feedback
        WHERE predicted_verdict <> correct_verdict GROUP BY 1""",
    "feedback_corrections": f"""WITH {FEEDBACK_SQL} SELECT predicted_verdict, correct_verdict, count(*) AS n_corrections
        FROM feedback WHERE predicted_verdict <> correct_verdict GROUP BY 1, 2""",
    "rejected_answers": f"WITH {SUBMITTED_SQL} " + _rejected_sql("answer_id", "answers",
        _length_sql("question", "question", 5000), _length_sql("answer", "answer", 50000)),
    "rejected_prompts": _rejected_sql("doc_id", "documents", _length_sql("prompt", "text", 50000),
        _length_sql("system_prompt", "repeat(lang, (doc_id % 60 * 100)::INT)", 10000, 0, True)),
    "rejected_requests": f"WITH {ANSWERS_SQL} " + _rejected_sql("answer_id", "answers",
        _length_sql("question", "question", 5000), _length_sql("initial_answer", "answer", 50000),
        "CASE WHEN answer_id % 7 - 2 < 1 THEN 'max_iterations is less than 1' END"),
    "rejected_feedback": _rejected_sql("doc_id", "documents", "CASE WHEN doc_id % 9 - 2 < 0 THEN 'claim_index is negative' END",
        _length_sql("comment", "text", 2000, 0, True), "CASE WHEN doc_id % 4 = 3 THEN 'predicted_verdict is unknown' END"),
    "rejected_cases": f"WITH {ANSWERS_SQL}, {CLAIMS_SQL} " + _rejected_sql("'case_' || answer_id || '_turn'",
        "(SELECT a.*, (SELECT count(*) FROM claims c WHERE c.answer_id = a.answer_id) AS n FROM answers a)",
        "CASE WHEN coalesce(question, '') = '' THEN 'original_question is missing' END",
        "CASE WHEN n = 0 THEN 'no expected claim' END", "CASE WHEN n = 0 THEN 'no expected verdict' END",
        "CASE WHEN length(answer) % 3 = 0 THEN 'expected_risk_level is unknown' END"),
}
