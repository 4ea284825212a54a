"""Declared table schemas, as DDL."""

from __future__ import annotations


ANSWERS = (
    "answer_id BIGINT, question STRING, answer STRING, trusted_sources ARRAY<STRING>"
)
CLAIMS = (
    "answer_id BIGINT, claim_index INT, text STRING, claim_type STRING, "
    "confidence DOUBLE, start_index INT, end_index INT"
)
KNOWLEDGE = (
    "kb_id BIGINT, source STRING, source_credibility DOUBLE, snippet STRING, "
    "url STRING, keywords ARRAY<STRING>"
)
EVIDENCE = (
    "answer_id BIGINT, claim_index INT, evidence_index INT, kb_id BIGINT, "
    "source STRING, snippet STRING, url STRING, relevance_score DOUBLE"
)
PROMPTS = ("prompt_id BIGINT, prompt STRING, system_prompt STRING")
GROUND_REQUESTS = (
    "answer_id BIGINT, question STRING, initial_answer STRING, "
    "trusted_sources ARRAY<STRING>, max_iterations INT"
)
EXPECTED_CLAIM = "STRUCT<text: STRING, claim_type: STRING>"
EXPECTED_VERDICT = (
    "STRUCT<claim_text: STRING, verdict: STRING, confidence: DOUBLE, reasoning: STRING>"
)
EVAL_CASE = (
    "STRUCT<id: STRING, original_question: STRING, generated_answer: STRING, "
    f"expected_claims: ARRAY<{EXPECTED_CLAIM}>, "
    f"expected_verdicts: ARRAY<{EXPECTED_VERDICT}>, "
    "trusted_reference_evidence: ARRAY<STRING>, expected_risk_level: STRING, "
    "notes: STRING>"
)
EVAL_DATASET = (
    f"name STRING, version STRING, description STRING, cases ARRAY<{EVAL_CASE}>"
)
PREDICTED_CLAIM = "STRUCT<text: STRING, claim_type: STRING, confidence: DOUBLE>"
PREDICTED_VERDICT = (
    "STRUCT<claim_text: STRING, verdict: STRING, confidence: DOUBLE, "
    "evidence_indices: ARRAY<INT>, reasoning: STRING>"
)
PREDICTIONS = (
    f"case_id STRING, extracted_claims ARRAY<{PREDICTED_CLAIM}>, "
    f"predicted_verdicts ARRAY<{PREDICTED_VERDICT}>, risk_score DOUBLE, "
    "risk_level STRING, citations ARRAY<STRING>, processing_time_ms INT"
)
FEEDBACK = (
    "id STRING, request_id STRING, claim_index INT, predicted_verdict STRING, "
    "correct_verdict STRING, comment STRING, created_at TIMESTAMP"
)
CASE_RESULTS = (
    "case_id STRING, n_claims INT, claim_accuracy DOUBLE, claim_precision DOUBLE, claim_recall DOUBLE, "
    "claim_f1 DOUBLE, verdict_accuracy DOUBLE, verdict_precision DOUBLE, verdict_recall DOUBLE, "
    "verdict_f1 DOUBLE, hallucination_rate DOUBLE, citation_coverage DOUBLE, risk_level_match BOOLEAN, "
    "failed_checks ARRAY<STRING>"
)
