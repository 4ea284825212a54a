"""SQL for the evaluation: greedy one-to-one matching of claims as a recursive query.

A case's predicted claims are gone through in their order; each takes the best unused
expected claim. The recursion carries what is used so far, one row per case and step.
"""

from __future__ import annotations

from factlake.functions import fixed_values as fv
from workloads.base import sql_round, sql_text, sql_words
from workloads.evaluation import _DIFF, EVAL_SQL
from workloads.verification import _TO_RISKS, CITED_SQL


def _quoted(template: str, *values: str) -> str:
    """A text of the library with its values put in, as SQL."""
    parts = template.split("%s")
    out = [sql_text(parts[0])]
    for value, part in zip(values, parts[1:]):
        out += [f"({value})", sql_text(part)]
    return " || ".join(out)


_P = "p[k + 1]"
_SHARE = (
    f"len(list_intersect({sql_words(_P)}, {sql_words('x')}))::DOUBLE"
    f" / greatest(len({sql_words(_P)}), 1)::DOUBLE"
)
MATCHED_SQL = f"""
sides AS (
  SELECT c.case_id, coalesce(e.e, []) AS e,
    list_concat(coalesce(p.p, []), CASE WHEN answer_id % 4 = 0 THEN ['an unrelated extra claim.'] ELSE [] END) AS p
  FROM eval_cases c
  LEFT JOIN (SELECT case_id, list(lower(text) ORDER BY claim_index) AS e FROM expected_rows GROUP BY 1) e USING (case_id)
  LEFT JOIN (SELECT case_id, list(lower(text) ORDER BY claim_index) AS p FROM predicted_rows GROUP BY 1) p USING (case_id)),
greedy AS (
  SELECT case_id, 0 AS k, []::INT[] AS used FROM sides
  UNION ALL
  SELECT case_id, k + 1, CASE WHEN best.share > {fv.CLAIM_MATCH_MIN}::DOUBLE THEN list_append(used, -best.j) ELSE used END
  FROM (
    SELECT g.case_id, k, used, list_max(list_filter(list_transform(e, lambda x, i:
        CASE WHEN NOT list_contains(used, i::INT) AND (contains(x, {_P}) OR contains({_P}, x))
             THEN {{'share': {_SHARE}, 'j': -(i::INT)}} END), lambda c: c IS NOT NULL)) AS best
    FROM greedy g JOIN sides USING (case_id) WHERE k < len(p))),
claim_counts AS (
  SELECT case_id, len(e) AS n, len(p) AS m, len(used) AS tp FROM sides JOIN greedy USING (case_id) WHERE k = len(p)),
claim_ratios AS (
  SELECT *, CASE WHEN n = 0 AND m = 0 THEN 1.0::DOUBLE WHEN m > 0 THEN tp::DOUBLE / m::DOUBLE ELSE 0.0::DOUBLE END AS claim_precision,
    CASE WHEN n = 0 AND m = 0 THEN 1.0::DOUBLE WHEN n > 0 THEN tp::DOUBLE / n::DOUBLE ELSE 0.0::DOUBLE END AS claim_recall
  FROM claim_counts),
claim_scored AS (
  SELECT case_id, m AS n_claims, tp::INT AS n_matched, claim_recall AS claim_accuracy, claim_precision, claim_recall,
    CASE WHEN claim_precision + claim_recall > 0 THEN 2 * claim_precision * claim_recall / (claim_precision + claim_recall)
         ELSE 0.0::DOUBLE END AS claim_f1,
    list_filter([
      CASE WHEN n = 0 AND m = 0 THEN {sql_text(fv.ISSUE_NO_CLAIMS)} END,
      CASE WHEN m > tp THEN {_quoted(fv.ISSUE_EXTRA_CLAIMS, 'm - tp')} END,
      CASE WHEN n > tp THEN {_quoted(fv.ISSUE_MISSED_CLAIMS, 'n - tp')} END], lambda i: i IS NOT NULL) AS issues
  FROM claim_ratios)"""

_TARGET = "CASE expected_risk_level WHEN 'LOW' THEN '0.15' WHEN 'MEDIUM' THEN '0.50' ELSE '0.85' END"
_KEY = f"left(claim_key, {fv.ISSUE_CLAIM_CHARS})"
RESULTS_SQL = f"""
{MATCHED_SQL},
verdict_issues AS (
  SELECT case_id, list(CASE WHEN predicted IS NULL THEN {_quoted(fv.ISSUE_MISSING_PREDICTION, _KEY)}
                            ELSE {_quoted(fv.ISSUE_UNEXPECTED_PREDICTION, _KEY)} END ORDER BY encode(claim_key)) AS issues
  FROM matches WHERE predicted IS NULL OR expected IS NULL GROUP BY 1),
results AS (
  SELECT c.case_id, a.n_claims, claim_accuracy, verdict_accuracy, verdict_precision, verdict_recall, verdict_f1,
    CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE bad::DOUBLE / n::DOUBLE END AS hallucination_rate,
    CASE WHEN s = 0 THEN 1.0::DOUBLE ELSE ci::DOUBLE / s::DOUBLE END AS citation_coverage,
    expected_risk_level = risk_level AS risk_level_match,
    list_concat(a.issues,
      CASE WHEN v.issues = {sql_text(fv.ISSUE_NO_VERDICTS)} THEN [v.issues] ELSE coalesce(w.issues, []) END,
      list_filter([
        CASE WHEN expected_risk_level <> risk_level THEN {_quoted(fv.ISSUE_RISK_LEVEL, 'expected_risk_level', 'risk_level')} END,
        CASE WHEN {_DIFF} > 0.3::DOUBLE THEN
          {_quoted(fv.ISSUE_RISK_SCORE, _TARGET, "printf('%.2f', risk_score)", f"printf('%.2f', {_DIFF})")} END],
        lambda i: i IS NOT NULL)) AS failed
  FROM eval_cases c JOIN claim_scored a USING (case_id) JOIN scores v USING (case_id)
    JOIN supported USING (case_id) LEFT JOIN verdict_issues w USING (case_id)),
means AS (
  SELECT count(*) AS total_cases, sum(len(failed) + 1)::BIGINT AS total_claims_evaluated, sum(n_claims)::BIGINT AS n_claims,
    avg(claim_accuracy) AS mean_claim_accuracy, avg(verdict_accuracy) AS mean_verdict_accuracy,
    avg(verdict_precision) AS mean_verdict_precision, avg(verdict_recall) AS mean_verdict_recall,
    avg(verdict_f1) AS mean_verdict_f1, avg(hallucination_rate) AS mean_hallucination_rate,
    avg(citation_coverage) AS mean_citation_coverage, avg(risk_level_match::INT::DOUBLE) AS risk_level_match_rate,
    count(*) FILTER (len(failed) = 0) AS passed_cases, count(*) FILTER (len(failed) > 0) AS failed_cases,
    bool_or(len(list_filter(failed, lambda i: contains(i, 'missed'))) > 0) AS some_missed,
    bool_or(len(list_filter(failed, lambda i: contains(i, 'extra claims'))) > 0) AS some_extra
  FROM results)"""

_MEANS = (
    "claim_accuracy verdict_accuracy verdict_precision verdict_recall verdict_f1 hallucination_rate "
    "citation_coverage"
).split()
_ISSUES = "CASE WHEN len(failed) > 0 THEN array_to_string(failed, '; ') ELSE '✓' END"

ORACLES = {
    "claim_scores": f"""WITH RECURSIVE {EVAL_SQL}, {MATCHED_SQL}
        SELECT case_id, n_matched, claim_accuracy, claim_precision, claim_recall, claim_f1,
               array_to_string(issues, '|') AS issues FROM claim_scored""",
    "benchmark": f"""WITH RECURSIVE {EVAL_SQL}, {RESULTS_SQL}
        SELECT total_cases, total_claims_evaluated, n_claims, {', '.join(f'round(mean_{m}, 9) AS mean_{m}' for m in _MEANS)},
          round(risk_level_match_rate, 9) AS risk_level_match_rate, passed_cases, failed_cases,
          concat_ws('|', CASE WHEN mean_claim_accuracy < 0.8 THEN {sql_text(fv.ADVICE_CLAIMS)} END,
            CASE WHEN mean_verdict_f1 < 0.75 THEN {sql_text(fv.ADVICE_VERDICTS)} END,
            CASE WHEN mean_citation_coverage < 0.8 THEN {sql_text(fv.ADVICE_CITATIONS)} END,
            CASE WHEN risk_level_match_rate < 0.8 THEN {sql_text(fv.ADVICE_RISK)} END,
            CASE WHEN some_missed THEN {sql_text(fv.ADVICE_MISSED)} END,
            CASE WHEN some_extra THEN {sql_text(fv.ADVICE_EXTRA)} END) AS recommendations
        FROM means""",
    "benchmark_report": f"""WITH RECURSIVE {EVAL_SQL}, {RESULTS_SQL}
        SELECT case_id, claim_accuracy, round(verdict_accuracy, 9) AS verdict_accuracy, round(verdict_f1, 9) AS verdict_f1,
          hallucination_rate, citation_coverage, CASE WHEN risk_level_match THEN '✓' ELSE '✗' END AS risk_match,
          CASE WHEN length({_ISSUES}) > {fv.REPORT_ISSUE_CHARS} THEN left({_ISSUES}, {fv.REPORT_ISSUE_CHARS - 3}) || '...'
               ELSE {_ISSUES} END AS issues FROM results""",
    "benchmark_failures": f"""WITH RECURSIVE {EVAL_SQL}, {RESULTS_SQL}
        SELECT case_id, unnest(failed) AS issue, (generate_subscripts(failed, 1) - 1)::INT AS position FROM results""",
    "report_predictions": f"""{_TO_RISKS}, {CITED_SQL}
        SELECT 'case_' || answer_id AS case_id, n_claims, n_claims AS n_verdicts, {sql_round('risk_score', 2)} AS risk_score,
          risk_level, coalesce(citations, '') AS citations
        FROM risks LEFT JOIN (
          SELECT answer_id, string_agg(coalesce(nullif(url, ''), source), '|' ORDER BY evidence_index) AS citations
          FROM cited GROUP BY 1) USING (answer_id)""",
}
QUERIES: dict = {}
