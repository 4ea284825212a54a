"""SQL for the verify-correct loop: its three rounds written one after the other.

A round is the whole verification over the answers still open, so the chain of queries that
verifies answers is repeated with the round's number behind every name.
"""

from __future__ import annotations

import re

from factlake.functions import fixed_values as fv
from workloads.base import ANSWERS_SQL, CLAIMS_SQL, KB_SQL, sql_fixed2, sql_raw_tokens, sql_round, sql_text
from workloads.obfuscated import _GUARDS
from workloads.screening import _sql_pattern
from workloads.verification import (
    ALIGNED_SQL,
    IDF_SQL,
    RANKED_SQL,
    RETRIEVED_SQL,
    RISKS_SQL,
    VERDICTS_SQL,
)

_CHAIN = ",\n".join([CLAIMS_SQL, RETRIEVED_SQL, RANKED_SQL, ALIGNED_SQL, VERDICTS_SQL, RISKS_SQL])
_NAMES = ["answers", *re.findall(r"(?:^|,)\s*(\w+) AS \(", _CHAIN)]
_NAME = re.compile(rf"\b({'|'.join(sorted(set(_NAMES), key=len, reverse=True))})\b")


def _of_round(sql: str, number: int) -> str:
    """The chain's names with the round's number; texts between quotes stay."""
    parts = re.split(r"('(?:[^']|'')*')", sql)
    return "".join(p if k % 2 else _NAME.sub(rf"\1_{number}", p) for k, p in enumerate(parts))


def _filled(template: str, *values: str) -> str:
    parts = re.split("%[ds]", template)
    out = [sql_text(parts[0])]
    for value, part in zip(values, parts[1:]):
        out += [f"({value})", sql_text(part)]
    return " || ".join(out)


_GUARDED = " OR ".join(
    f"regexp_matches({text}, '{_sql_pattern(_GUARDS[n])}')"
    for n in fv.ANSWER_GUARD_RULES
    for text in ("answer", f"translate(answer, {sql_text(fv.INVISIBLE_CHARS)}, '')")
)
_A, _B = sql_raw_tokens("answer"), sql_raw_tokens("corrected")
_STUCK = (
    f"len({_A}) > 0 AND len({_B}) > 0 AND len(list_intersect({_A}, {_B}))::DOUBLE"
    f" / greatest(len({_A}), len({_B}), 1)::DOUBLE >= {fv.CONVERGENCE}::DOUBLE"
)


def _round(r: int) -> str:
    return f"""
answers_{r} AS (SELECT answer_id, question, answer, trusted_sources FROM asked_{r}),
{_of_round(_CHAIN, r)},
told_{r} AS (
  SELECT answer_id, count(*) FILTER (verdict = 'CONTRADICTED') AS n_contradicted,
    string_agg(text, ' ' ORDER BY claim_index) FILTER (verdict = 'SUPPORTED') AS supported
  FROM final_verdicts_{r} GROUP BY 1),
snippets_{r} AS (
  SELECT answer_id, snippet FROM aligned_{r}
  QUALIFY row_number() OVER (PARTITION BY answer_id ORDER BY relevance_score DESC, encode(snippet)) = 1),
verified_{r} AS (
  SELECT a.*, {r} AS iteration, risk_level, {sql_round('k.risk_score', 2)} AS risk_score,
    coalesce(told_{r}.n_contradicted, 0) AS n_contradicted, supported, snippet,
    CASE WHEN risk_level IS NULL THEN 'no_claims' WHEN risk_level = '{fv.ACCEPTABLE_RISK}' THEN 'verified'
         WHEN {r} >= coalesce(max_iterations, {fv.MAX_ROUNDS}) THEN 'max_retries_reached'
         WHEN {_GUARDED} THEN 'injection_detected' ELSE 'corrected' END AS action
  FROM asked_{r} a LEFT JOIN risks_{r} k USING (answer_id) LEFT JOIN told_{r} USING (answer_id)
    LEFT JOIN snippets_{r} USING (answer_id)),
corrected_{r} AS (
  SELECT *, {_STUCK} AS stuck FROM (
    SELECT *, coalesce(supported, snippet, answer) AS corrected FROM verified_{r} WHERE action = 'corrected')),
asked_{r + 1} AS (
  SELECT answer_id, question, corrected AS answer, trusted_sources, max_iterations FROM corrected_{r} WHERE NOT stuck)"""


_ROUNDS = range(1, fv.MAX_ROUNDS + 1)
_LOOP = f"""WITH {ANSWERS_SQL}, {KB_SQL}, {IDF_SQL},
asked_1 AS (
  SELECT answer_id, question, answer, trusted_sources, CASE WHEN answer_id % 4 = 0 THEN 2 END AS max_iterations
  FROM answers WHERE length(question) BETWEEN 1 AND 5000 AND length(answer) BETWEEN 1 AND 50000),
{','.join(map(_round, _ROUNDS))}"""

_CLOSED = " UNION ALL ".join(
    f"""SELECT answer_id, answer AS final_answer, risk_score, risk_level, iteration, action AS reason
        FROM verified_{r} WHERE action <> 'corrected' UNION ALL
        SELECT answer_id, corrected, risk_score, risk_level, iteration, 'converged' FROM corrected_{r} WHERE stuck"""
    for r in _ROUNDS
)
_RISK = sql_fixed2("risk_score")

ORACLES = {
    "grounded_answers": f"""{_LOOP}
        SELECT answer_id, final_answer, reason = 'verified' AS grounded, risk_score, risk_level,
          iteration AS total_iterations, reason AS exit_reason,
          CASE reason WHEN 'verified' THEN {_filled(fv.SUMMARY_VERIFIED, 'iteration', 'risk_level', _RISK)}
            WHEN 'max_retries_reached' THEN {_filled(fv.SUMMARY_MAX_ROUNDS, 'iteration', 'risk_level', _RISK)}
            WHEN 'injection_detected' THEN {_filled(fv.SUMMARY_INJECTION, 'iteration')}
            WHEN 'converged' THEN {_filled(fv.SUMMARY_CONVERGED, 'iteration', 'risk_level', _RISK)}
            ELSE {_filled(fv.SUMMARY_NO_CLAIMS, 'iteration')} END AS summary
        FROM ({_CLOSED})""",
    "grounding_rounds": f"""{_LOOP}
        SELECT iteration, action, risk_level, count(*) AS n_answers, sum(n_contradicted)::BIGINT AS n_contradicted
        FROM ({' UNION ALL '.join(f'SELECT iteration, action, risk_level, n_contradicted FROM verified_{r}' for r in _ROUNDS)})
        GROUP BY 1, 2, 3""",
}
QUERIES: dict = {}
