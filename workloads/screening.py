"""Screening of documents and user turns as prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factlake.functions import fixed_values as fv
from factlake.functions.pii import pii_spans
from factlake.operators.rows import unnest
from factlake.operators.screening import screen_level, worst_level
from factlake.plans.screen import (
    ScreenOptions,
    detect_injection,
    detect_toxicity,
    restore_pii,
    screen_prompts,
    scrub_pii,
)
from workloads.base import PROMPT_ENDINGS, W, WS, pick, sql_pick, sql_round, table


def prompts(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("prompt_id"),
        F.concat("text", pick(PROMPT_ENDINGS, F.col("doc_id"))).alias("prompt"),
    )
    turns = table(spark, sf, "conversations").where(F.col("role") == "user")
    turn_id = F.col("conv_id") * 1000 + F.col("turn")
    return docs.unionByName(
        turns.select(
            (turn_id + 10000000).alias("prompt_id"),
            F.concat("text", pick(PROMPT_ENDINGS, turn_id)).alias("prompt"),
        )
    )


PROMPTS_SQL = f"""
prompts AS (
  SELECT doc_id AS prompt_id, text || {sql_pick(PROMPT_ENDINGS, 'doc_id')} AS prompt FROM documents
  UNION ALL
  SELECT conv_id * 1000 + turn + 10000000, text || {sql_pick(PROMPT_ENDINGS, '(conv_id * 1000 + turn)')}
  FROM conversations WHERE role = 'user')"""


def _flat(df: DataFrame, name: str) -> DataFrame:
    return df.select(
        "prompt_id",
        F.col(f"{name}.flag").alias("flag"),
        F.col(f"{name}.score").alias("score"),
        F.array_join(f"{name}.names", ",").alias("names"),
        F.col(f"{name}.risk_level").alias("risk_level"),
    )


def toxicity(spark, sf) -> DataFrame:
    return _flat(detect_toxicity(prompts(spark, sf), "prompt"), "toxicity")


def injection(spark, sf) -> DataFrame:
    return _flat(detect_injection(prompts(spark, sf), "prompt"), "injection")


def personal_data(spark, sf) -> DataFrame:
    found = prompts(spark, sf).select("prompt_id", pii_spans(F.col("prompt")).alias("spans"))
    return unnest(found, "spans", "prompt_id").select("prompt_id", "item.*")


def sanitized(spark, sf) -> DataFrame:
    return scrub_pii(prompts(spark, sf), "prompt").select(
        "prompt_id",
        F.md5("sanitized").alias("digest"),
        F.length("sanitized").alias("n_chars"),
        F.array_join(F.transform("spans", lambda s: s["placeholder"]), ",").alias("placeholders"),
    )


def screened(spark, sf) -> DataFrame:
    results, _, _ = screen_prompts(prompts(spark, sf))
    return results.select(
        "prompt_id",
        "overall_risk",
        "blocked",
        F.coalesce("block_reason", F.lit("")).alias("block_reason"),
        "pii_count",
        F.col("injection.score").alias("injection_score"),
        F.col("toxicity.score").alias("toxicity_score"),
        "original_length",
        "sanitized_length",
    )


def screened_by_risk(spark, sf) -> DataFrame:
    results, _, _ = screen_prompts(prompts(spark, sf))
    return results.groupBy("overall_risk", "blocked").agg(
        F.count(F.lit(1)).alias("n_prompts"),
        F.sum("pii_count").alias("n_pii"),
        F.sum("sanitized_length").alias("n_chars"),
    )


def screened_without_gates(spark, sf) -> DataFrame:
    """Injection check off, toxicity threshold above every score: nothing is blocked."""
    options = ScreenOptions(check_injection=False, toxicity_threshold=1.1)
    results, _, _ = screen_prompts(prompts(spark, sf), options)
    return results.groupBy("overall_risk", "blocked").agg(
        F.count(F.lit(1)).alias("n_prompts"), F.sum("pii_count").alias("n_pii")
    )


def restored_prompts(spark, sf) -> DataFrame:
    """Scrub, then restore: every prompt that is not blocked comes back unchanged."""
    source = prompts(spark, sf)
    results, vault, _ = screen_prompts(source)
    back = restore_pii(
        results.where(~F.col("blocked")).select("prompt_id", F.col("sanitized").alias("response")), vault
    )
    return back.select("prompt_id", F.md5("response").alias("digest"))


def risk_scale(spark, sf) -> DataFrame:
    """Both levels of every document's score pair, and the worse of the two."""
    left = (F.col("doc_id") % 101).cast("double") / 100
    right = (F.col("n_chars") % 101).cast("double") / 100
    return (
        table(spark, sf, "documents")
        .select("doc_id", screen_level(left).alias("left_level"), screen_level(right).alias("right_level"))
        .withColumn("overall", worst_level(F.col("left_level"), F.col("right_level")))
    )


QUERIES = {
    "toxicity": toxicity,
    "injection": injection,
    "personal_data": personal_data,
    "sanitized": sanitized,
    "screened": screened,
    "screened_by_risk": screened_by_risk,
    "screened_without_gates": screened_without_gates,
    "restored_prompts": restored_prompts,
    "risk_scale": risk_scale,
}

# ---- SQL -----------------------------------------------------------------------------


def _sql_pattern(pattern: str) -> str:
    """RE2 syntax; ``\\b`` only stands at the ends of the toxicity patterns."""
    body = pattern.replace(r"\s", f"[{WS}]").replace("'", "''")
    if body.startswith(r"\b"):
        body = f"(?:^|[^{W}]){body[2:-2]}(?:$|[^{W}])"
    return f"(?i){body}"


def _rules_sql(rules, text: str, cte: str) -> str:
    names = ", ".join(
        f"CASE WHEN regexp_matches({text}, '{_sql_pattern(p)}') THEN '{n}' END" for n, p, _ in rules
    )
    weights = "CASE r " + " ".join(f"WHEN '{n}' THEN {w}::DOUBLE" for n, _, w in rules) + " END"
    return f"""
{cte}_names AS (SELECT prompt_id, list_filter([{names}], lambda r: r IS NOT NULL) AS names FROM prompts),
{cte}_scores AS (
  SELECT *, CASE len(names) WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN top
         ELSE least(top + 0.05::DOUBLE * (len(names) - 1)::DOUBLE, 1.0::DOUBLE) END AS raw
  FROM (SELECT *, list_max(list_transform(names, lambda r: {weights})) AS top FROM {cte}_names)),
{cte} AS (
  SELECT prompt_id, names, len(names) > 0 AND raw >= 0.7::DOUBLE AS flag, {sql_round('raw', 2)} AS score
  FROM {cte}_scores)"""


def _level(x: str) -> str:
    return (
        f"CASE WHEN {x} >= 0.9::DOUBLE THEN 'BLOCKED' WHEN {x} >= 0.7::DOUBLE THEN 'HIGH' "
        f"WHEN {x} >= 0.4::DOUBLE THEN 'MEDIUM' WHEN {x} >= 0.1::DOUBLE THEN 'LOW' ELSE 'SAFE' END"
    )


def _worst(a: str, b: str) -> str:
    order = "['SAFE', 'LOW', 'MEDIUM', 'HIGH', 'BLOCKED']"
    return f"{order}[greatest(list_position({order}, {a}), list_position({order}, {b}))]"


TOXICITY_SQL = _rules_sql(fv.TOXICITY_RULES, "prompt", "toxic")
INJECTION_SQL = _rules_sql(fv.INJECTION_RULES, "prompt", "injected")


def _pii_sql() -> str:
    """Matches per type with offsets, then one anti-join per type in priority order."""
    ctes, accepted = [], None
    for i, (pii_type, pattern) in enumerate(fv.PII_PATTERNS.items()):
        flag = "(?i)" if pii_type in fv.PII_IGNORE_CASE else ""
        p = (flag + pattern).replace("'", "''")
        found = f"""
found{i} AS (
  SELECT prompt_id, v AS value, k, sum(length(g) + length(coalesce(lag_v, ''))) OVER
      (PARTITION BY prompt_id ORDER BY k)::INT AS start FROM (
    SELECT *, lag(v) OVER (PARTITION BY prompt_id ORDER BY k) AS lag_v FROM (
      SELECT prompt_id, unnest(vs) AS v, unnest(gs[1:len(vs)]) AS g, generate_subscripts(vs, 1) AS k FROM (
        SELECT prompt_id, regexp_extract_all(prompt, '{p}') AS vs,
               string_split(regexp_replace(prompt, '{p}', chr(1), 'g'), chr(1)) AS gs FROM prompts)))),
spans{i} AS (SELECT prompt_id, '{pii_type}' AS pii_type, value, start, (start + length(value))::INT AS "end"
  FROM found{i}{_LUHN if pii_type == 'credit_card' else ''})"""
        ctes.append(found)
        if accepted is None:
            ctes.append(f"\naccepted{i} AS (SELECT * FROM spans{i})")
        else:
            ctes.append(f"""
accepted{i} AS (SELECT * FROM {accepted} UNION ALL
  SELECT * FROM spans{i} s WHERE NOT EXISTS (SELECT 1 FROM {accepted} a WHERE a.prompt_id = s.prompt_id
    AND s.start < a."end" AND a.start < s."end"))""")
        accepted = f"accepted{i}"
    ctes.append(f"""
pii AS (SELECT *, '[' || upper(pii_type) || '_' || row_number() OVER (PARTITION BY prompt_id, pii_type ORDER BY start)
  || ']' AS placeholder FROM {accepted})""")
    return ",".join(ctes)


_DIGITS = "list_reverse(string_split(regexp_replace(value, '[^0-9]', '', 'g'), ''))"
_LUHN = (
    f" WHERE list_sum(list_transform({_DIGITS}, lambda d, i: CASE WHEN i % 2 = 1 THEN d::INT "
    "WHEN d::INT > 4 THEN d::INT * 2 - 9 ELSE d::INT * 2 END)) % 10 = 0"
)
PII_SQL = _pii_sql()
SCRUBBED_SQL = """
scrub_pieces AS (
  SELECT prompt_id, placeholder, start, substr(prompt, prev + 1, start - prev) AS gap FROM (
    SELECT p.prompt_id, prompt, placeholder, start,
           coalesce(lag("end") OVER (PARTITION BY p.prompt_id ORDER BY start), 0) AS prev
    FROM pii JOIN prompts p USING (prompt_id))),
scrubbed AS (
  SELECT p.prompt_id, coalesce(s.body || substr(prompt, s.last + 1), prompt) AS sanitized,
         coalesce(placeholders, '') AS placeholders, coalesce(n, 0) AS n_pii
  FROM prompts p LEFT JOIN (
    SELECT prompt_id, string_agg(gap || placeholder, '' ORDER BY start) AS body,
           string_agg(placeholder, ',' ORDER BY start) AS placeholders, count(*) AS n
    FROM scrub_pieces GROUP BY 1) b USING (prompt_id)
  LEFT JOIN (SELECT prompt_id, max("end") AS last, any_value(b2.body) AS body FROM pii JOIN (
    SELECT prompt_id, string_agg(gap || placeholder, '' ORDER BY start) AS body FROM scrub_pieces GROUP BY 1) b2
    USING (prompt_id) GROUP BY 1) s USING (prompt_id))"""
SCREENED_SQL = f"""
screened AS (
  SELECT p.prompt_id, t.flag OR i.flag AS blocked,
    CASE WHEN t.flag OR i.flag THEN 'BLOCKED' ELSE {_worst(_level('t.score'), _level('i.score'))} END AS overall_risk,
    CASE WHEN t.flag THEN 'Toxic content detected: ' || array_to_string(t.names, ', ')
         WHEN i.flag THEN 'Prompt injection detected: ' || array_to_string(i.names, ', ') ELSE '' END AS block_reason,
    CASE WHEN t.flag THEN 0.0::DOUBLE ELSE i.score END AS injection_score, t.score AS toxicity_score,
    CASE WHEN t.flag OR i.flag THEN 0 ELSE n_pii END::INT AS pii_count,
    length(prompt)::INT AS original_length,
    CASE WHEN t.flag OR i.flag THEN 0 ELSE length(sanitized) END::INT AS sanitized_length
  FROM prompts p JOIN toxic t USING (prompt_id) JOIN injected i USING (prompt_id) JOIN scrubbed s USING (prompt_id))"""

_PII = f"WITH {PROMPTS_SQL}, {PII_SQL}"
_ALL = f"{_PII}, {SCRUBBED_SQL}, {TOXICITY_SQL}, {INJECTION_SQL}, {SCREENED_SQL}"

ORACLES = {
    "toxicity": f"""WITH {PROMPTS_SQL}, {TOXICITY_SQL}
        SELECT prompt_id, flag, score, array_to_string(names, ',') AS names, {_level('score')} AS risk_level FROM toxic""",
    "injection": f"""WITH {PROMPTS_SQL}, {INJECTION_SQL}
        SELECT prompt_id, flag, score, array_to_string(names, ',') AS names, {_level('score')} AS risk_level FROM injected""",
    "personal_data": f"""{_PII} SELECT prompt_id, pii_type, value, start, "end" FROM pii""",
    "sanitized": f"""{_PII}, {SCRUBBED_SQL}
        SELECT prompt_id, md5(sanitized) AS digest, length(sanitized)::INT AS n_chars, placeholders FROM scrubbed""",
    "screened": f"""{_ALL} SELECT prompt_id, overall_risk, blocked, block_reason, pii_count, injection_score,
        toxicity_score, original_length, sanitized_length FROM screened""",
    "screened_by_risk": f"""{_ALL} SELECT overall_risk, blocked, count(*) AS n_prompts,
        sum(pii_count)::BIGINT AS n_pii, sum(sanitized_length)::BIGINT AS n_chars FROM screened GROUP BY 1, 2""",
    "screened_without_gates": f"""{_PII}, {SCRUBBED_SQL}, {TOXICITY_SQL}
        SELECT {_level('score')} AS overall_risk, false AS blocked, count(*) AS n_prompts, sum(n_pii)::BIGINT AS n_pii
        FROM toxic JOIN scrubbed USING (prompt_id) GROUP BY 1""",
    "restored_prompts": f"""WITH {PROMPTS_SQL}, {TOXICITY_SQL}, {INJECTION_SQL}
        SELECT prompt_id, md5(prompt) AS digest FROM prompts JOIN toxic t USING (prompt_id)
        JOIN injected i USING (prompt_id) WHERE NOT t.flag AND NOT i.flag""",
    "risk_scale": f"""SELECT *, {_worst('left_level', 'right_level')} AS overall FROM (
        SELECT doc_id, {_level('((doc_id % 101)::DOUBLE / 100.0::DOUBLE)')} AS left_level,
               {_level('((n_chars % 101)::DOUBLE / 100.0::DOUBLE)')} AS right_level FROM documents)""",
}
