"""Retrieval, ranking, alignment, verdicts, citations, risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factlake.functions.numeric import (
    extract_numbers,
    extract_years,
    numeric_conflict_detail,
)
from factlake.functions.similarity import cosine_tf, overlap_ratio
from factlake.functions.text import similarity_tokens
from factlake.operators.claims import extract_claims
from factlake.operators.evidence import (
    align_evidence,
    check_citations,
    pair,
    rank_evidence,
    with_alignment,
    with_evidence_index,
)
from factlake.operators.retrieval import (
    KnowledgeIndex,
    kb_idf,
    retrieve_evidence,
    score_entries,
)
from factlake.operators.claims import explode_claims, with_claims
from factlake.operators.verdicts import failed_claims, risk_scores
from factlake.plans.verify import Verification, verify_answers, verify_submissions
from factlake.session import materialized
from workloads.base import (
    ANSWERS_SQL,
    CLAIMS_SQL,
    KB_SQL,
    SUBMITTED_SQL,
    W,
    WS,
    answers,
    knowledge_base,
    sql_fixed2,
    sql_keywords,
    sql_raw_tokens,
    sql_round,
    sql_similarity_tokens,
    submitted,
)


def _claims(spark, sf) -> DataFrame:
    return explode_claims(with_claims(answers(spark, sf)), "trusted_sources")


def _index(spark, sf) -> KnowledgeIndex:
    return KnowledgeIndex.build(materialized(knowledge_base(spark, sf)))


def _pairs(spark, sf) -> DataFrame:
    claims = _claims(spark, sf)
    return pair(claims, retrieve_evidence(claims, _index(spark, sf)), "inner")


def _verified(spark, sf) -> Verification:
    return verify_answers(answers(spark, sf), _index(spark, sf))


def token_idf(spark, sf) -> DataFrame:
    return kb_idf(knowledge_base(spark, sf)).select("token", "df", F.round("idf", 9).alias("idf"))


def retrieved(spark, sf) -> DataFrame:
    return score_entries(_claims(spark, sf), _index(spark, sf))


def retrieved_after_additions(spark, sf) -> DataFrame:
    """The same from an index that got its entries in two goes."""
    kb = materialized(knowledge_base(spark, sf))
    first = F.col("kb_id") % 4 < 3
    index = KnowledgeIndex.build(kb.where(first)).add(kb.where(~first))
    return score_entries(_claims(spark, sf), index)


def ranked(spark, sf) -> DataFrame:
    return rank_evidence(_pairs(spark, sf)).select(
        "answer_id", "claim_index", "kb_id", F.round("relevance_score", 9).alias("relevance_score"), "rank"
    )


def alignment(spark, sf) -> DataFrame:
    return with_alignment(rank_evidence(_pairs(spark, sf))).select(
        "answer_id", "claim_index", "kb_id", "alignment", "contradiction", "aligned"
    )


def aligned_evidence(spark, sf) -> DataFrame:
    return with_evidence_index(align_evidence(rank_evidence(_pairs(spark, sf)))).select(
        "answer_id", "claim_index", "evidence_index", "kb_id", "source", "url"
    )


def citations(spark, sf) -> DataFrame:
    found = with_evidence_index(align_evidence(rank_evidence(_pairs(spark, sf))))
    return check_citations(found)


def similarities(spark, sf) -> DataFrame:
    left, right = similarity_tokens(F.col("claim")), similarity_tokens(F.col("snippet"))
    return (
        _pairs(spark, sf)
        .withColumn("l", left)
        .withColumn("r", right)
        .select(
            "answer_id",
            "claim_index",
            "kb_id",
            F.round(cosine_tf(F.col("l"), F.col("r")), 9).alias("cosine"),
            overlap_ratio(F.col("l"), F.col("r")).alias("overlap"),
        )
    )


def numeric_conflicts(spark, sf) -> DataFrame:
    claim, snippet = F.col("claim"), F.col("snippet")
    return (
        _pairs(spark, sf)
        .select(
            "answer_id",
            "claim_index",
            "kb_id",
            numeric_conflict_detail(
                extract_numbers(claim), extract_years(claim), extract_numbers(snippet), extract_years(snippet)
            ).alias("detail"),
        )
        .where(F.col("detail").isNotNull())
    )


def verdicts(spark, sf) -> DataFrame:
    return _verified(spark, sf).verdicts.select(
        "answer_id",
        "claim_index",
        "verdict",
        "confidence",
        F.round("best_similarity", 9).alias("best_similarity"),
        F.array_join(F.col("evidence_indices").cast("array<string>"), ",").alias("evidence_indices"),
        "reasoning",
    )


def risks(spark, sf) -> DataFrame:
    return _verified(spark, sf).risks


def submissions(spark, sf) -> DataFrame:
    """Answers as submitted: every one with its outcome, verified ones with their report."""
    done = verify_submissions(submitted(spark, sf), _index(spark, sf))
    reports = done.verification.reports.select("answer_id", "n_claims", "risk_level", "displayed_risk")
    return done.outcomes.join(reports, "answer_id", "left").withColumn(
        "problems", F.array_join("problems", "; ")
    )


def risk_levels(spark, sf) -> DataFrame:
    return (
        _verified(spark, sf)
        .risks.groupBy("risk_level")
        .agg(F.count(F.lit(1)).alias("n_answers"), F.sum("n_claims").alias("n_claims"))
    )


def failing_claims(spark, sf) -> DataFrame:
    found = _verified(spark, sf)
    out = failed_claims(found.verdicts, extract_claims(answers(spark, sf)))
    return out.select(
        "answer_id",
        F.array_join("contradicted", "|").alias("contradicted"),
        F.array_join("unsupported", "|").alias("unsupported"),
    )


def reports(spark, sf) -> DataFrame:
    """The nested reports, flattened again: one row per answer with the list sizes."""
    return _verified(spark, sf).reports.select(
        "answer_id",
        "n_claims",
        "risk_score",
        "risk_level",
        "summary",
        F.size("evidence").alias("n_evidence"),
        F.size("citations").alias("n_citations"),
        F.array_join(F.transform("verdicts", lambda v: v["verdict"]), ",").alias("verdicts"),
        F.array_join(F.transform("claims", lambda c: c["claim"]), "|").alias("claims"),
        F.array_join(
            F.transform("evidence", lambda e: e["kb_id"].cast("string")), ","
        ).alias("evidence"),
        F.array_join(
            F.transform("citations", lambda c: c["evidence_index"].cast("string")), ","
        ).alias("citations"),
        "displayed_risk",
    )


QUERIES = {
    "token_idf": token_idf,
    "retrieved": retrieved,
    "retrieved_after_additions": retrieved_after_additions,
    "ranked_evidence": ranked,
    "alignment": alignment,
    "aligned_evidence": aligned_evidence,
    "citations": citations,
    "similarities": similarities,
    "numeric_conflicts": numeric_conflicts,
    "verdicts": verdicts,
    "risks": risks,
    "submissions": submissions,
    "risk_levels": risk_levels,
    "failing_claims": failing_claims,
    "reports": reports,
}

# ---- SQL -----------------------------------------------------------------------------

IDF_SQL = """
idf AS (
  SELECT token, count(*) AS df, ln((SELECT count(*) FROM kb)::DOUBLE / (count(*) + 1)) + 1.0::DOUBLE AS idf
  FROM (SELECT unnest(keywords) AS token FROM kb) GROUP BY 1)"""

_SHARE = "0.7::DOUBLE * (shared::DOUBLE / total::DOUBLE) + 0.3::DOUBLE * coalesce(source_credibility, 0.5::DOUBLE)"

RETRIEVED_SQL = f"""
query_tokens AS (
  SELECT answer_id, claim_index, token, coalesce(round(idf * 1e12)::BIGINT, 1000000000000) AS weight
  FROM (SELECT answer_id, claim_index, unnest({sql_raw_tokens(
      "array_to_string(coalesce(trusted_sources, ['wikipedia', 'world-bank']), ' ') || ' ' || text")}) AS token
        FROM claims JOIN answers USING (answer_id)) LEFT JOIN idf USING (token)),
totals AS (SELECT answer_id, claim_index, sum(weight) AS total FROM query_tokens GROUP BY 1, 2),
candidates AS (
  SELECT answer_id, claim_index, kb_id, sum(weight) AS shared
  FROM query_tokens JOIN (SELECT kb_id, unnest(keywords) AS token FROM kb) USING (token)
  GROUP BY 1, 2, 3),
scored AS (
  SELECT answer_id, claim_index, kb_id, {sql_round(_SHARE, 4)} AS relevance_score
  FROM candidates JOIN totals USING (answer_id, claim_index) JOIN kb USING (kb_id)),
retrieved AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY answer_id, claim_index
      ORDER BY relevance_score DESC, kb_id)::INT AS kb_rank FROM scored) WHERE kb_rank <= 3),
pairs AS (
  SELECT r.*, text AS claim, source, snippet, url
  FROM retrieved r JOIN claims USING (answer_id, claim_index) JOIN kb USING (kb_id))"""

_CREDIBILITY = (
    "CASE lower(source) WHEN 'wikipedia' THEN 0.8 WHEN 'world-bank' THEN 0.95 WHEN 'imf' THEN 0.95 "
    "WHEN 'oecd' THEN 0.9 WHEN 'who' THEN 0.95 WHEN 'nih' THEN 0.95 WHEN 'pubmed' THEN 0.95 "
    "WHEN 'arxiv' THEN 0.85 WHEN 'news' THEN 0.6 WHEN 'blog' THEN 0.3 WHEN 'unknown' THEN 0.4 "
    "ELSE 0.5 END::DOUBLE"
)
RANKED_SQL = f"""
composite AS (
  SELECT * EXCLUDE (relevance_score), relevance_score AS base,
    least(0.4::DOUBLE * relevance_score + 0.3::DOUBLE * {_CREDIBILITY}
      + 0.2::DOUBLE * (len(list_intersect({sql_raw_tokens('claim')}, {sql_raw_tokens('snippet')}))::DOUBLE
                       / greatest(len({sql_raw_tokens('claim')}), 1)::DOUBLE)
      + 0.1::DOUBLE * CASE WHEN contains(url, '.gov') OR contains(url, '.edu') OR contains(url, '.org')
                           THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE) AS relevance_score
  FROM pairs),
ranked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY answer_id, claim_index
      ORDER BY relevance_score DESC, kb_rank)::INT AS rank FROM composite) WHERE rank <= 5)"""

_STRONG = "debunked|refuted|disproven|contradicts|inaccurate|misleading|myth|fabricated|false claim"
_WEAK = "false|incorrect|wrong|denied|disagrees|opposite"
_DOUBLE_NEG = f"(?:^|[^{W}])not[{WS}]+(?:false|incorrect|wrong|inaccurate|untrue|unfounded)(?:$|[^{W}])"


def _near(word: str) -> str:
    escaped = f"regexp_escape({word})"
    after = (
        f"regexp_matches(low, '(?:^|[^{W}])not(?:[^{W}\\n].{{0,19}}' || CASE WHEN regexp_matches({word}, '^[{W}]') "
        f"THEN ')' ELSE ')?' END || {escaped})"
    )
    before = (
        f"regexp_matches(low, {escaped} || CASE WHEN regexp_matches({word}, '[{W}]$') "
        f"THEN '(?:.{{0,19}}[^{W}\\n])' ELSE '(?:.{{0,19}}[^{W}\\n])?' END || 'not(?:$|[^{W}])')"
    )
    return f"({after} OR {before})"


ALIGNED_SQL = f"""
shared_words AS (
  SELECT *, lower(snippet) AS low,
         list_intersect({sql_raw_tokens('claim')}, {sql_raw_tokens('snippet')}) AS shared_tokens,
         len({sql_raw_tokens('claim')}) AS n_tokens FROM ranked),
near AS (
  SELECT DISTINCT answer_id, claim_index, kb_id FROM (
    SELECT answer_id, claim_index, kb_id, low, unnest(shared_tokens) AS word FROM shared_words
    WHERE len(shared_tokens) >= 2 AND contains(low, 'not')) WHERE {_near('word')}),
flagged AS (
  SELECT o.*, CASE WHEN n_tokens > 0 THEN len(shared_tokens)::DOUBLE / n_tokens::DOUBLE ELSE 0.0::DOUBLE END AS alignment,
    CASE WHEN len(shared_tokens) = 0 THEN false
         WHEN regexp_matches(low, '{_DOUBLE_NEG}') THEN false
         WHEN regexp_matches(low, '{_STRONG}') THEN true
         WHEN len(shared_tokens) < 2 THEN false
         WHEN regexp_matches(low, '{_WEAK}') THEN true
         ELSE n.kb_id IS NOT NULL END AS contradiction
  FROM shared_words o LEFT JOIN near n USING (answer_id, claim_index, kb_id)),
aligned AS (
  SELECT *, (row_number() OVER (PARTITION BY answer_id ORDER BY claim_index, rank) - 1)::INT AS evidence_index
  FROM flagged WHERE alignment >= CASE WHEN contradiction THEN 0.15::DOUBLE ELSE 0.25::DOUBLE END)"""

CITED_SQL = f"""
cited AS (
  SELECT answer_id, claim_index, evidence_index, source, url, {sql_round('relevance_score', 2)} AS confidence
  FROM aligned WHERE len({sql_keywords('claim')}) > 0 AND
    len(list_intersect({sql_keywords('claim')}, {sql_keywords('snippet')}))::DOUBLE
      / len({sql_keywords('claim')})::DOUBLE >= 0.2::DOUBLE)"""

NUMBER_PATTERN = (
    r"(?i)(\p{Nd}+(?:,\p{Nd}{3})*(?:\.\p{Nd}+)?)[" + WS + "]*"
    "(trillion|billion|million|thousand|hundred|percent|%|km|meters?|ft|feet|years?|days?)?"
)


def sql_numbers(x: str) -> str:
    found = [f"regexp_extract_all({x}, '{NUMBER_PATTERN}', {g})" for g in (0, 1, 2)]
    return (
        f"list_transform(list_zip({', '.join(found)}), lambda n: {{'raw': trim(n[1]), 'value': "
        "replace(n[2], ',', '')::DOUBLE * CASE lower(coalesce(n[3], '')) WHEN 'trillion' THEN 1e12::DOUBLE "
        "WHEN 'billion' THEN 1e9::DOUBLE WHEN 'million' THEN 1e6::DOUBLE WHEN 'thousand' THEN 1e3::DOUBLE "
        "WHEN 'hundred' THEN 1e2::DOUBLE ELSE 1.0::DOUBLE END})"
    )


def sql_first_year(x: str) -> str:
    return f"regexp_extract({x}, '(?:^|[^{W}])([12]\\p{{Nd}}{{3}})(?:$|[^{W}])', 1)"


def conflict_sql(source: str, keys: str) -> str:
    """``keys, detail`` of conflicting pairs of the relation's ``claim`` and ``snippet``."""
    return f"""
conflict_inputs AS (
  SELECT {keys}, {sql_first_year('claim')} AS cy, {sql_first_year('snippet')} AS ey,
         {sql_numbers('claim')} AS cn, {sql_numbers('snippet')} AS en FROM {source}),
conflict_pairs AS (
  SELECT {keys}, ci, ei, c, e FROM (
    SELECT {keys}, ci, c, unnest(en) AS e, generate_subscripts(en, 1) AS ei FROM (
      SELECT {keys}, en, unnest(cn) AS c, generate_subscripts(cn, 1) AS ci FROM conflict_inputs))
  WHERE c.value <> 0 AND e.value <> 0 AND abs(c.value - e.value) / greatest(c.value, e.value) > 0.15::DOUBLE),
conflict_first AS (
  SELECT {keys}, c, e FROM conflict_pairs
  QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY ci, ei) = 1),
conflicts AS (
  SELECT {keys}, CASE WHEN cy <> '' AND ey <> '' AND cy <> ey
      THEN 'Year mismatch: claim says ' || cy || ', evidence says ' || ey
      ELSE 'Numeric mismatch: claim ''' || c.raw || ''' vs evidence ''' || e.raw || ''' (difference > 15%)'
      END AS detail
  FROM conflict_inputs LEFT JOIN conflict_first USING ({keys})
  WHERE (cy <> '' AND ey <> '' AND cy <> ey) OR c.raw IS NOT NULL)"""


# Cosine over exploded term counts.
SIMILARITY_SQL = f"""
sim_tokens AS (
  SELECT answer_id, claim_index, kb_id, {sql_similarity_tokens('claim')} AS l,
         {sql_similarity_tokens('snippet')} AS r FROM SIM_SOURCE),
left_counts AS (SELECT answer_id, claim_index, kb_id, token, count(*) AS n
  FROM (SELECT answer_id, claim_index, kb_id, unnest(l) AS token FROM sim_tokens) GROUP BY ALL),
right_counts AS (SELECT answer_id, claim_index, kb_id, token, count(*) AS n
  FROM (SELECT answer_id, claim_index, kb_id, unnest(r) AS token FROM sim_tokens) GROUP BY ALL),
dots AS (SELECT answer_id, claim_index, kb_id, sum(a.n * b.n)::DOUBLE AS dot, count(*) AS shared
  FROM left_counts a JOIN right_counts b USING (answer_id, claim_index, kb_id, token) GROUP BY ALL),
left_norms AS (SELECT answer_id, claim_index, kb_id, sqrt(sum(n * n)::DOUBLE) AS lnorm, count(*) AS n_left
  FROM left_counts GROUP BY ALL),
right_norms AS (SELECT answer_id, claim_index, kb_id, sqrt(sum(n * n)::DOUBLE) AS rnorm FROM right_counts GROUP BY ALL),
alike AS (
  SELECT answer_id, claim_index, kb_id,
         CASE WHEN dot IS NULL THEN 0.0::DOUBLE ELSE least(dot / (lnorm * rnorm), 1.0::DOUBLE) END AS cosine,
         coalesce(shared::DOUBLE / n_left::DOUBLE, 0.0::DOUBLE) AS overlap
  FROM sim_tokens LEFT JOIN dots USING (answer_id, claim_index, kb_id)
    LEFT JOIN left_norms USING (answer_id, claim_index, kb_id)
    LEFT JOIN right_norms USING (answer_id, claim_index, kb_id))"""

VERDICTS_SQL = f"""
{SIMILARITY_SQL.replace('SIM_SOURCE', 'aligned')},
signals AS (
  SELECT a.answer_id, a.claim_index, evidence_index, source, snippet, claim,
    greatest(cosine, overlap) AS similarity,
    len({sql_keywords('claim')}) > 0 AS has_keywords,
    regexp_matches(lower(snippet), 'debunked|refuted|disproven|contradicts|inaccurate|misleading|myth|fabricated|denied|false|incorrect')
      AND len(list_intersect({sql_keywords('claim')}, {sql_keywords('snippet')})) > 0 AS denied
  FROM aligned a JOIN alike USING (answer_id, claim_index, kb_id)),
best AS (
  SELECT * FROM signals WHERE similarity > 0
  QUALIFY row_number() OVER (PARTITION BY answer_id, claim_index ORDER BY similarity DESC, evidence_index) = 1),
{conflict_sql('best', 'answer_id, claim_index')},
grouped AS (
  SELECT answer_id, claim_index, bool_or(has_keywords) AS has_keywords, bool_or(denied) AS denied,
         max(similarity) AS top FROM signals GROUP BY ALL),
judged AS (
  SELECT c.answer_id, c.claim_index, c.text,
    coalesce(g.has_keywords, false) AS checked, coalesce(g.denied, false) AS denied,
    CASE WHEN g.has_keywords THEN top ELSE 0.0::DOUBLE END AS best_similarity,
    b.evidence_index, b.source, b.snippet, f.detail
  FROM claims c LEFT JOIN grouped g USING (answer_id, claim_index)
    LEFT JOIN best b USING (answer_id, claim_index)
    LEFT JOIN conflicts f USING (answer_id, claim_index)),
first_verdicts AS (
  SELECT *, CASE WHEN NOT checked THEN 'NOT_ENOUGH_EVIDENCE' WHEN denied THEN 'CONTRADICTED'
                 WHEN best_similarity >= 0.3::DOUBLE THEN 'SUPPORTED' ELSE 'NOT_ENOUGH_EVIDENCE' END AS fv FROM judged),
final_verdicts AS (
  SELECT answer_id, claim_index, text,
    CASE WHEN fv = 'SUPPORTED' AND detail IS NOT NULL THEN 'CONTRADICTED' ELSE fv END AS verdict,
    CASE WHEN fv = 'SUPPORTED' AND detail IS NOT NULL THEN least(best_similarity + 0.1::DOUBLE, 1.0::DOUBLE)
         WHEN fv = 'CONTRADICTED' THEN least(best_similarity + 0.2::DOUBLE, 1.0::DOUBLE)
         ELSE best_similarity END AS raw_confidence,
    coalesce(best_similarity, 0.0::DOUBLE) AS best_similarity,
    CASE WHEN checked AND evidence_index IS NOT NULL THEN evidence_index::VARCHAR ELSE '' END AS evidence_indices,
    CASE WHEN NOT checked THEN 'No evidence found or no keywords could be extracted.'
         WHEN fv = 'SUPPORTED' AND detail IS NOT NULL
           THEN 'Topic-level evidence found but numeric conflict detected: ' || detail
         WHEN fv = 'CONTRADICTED' AND source IS NOT NULL
           THEN 'Evidence from ''' || source || ''' contains contradiction signals: "' || left(snippet, 100) || '…"'
         WHEN fv = 'CONTRADICTED' THEN 'Evidence contains contradiction signals alongside topic overlap.'
         WHEN fv = 'SUPPORTED' THEN 'Supported by ''' || source || ''' (similarity ' || {sql_fixed2('best_similarity')}
              || '): "' || left(snippet, 100) || '…"'
         ELSE 'Insufficient evidence (best similarity ' || {sql_fixed2('best_similarity')} ||
              ', threshold 0.30). The claim could not be confirmed or contradicted by the available evidence.'
    END AS reasoning
  FROM first_verdicts)"""

RISKS_SQL = f"""
counts AS (
  SELECT answer_id, count(*)::INT AS n_claims, (count(*) FILTER (verdict = 'SUPPORTED'))::INT AS n_supported,
    (count(*) FILTER (verdict = 'CONTRADICTED'))::INT AS n_contradicted,
    (count(*) FILTER (verdict = 'NOT_ENOUGH_EVIDENCE'))::INT AS n_unsupported,
    avg(CASE verdict WHEN 'CONTRADICTED' THEN 1.0 WHEN 'NOT_ENOUGH_EVIDENCE' THEN 0.5 ELSE 0.0 END::DOUBLE) AS risk_score
  FROM final_verdicts GROUP BY 1),
leveled AS (
  SELECT *, CASE WHEN risk_score <= 0.33::DOUBLE THEN 'LOW' WHEN risk_score <= 0.66::DOUBLE THEN 'MEDIUM' ELSE 'HIGH' END
    AS risk_level FROM counts),
risks AS (
  SELECT *, concat_ws('. ',
      CASE WHEN n_supported > 0 THEN n_supported || ' of ' || n_claims || ' claims are supported by evidence' END,
      CASE WHEN n_contradicted > 0 THEN n_contradicted || CASE n_contradicted WHEN 1 THEN ' claim' ELSE ' claims' END
           || ' contradict evidence' END,
      CASE WHEN n_unsupported > 0 THEN n_unsupported || CASE n_unsupported WHEN 1 THEN ' claim' ELSE ' claims' END
           || ' lack sufficient evidence' END)
      || '. Overall hallucination risk is ' || risk_level || ' (score: ' || {sql_fixed2('risk_score')} || ').' AS summary
  FROM leveled)"""

_TO_KB = f"WITH {KB_SQL}"
_TO_RETRIEVED = f"WITH {ANSWERS_SQL}, {CLAIMS_SQL}, {KB_SQL}, {IDF_SQL}, {RETRIEVED_SQL}"
_TO_RANKED = f"{_TO_RETRIEVED}, {RANKED_SQL}"
_TO_ALIGNED = f"{_TO_RANKED}, {ALIGNED_SQL}"
_TO_VERDICTS = f"{_TO_ALIGNED}, {VERDICTS_SQL}"
_TO_RISKS = f"{_TO_VERDICTS}, {RISKS_SQL}"


def _limit_sql(column: str, most: int) -> str:
    return (
        f"CASE WHEN {column} IS NULL THEN '{column} is missing' WHEN length({column}) < 1 THEN '{column} is shorter than 1' "
        f"WHEN length({column}) > {most} THEN '{column} is longer than {most}' END"
    )


_CHECKED_SQL = SUBMITTED_SQL.replace("\nanswers AS (", "\nsubmitted AS (") + f""",
checked AS (SELECT *, concat_ws('; ', {_limit_sql('question', 5000)}, {_limit_sql('answer', 50000)}) AS problems FROM submitted),
answers AS (SELECT * FROM checked WHERE problems = '')"""

ORACLES = {
    "token_idf": f"{_TO_KB}, {IDF_SQL} SELECT token, df, round(idf, 9) AS idf FROM idf",
    "retrieved": f"{_TO_RETRIEVED} SELECT answer_id, claim_index, kb_id, relevance_score, kb_rank FROM retrieved",
    "retrieved_after_additions": f"""{_TO_RETRIEVED}
        SELECT answer_id, claim_index, kb_id, relevance_score, kb_rank FROM retrieved""",
    "ranked_evidence": f"""{_TO_RANKED}
        SELECT answer_id, claim_index, kb_id, round(relevance_score, 9) AS relevance_score, rank FROM ranked""",
    "alignment": f"""{_TO_ALIGNED}
        SELECT answer_id, claim_index, kb_id, alignment, contradiction,
               alignment >= CASE WHEN contradiction THEN 0.15::DOUBLE ELSE 0.25::DOUBLE END AS aligned FROM flagged""",
    "aligned_evidence": f"""{_TO_ALIGNED}
        SELECT answer_id, claim_index, evidence_index, kb_id, source, url FROM aligned""",
    "citations": f"{_TO_ALIGNED}, {CITED_SQL} SELECT * FROM cited",
    "similarities": f"""{_TO_RETRIEVED}, {SIMILARITY_SQL.replace('SIM_SOURCE', 'pairs')}
        SELECT answer_id, claim_index, kb_id, round(cosine, 9) AS cosine, overlap FROM alike""",
    "numeric_conflicts": f"""{_TO_RETRIEVED}, {conflict_sql('pairs', 'answer_id, claim_index, kb_id')}
        SELECT * FROM conflicts""",
    "verdicts": f"""{_TO_VERDICTS}
        SELECT answer_id, claim_index, verdict, {sql_round('raw_confidence', 2)} AS confidence,
               round(best_similarity, 9) AS best_similarity, evidence_indices, reasoning FROM final_verdicts""",
    "risks": f"""{_TO_RISKS} SELECT * FROM risks""",
    "submissions": f"""{_TO_RISKS.replace(ANSWERS_SQL, _CHECKED_SQL)}
        SELECT c.answer_id, problems, n_claims, risk_level, {sql_round('risk_score', 2)} AS displayed_risk,
               CASE WHEN problems <> '' THEN 'REJECTED' WHEN n_claims IS NULL THEN 'NO_CLAIMS' ELSE 'VERIFIED' END AS status
        FROM checked c LEFT JOIN risks r USING (answer_id)""",
    "risk_levels": f"""{_TO_RISKS}
        SELECT risk_level, count(*) AS n_answers, sum(n_claims)::BIGINT AS n_claims FROM risks GROUP BY 1""",
    "failing_claims": f"""{_TO_VERDICTS}
        SELECT answer_id,
          coalesce(string_agg(text, '|' ORDER BY claim_index) FILTER (verdict = 'CONTRADICTED'), '') AS contradicted,
          coalesce(string_agg(text, '|' ORDER BY claim_index) FILTER (verdict = 'NOT_ENOUGH_EVIDENCE'), '') AS unsupported
        FROM final_verdicts GROUP BY 1""",
    "reports": f"""{_TO_RISKS}, {CITED_SQL}
        SELECT r.answer_id, r.n_claims, risk_score, risk_level, summary,
          coalesce(n_evidence, 0)::INT AS n_evidence, coalesce(n_citations, 0)::INT AS n_citations,
          v.verdicts, v.claims, coalesce(e.evidence, '') AS evidence, coalesce(t.citations, '') AS citations,
          {sql_round('risk_score', 2)} AS displayed_risk
        FROM risks r
        JOIN (SELECT answer_id, string_agg(verdict, ',' ORDER BY claim_index) AS verdicts,
                     string_agg(text, '|' ORDER BY claim_index) AS claims FROM final_verdicts GROUP BY 1) v USING (answer_id)
        LEFT JOIN (SELECT answer_id, count(*) AS n_evidence,
                     string_agg(kb_id::VARCHAR, ',' ORDER BY evidence_index) AS evidence FROM aligned GROUP BY 1) e USING (answer_id)
        LEFT JOIN (SELECT answer_id, count(*) AS n_citations,
                     string_agg(evidence_index::VARCHAR, ',' ORDER BY evidence_index) AS citations FROM cited GROUP BY 1) t USING (answer_id)""",
}
