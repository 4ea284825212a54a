"""Tables that are written and read back: the sources and sinks."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from factlake.operators.evidence import pair
from factlake.operators.claims import extract_claims
from factlake import schemas
from factlake.plans.benchmark import run_benchmark
from factlake.session import shared_folder
from factlake.sources import (
    append_feedback,
    read_eval_lines,
    read_evaluation,
    read_feedback,
    read_knowledge_base,
    read_table,
    write_eval_lines,
    write_evaluation,
)
from factlake.streaming import feedback_stream
from workloads.base import ANSWERS_SQL, CLAIMS_SQL, KB_SQL, answers, knowledge_base, streamed_table, table
from workloads.evaluation import EVAL_SQL, cases, predictions
from workloads.matching import RESULTS_SQL


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/factlake/{uuid.uuid4().hex}"


def stored_feedback(spark, sf) -> DataFrame:
    """Corrections appended in two goes; every stored row has a key and a time."""
    verdict = F.when(F.col("quality") == 1, "SUPPORTED").otherwise("NOT_ENOUGH_EVIDENCE")
    rows = table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("request_id"),
        (F.col("doc_id") % 7).cast("int").alias("claim_index"),
        verdict.alias("predicted_verdict"),
        F.when(F.col("toxic") == 1, "CONTRADICTED").otherwise(verdict).alias("correct_verdict"),
        F.when(F.col("doc_id") % 3 == 0, "checked").alias("comment"),
    )
    path = _folder(spark)
    append_feedback(rows.where("claim_index < 3"), path)
    append_feedback(rows.where("claim_index >= 3"), path)
    stored = read_feedback(spark, path).where("id IS NOT NULL AND created_at IS NOT NULL")
    return stored.drop("id", "created_at")


def streamed_appends(spark, sf) -> DataFrame:
    """Corrections that arrive as a stream, every one of them sent twice."""
    sent = streamed_table(spark, sf, "labels")
    verdict = F.when(F.col("quality") == 1, "SUPPORTED").otherwise("NOT_ENOUGH_EVIDENCE")
    rows = sent.select(
        F.col("doc_id").cast("string").alias("request_id"),
        (F.col("doc_id") % 7).cast("int").alias("claim_index"),
        verdict.alias("predicted_verdict"),
        F.when(F.col("toxic") == 1, "CONTRADICTED").otherwise(verdict).alias("correct_verdict"),
        F.when(F.col("doc_id") % 3 == 0, "checked").alias("comment"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") % 3000).alias("sent_at"),
    )
    path = _folder(spark)
    feedback_stream(rows.union(rows), f"{path}/table", f"{path}/checkpoint", "sent_at").awaitTermination()
    stored = read_feedback(spark, f"{path}/table")
    return stored.select(
        *[c for c in stored.columns if c not in ("id", "created_at")],
        F.unix_timestamp("created_at").alias("sent_at"),
        F.length("id").alias("key_length"),
    )


def evaluation_document(spark, sf) -> DataFrame:
    """The whole evaluation written as one JSON document, and its cases read back."""
    path = _folder(spark)
    run = run_benchmark(cases(spark, sf), predictions(spark, sf), "attempt")
    write_evaluation(run, path, "turns", "1")
    back = read_evaluation(spark, path, schemas.CASE_RESULTS)
    scores = [c for c in back.columns if c.startswith("verdict_")]
    return (
        back.withColumns({c: F.round(c, 9) for c in scores})
        .withColumn("failed_checks", F.array_join("failed_checks", "|"))
    )


def stored_cases(spark, sf) -> DataFrame:
    """Cases written as lines, some cut short or of another shape, and sorted out again."""
    path = _folder(spark)
    given = cases(spark, sf).withColumn("n", F.regexp_extract("case_id", "[0-9]+", 0).cast("long"))
    write_eval_lines(given.drop("n").where(F.col("n") % 13 > 1), path)
    line = F.to_json(F.struct(F.col("case_id").alias("id"), *given.drop("case_id", "n").columns))
    bad = F.when(F.col("n") % 13 == 0, F.left(line, F.length(line) - 9)).otherwise(
        F.regexp_replace(line, '^\\{"id":"[^"]*"', '{"id":["a","list"],"x":1')
    )
    given.where(F.col("n") % 13 <= 1).select(bad).write.mode("append").text(path)
    read = read_eval_lines(spark, path)
    accepted = read.cases.select("case_id", F.lit("").alias("problems"))
    rejected = read.rejected.select("case_id", F.array_join("problems", "|").alias("problems"))
    return accepted.unionAll(rejected).groupBy("problems").agg(
        F.count(F.lit(1)).alias("n"), F.count("case_id").alias("named")
    )


def stored_requests(spark, sf) -> DataFrame:
    """Answers, prompts, grounding requests and predictions, written and read as declared."""
    asked = answers(spark, sf)
    tables = {
        "answers": (asked, schemas.ANSWERS, "json"),
        "prompts": (
            asked.select(
                F.col("answer_id").alias("prompt_id"), F.col("answer").alias("prompt"), F.col("question").alias("system_prompt")
            ),
            schemas.PROMPTS,
            "parquet",
        ),
        "requests": (
            asked.withColumnRenamed("answer", "initial_answer").withColumn(
                "max_iterations", F.when(F.col("answer_id") % 4 == 0, F.lit(2))
            ),
            schemas.GROUND_REQUESTS,
            "json",
        ),
        "predictions": (predictions(spark, sf).where("attempt = 1").drop("attempt"), schemas.PREDICTIONS, "json"),
    }
    out = []
    for kind, (df, schema, file_format) in tables.items():
        path = _folder(spark)
        df.write.format(file_format).save(path)
        back = read_table(spark, path, schema, file_format)
        chars = {
            "answers": F.length("answer") + F.coalesce(F.length("question"), F.lit(0)) + F.greatest(F.size("trusted_sources"), F.lit(0)),
            "prompts": F.length("prompt") + F.coalesce(F.length("system_prompt"), F.lit(0)),
            "requests": F.length("initial_answer") + F.coalesce("max_iterations", F.lit(0)),
            "predictions": F.size("extracted_claims") * 100 + F.size("predicted_verdicts") + F.length("risk_level"),
        }[kind]
        out.append(back.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.sum(chars).alias("total")))
    return reduce(DataFrame.unionAll, out)


def stored_knowledge(spark, sf) -> DataFrame:
    """The knowledge base as JSON and as Parquet, read with its declared schema."""
    kb, parts = knowledge_base(spark, sf), []
    for kind in ("json", "parquet"):
        path = _folder(spark)
        kb.write.format(kind).save(path)
        back = read_knowledge_base(spark, path, kind)
        parts.append(
            back.groupBy("source").agg(
                F.lit(kind).alias("kind"),
                F.count(F.lit(1)).alias("n"),
                F.sum("kb_id").alias("ids"),
                F.sum(F.length("snippet")).alias("chars"),
                F.sum(F.size("keywords")).cast("bigint").alias("words"),
                F.count_if(F.col("source_credibility") > 0.92).alias("credible"),
                F.count_if(F.col("url") != "").alias("linked"),
            )
        )
    return parts[0].unionByName(parts[1])


def orphan_evidence(spark, sf) -> DataFrame:
    """Evidence for claims 0 to 29 of every answer; what names no claim falls out."""
    source = answers(spark, sf)
    numbers = F.explode(F.sequence(F.lit(0), F.lit(29))).alias("claim_index")
    evidence = source.select("answer_id", numbers).select(
        "*", (F.col("answer_id") * 100 + F.col("claim_index")).alias("kb_id")
    )
    return pair(extract_claims(source), evidence).groupBy("answer_id").agg(
        F.count("kb_id").alias("n"), F.sum("kb_id").alias("ids")
    )


QUERIES = {
    f.__name__: f
    for f in (stored_feedback, stored_knowledge, orphan_evidence, streamed_appends, evaluation_document, stored_cases, stored_requests)
}

ORACLES = {
    "stored_cases": f"""WITH {EVAL_SQL},
        told AS (SELECT c.answer_id, case_id, CASE WHEN c.answer_id % 13 = 0 THEN 'case is not readable' ELSE
            concat_ws('|', CASE WHEN c.answer_id % 13 = 1 THEN 'case_id has another shape' END, CASE WHEN coalesce(question, '') = '' THEN 'original_question is missing' END,
              CASE WHEN n = 0 THEN 'no expected claim' END, CASE WHEN n = 0 THEN 'no expected verdict' END) END AS problems
          FROM eval_cases c JOIN answers USING (answer_id)
            JOIN (SELECT answer_id, count(claim_index) AS n FROM answers LEFT JOIN claims USING (answer_id) GROUP BY 1) USING (answer_id))
        SELECT problems, count(*) AS n, count(*) FILTER (answer_id % 13 > 0) AS named FROM told GROUP BY 1""",
    "stored_requests": f"""WITH {EVAL_SQL}
        SELECT 'answers' AS kind, count(*) AS n,
          sum(length(answer) + coalesce(length(question), 0) + coalesce(len(trusted_sources), 0))::BIGINT AS total FROM answers
        UNION ALL SELECT 'prompts', count(*), sum(length(answer) + coalesce(length(question), 0))::BIGINT FROM answers
        UNION ALL SELECT 'requests', count(*), sum(length(answer) + CASE WHEN answer_id % 4 = 0 THEN 2 ELSE 0 END)::BIGINT FROM answers
        UNION ALL SELECT 'predictions', count(*), sum((coalesce(k, 0) + CASE WHEN answer_id % 4 = 0 THEN 1 ELSE 0 END) * 100
            + coalesce(k, 0) + length(risk_level))::BIGINT
          FROM eval_cases LEFT JOIN (SELECT case_id, count(*) AS k FROM predicted_rows GROUP BY 1) USING (case_id)""",
    "streamed_appends": """
        SELECT doc_id::VARCHAR AS request_id, (doc_id % 7)::INT AS claim_index,
               CASE WHEN quality = 1 THEN 'SUPPORTED' ELSE 'NOT_ENOUGH_EVIDENCE' END AS predicted_verdict,
               CASE WHEN toxic = 1 THEN 'CONTRADICTED' WHEN quality = 1 THEN 'SUPPORTED'
                    ELSE 'NOT_ENOUGH_EVIDENCE' END AS correct_verdict,
               CASE WHEN doc_id % 3 = 0 THEN 'checked' ELSE '' END AS comment,
               1700000000 + doc_id % 3000 AS sent_at, 64 AS key_length
        FROM labels""",
    "evaluation_document": f"""WITH RECURSIVE {EVAL_SQL}, {RESULTS_SQL}
        SELECT r.case_id, r.n_claims::INT AS n_claims, r.claim_accuracy, claim_precision, claim_recall, claim_f1,
          round(verdict_accuracy, 9) AS verdict_accuracy, round(verdict_precision, 9) AS verdict_precision,
          round(verdict_recall, 9) AS verdict_recall, round(verdict_f1, 9) AS verdict_f1, hallucination_rate,
          citation_coverage, risk_level_match, array_to_string(failed, '|') AS failed_checks
        FROM results r JOIN claim_scored USING (case_id)""",
    "stored_feedback": """
        SELECT doc_id::VARCHAR AS request_id, (doc_id % 7)::INT AS claim_index,
               CASE WHEN quality = 1 THEN 'SUPPORTED' ELSE 'NOT_ENOUGH_EVIDENCE' END AS predicted_verdict,
               CASE WHEN toxic = 1 THEN 'CONTRADICTED' WHEN quality = 1 THEN 'SUPPORTED'
                    ELSE 'NOT_ENOUGH_EVIDENCE' END AS correct_verdict,
               CASE WHEN doc_id % 3 = 0 THEN 'checked' ELSE '' END AS comment
        FROM labels""",
    "stored_knowledge": f"""WITH {KB_SQL}
        SELECT source, kind, count(*) AS n, sum(kb_id)::BIGINT AS ids,
               sum(length(snippet))::BIGINT AS chars, sum(len(keywords))::BIGINT AS words,
               count(*) FILTER (source_credibility > 0.92) AS credible,
               count(*) FILTER (url <> '') AS linked
        FROM kb, (VALUES ('json'), ('parquet')) kinds(kind) GROUP BY source, kind""",
    "orphan_evidence": f"""WITH {ANSWERS_SQL}, {CLAIMS_SQL}
        SELECT answer_id, count(*) AS n, sum(answer_id * 100 + claim_index)::BIGINT AS ids
        FROM claims GROUP BY answer_id""",
}
