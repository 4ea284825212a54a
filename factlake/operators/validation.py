"""Request limits as row checks.

Each check adds ``problems``, the reasons a row would be refused; ``split`` turns that
into the accepted and the refused rows.  The checks are cheap predicates, so the two
reads of the source push them down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factlake.functions import fixed_values as fv
from factlake.operators.rows import staged


def _length_problem(column: str, most: int, least: int = 1, optional: bool = False) -> Column:
    n = F.length(column)
    absent = F.lit(None) if optional else F.lit(f"{column} is missing")
    return (
        F.when(F.col(column).isNull(), absent)
        .when(n < least, f"{column} is shorter than {least}")
        .when(n > most, f"{column} is longer than {most}")
    )


def _with_problems(df: DataFrame, *problems: Column) -> DataFrame:
    return df.withColumn("problems", F.filter(F.array(*problems), lambda p: p.isNotNull()))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)``."""
    ok = F.size("problems") == 0
    return checked.where(ok).drop("problems"), checked.where(~ok)


def validate_answers(df: DataFrame) -> DataFrame:
    return _with_problems(
        df, _length_problem("question", fv.QUESTION_MAX), _length_problem("answer", fv.ANSWER_MAX)
    )


def validate_prompts(df: DataFrame) -> DataFrame:
    return _with_problems(
        df,
        _length_problem("prompt", fv.PROMPT_MAX),
        _length_problem("system_prompt", fv.SYSTEM_PROMPT_MAX, least=0, optional=True),
    )


def validate_ground_requests(df: DataFrame) -> DataFrame:
    return _with_problems(
        df,
        _length_problem("question", fv.QUESTION_MAX),
        _length_problem("initial_answer", fv.ANSWER_MAX),
        F.when(F.col("max_iterations") < 1, "max_iterations is less than 1"),
    )


def validate_feedback(df: DataFrame, check_verdicts: bool = False) -> DataFrame:
    """Verdicts are free text unless ``check_verdicts``."""
    problems = [
        F.when(F.col("claim_index").isNull(), "claim_index is missing").when(
            F.col("claim_index") < 0, "claim_index is negative"
        ),
        _length_problem("comment", fv.COMMENT_MAX, least=0, optional=True),
    ]
    if check_verdicts:
        problems += [
            F.when(~F.col(c).isin(fv.VERDICTS), f"{c} is unknown")
            for c in ("predicted_verdict", "correct_verdict")
        ]
    return _with_problems(df, *problems)


def validate_eval_cases(df: DataFrame) -> DataFrame:
    def unless(ok: Column, problem: str) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), problem)

    # Every check reads them: behind a stage they are worked out once a row, not once a check.
    df = staged(df, "expected_claims", "expected_verdicts").select(*[f"`{c}`" for c in df.columns])
    claims, verdicts = F.col("expected_claims"), F.col("expected_verdicts")
    return _with_problems(
        df,
        unless(F.rlike("case_id", F.lit(fv.CASE_ID)), "case_id has another shape"),
        unless(F.length("original_question") > 0, "original_question is missing"),
        unless(F.length("generated_answer") > 0, "generated_answer is missing"),
        unless(F.size(claims) > 0, "no expected claim"),
        unless(F.size(verdicts) > 0, "no expected verdict"),
        unless(F.col("expected_risk_level").isin(fv.RISK_LEVELS), "expected_risk_level is unknown"),
        unless(F.forall(claims, lambda c: c["claim_type"].isin(fv.CLAIM_TYPES)), "claim_type is unknown"),
        unless(F.forall(verdicts, lambda v: v["verdict"].isin(fv.VERDICTS)), "verdict is unknown"),
        unless(F.forall(verdicts, lambda v: v["confidence"].between(0.0, 1.0)), "confidence is out of range"),
    )
