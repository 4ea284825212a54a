"""Human corrections of verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def correction_counts(feedback: DataFrame) -> DataFrame:
    """Number of corrections per predicted and correct verdict where they differ."""
    return (
        feedback.where(F.col("predicted_verdict") != F.col("correct_verdict"))
        .groupBy("predicted_verdict", "correct_verdict")
        .agg(F.count(F.lit(1)).alias("n_corrections"))
    )


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """``correction, n``: one row per correction pair, and ``total`` for all rows.

    Equal pairs count in the total only.
    """
    pairs = feedback.groupBy("predicted_verdict", "correct_verdict").agg(F.count(F.lit(1)).alias("n"))
    pair = F.concat("predicted_verdict", F.lit("→"), "correct_verdict")
    differs = F.col("predicted_verdict") != F.col("correct_verdict")
    labelled = F.explode(F.array(F.lit("total"), F.when(differs, pair))).alias("correction")
    return (
        pairs.select("n", labelled)
        .where(F.col("correction").isNotNull())
        .groupBy("correction")
        .agg(F.sum("n").alias("n"))
    )
