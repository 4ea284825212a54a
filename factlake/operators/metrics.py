"""Classification and coverage metrics, from counts that combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factlake.functions import fixed_values as fv
from factlake.functions.numbers import ratio


def harmonic(a: Column, b: Column) -> Column:
    return F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(F.lit(0.0))


def class_metrics(df: DataFrame, truth: str, predicted: str, classes: list[str] = fv.VERDICTS) -> DataFrame:
    """``class, support, precision, recall, f1``, also for classes without support.

    One pass counts every class at once; a null prediction counts as a miss.
    """
    t, p = F.col(truth), F.col(predicted)
    counts = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("class"),
                    F.count_if((t == c) & (p == c)).alias("tp"),
                    F.count_if((t != c) & (p == c)).alias("fp"),
                    F.count_if((t == c) & ~F.equal_null(p, F.lit(c))).alias("fn"),
                )
                for c in classes
            ]
        ).alias("counts")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        counts.select(F.inline("counts"))
        .withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .select(
            "class",
            (tp + fn).alias("support"),
            "precision",
            "recall",
            harmonic(F.col("precision"), F.col("recall")).alias("f1"),
        )
    )


def macro_f1(metrics: DataFrame) -> DataFrame:
    """Unweighted mean of f1 over the classes of :func:`class_metrics`."""
    return metrics.agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))


def accuracy(truth: Column, predicted: Column) -> Column:
    """Share of equal pairs; also the match rate of risk levels.  0 without rows."""
    return ratio(F.count_if(F.equal_null(truth, predicted)), F.count(truth))


def hallucination_rate(verdict: Column) -> Column:
    """Share of verdicts that are contradicted or without evidence."""
    bad = verdict.isin(fv.CONTRADICTED, fv.NOT_ENOUGH_EVIDENCE)
    return ratio(F.count_if(bad), F.count(verdict))


def citation_coverage(supported: Column, cited: Column) -> Column:
    """Supported claims with a citation / supported claims; 1 if none is supported."""
    return F.least(ratio(cited, supported, empty=1.0), F.lit(1.0))


def claim_extraction_f1(expected: Column, extracted: Column, matched: Column) -> Column:
    """F1 of matched claims; 1 if nothing was expected nor extracted."""
    return (
        F.when((expected == 0) & (extracted == 0), F.lit(1.0))
        .when((expected == 0) | (extracted == 0), F.lit(0.0))
        .otherwise(harmonic(ratio(matched, expected), ratio(matched, extracted)))
    )
