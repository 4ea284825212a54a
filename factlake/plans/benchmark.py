"""Predictions against labelled cases: the whole evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from factlake.operators.evaluation import (
    benchmark_summary,
    case_report,
    case_results,
    failed_checks,
)


@dataclass(frozen=True)
class Benchmark:
    results: DataFrame

    @property
    def summary(self) -> DataFrame:
        return benchmark_summary(self.results)

    @property
    def report(self) -> DataFrame:
        return case_report(self.results)

    @property
    def failures(self) -> DataFrame:
        return failed_checks(self.results)


def run_benchmark(cases: DataFrame, predictions: DataFrame, order: str) -> Benchmark:
    """``order``: the column of ``predictions`` by which a case's first one counts."""
    return Benchmark(case_results(cases, predictions, order))
