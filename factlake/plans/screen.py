"""Prompts to screening results and a vault of the redacted values."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from factlake.functions import fixed_values as fv
from factlake.functions.deobfuscate import deobfuscated
from factlake.functions.pii import pii_spans, restored, scrubbed, vault_map, with_placeholders
from factlake.operators.rows import staged
from factlake.operators.screening import (
    injection_rules,
    result,
    screen_level,
    toxic_rules,
    with_score,
    without_score,
    worst_level,
)
from factlake.operators.validation import split

NAMED_SPANS = "array<struct<pii_type:string,value:string,start:int,end:int,placeholder:string>>"


@dataclass(frozen=True)
class ScreenOptions:
    """Which checks run, and the scores from which a prompt is blocked."""

    check_toxicity: bool = True
    check_injection: bool = True
    redact: bool = True
    toxicity_threshold: float = fv.RULE_THRESHOLD
    injection_threshold: float = fv.RULE_THRESHOLD


def _scored(df: DataFrame, check: str, rules: list, threshold: float) -> DataFrame:
    df = with_score(staged(df, f"{check}_names"), check, rules, threshold)
    return staged(df, f"{check}_flag", f"{check}_score")


def _toxicity_columns(df: DataFrame, text: str, threshold: float) -> DataFrame:
    df = df.withColumn("toxicity_names", toxic_rules(F.col(text)))
    return _scored(df, "toxicity", fv.TOXICITY_RULES, threshold)


def _injection_columns(df: DataFrame, text: str, threshold: float) -> DataFrame:
    df = staged(df.withColumn("_plain", deobfuscated(F.col(text))), "_plain")
    df = df.withColumn("injection_names", injection_rules(F.col(text), F.col("_plain")))
    return _scored(df.drop("_plain"), "injection", fv.INJECTION_RULES, threshold)


def detect_toxicity(df: DataFrame, text: str, threshold: float = fv.RULE_THRESHOLD) -> DataFrame:
    """Add ``toxicity``."""
    return _toxicity_columns(df, text, threshold).select(*df.columns, result("toxicity"))


def detect_injection(df: DataFrame, text: str, threshold: float = fv.RULE_THRESHOLD) -> DataFrame:
    """Add ``injection``; obfuscated forms are undone and looked at, too."""
    return _injection_columns(df, text, threshold).select(*df.columns, result("injection"))


def scrub_pii(df: DataFrame, text: str) -> DataFrame:
    """Add ``spans`` (with values and placeholders), ``sanitized`` and ``pii_mapping``."""
    found = staged(df.withColumn("_spans", pii_spans(F.col(text))), "_spans")
    named = found.withColumn("spans", with_placeholders(F.col("_spans"))).drop("_spans")
    return (
        staged(named, "spans")
        .withColumn("sanitized", scrubbed(F.col(text), F.col("spans")))
        .withColumn("pii_mapping", vault_map(F.col("spans")))
    )


def screen(prompts: DataFrame, options: ScreenOptions = ScreenOptions()) -> DataFrame:
    """One pass over a batch or stream of prompts, without a shuffle.

    The result columns, and ``pii_mapping`` for the vault.
    """
    df = prompts
    if options.check_toxicity:
        df = _toxicity_columns(df, "prompt", options.toxicity_threshold)
    else:
        df = without_score(df, "toxicity")
    # A toxic prompt is blocked at once: the later checks see nothing of it.
    df = staged(df.withColumn("_open", F.when(~F.col("toxicity_flag"), F.col("prompt"))), "_open")
    if options.check_injection:
        df = _injection_columns(df, "_open", options.injection_threshold)
    else:
        df = without_score(df, "injection")
    df = df.withColumn(
        "blocked", F.col("toxicity_flag") | F.coalesce("injection_flag", F.lit(False))
    )
    df = df.withColumn("_open", F.when(~F.col("blocked"), F.col("prompt")))
    df = staged(df, "blocked", "_open")
    if options.redact:
        df = scrub_pii(df, "_open")
    else:
        df = (
            df.withColumn("spans", F.lit(None).cast(NAMED_SPANS))
            .withColumn("sanitized", F.col("_open"))
            .withColumn("pii_mapping", F.lit(None).cast("map<string,string>"))
        )
    entities = F.transform(
        "spans",
        lambda s: F.struct(
            *[s[f].alias(f) for f in ("pii_type", "placeholder", "start", "end")]
        ),
    )
    return df.select(
        "prompt_id",
        F.coalesce("sanitized", F.lit("")).alias("sanitized"),
        F.coalesce(entities, F.array()).alias("pii"),
        F.coalesce(F.size(F.coalesce("spans", F.array())), F.lit(0)).alias("pii_count"),
        result("injection"),
        result("toxicity"),
        F.when(F.col("blocked"), "BLOCKED")
        .otherwise(
            worst_level(
                screen_level(F.col("injection_score")), screen_level(F.col("toxicity_score"))
            )
        )
        .alias("overall_risk"),
        "blocked",
        F.when(
            F.col("toxicity_flag"),
            F.concat(F.lit(fv.TOXIC_REASON), F.array_join("toxicity_names", ", ")),
        )
        .when(
            F.col("injection_flag"),
            F.concat(F.lit(fv.INJECTION_REASON), F.array_join("injection_names", ", ")),
        )
        .alias("block_reason"),
        F.length("prompt").alias("original_length"),
        F.coalesce(F.length("sanitized"), F.lit(0)).alias("sanitized_length"),
        "pii_mapping",
    )


class Screening(NamedTuple):
    """``results`` and ``rejected`` together hold every prompt once.

    Original values are in ``vault`` only. The tables are plans of their own: nothing is
    run or written down until the caller does, and no value reaches a scratch table. Both may
    be filtered and joined like any table: what they hold are plain columns.
    """

    results: DataFrame
    vault: DataFrame
    rejected: DataFrame


def screen_prompts(prompts: DataFrame, options: ScreenOptions = ScreenOptions()) -> Screening:
    """Screens a batch of prompts; null and empty ones are rejected with their problem."""
    problem = F.when(F.col("prompt").isNull(), "prompt is missing").when(
        F.col("prompt") == "", "prompt is shorter than 1"
    )
    checked = prompts.withColumn("problems", F.array_compact(F.array(problem)))
    valid, rejected = split(checked)
    done = screen(valid, options)
    vault = done.where("pii_count > 0").select("prompt_id", "pii_mapping")
    return Screening(done.drop("pii_mapping"), vault, rejected)


def restore_pii(responses: DataFrame, vault: DataFrame, text: str = "response") -> DataFrame:
    """Put the original values back into responses that mention placeholders."""
    return (
        responses.join(vault.select("prompt_id", "pii_mapping"), "prompt_id", "left")
        .withColumn(
            text,
            F.when(F.col("pii_mapping").isNull(), F.col(text)).otherwise(
                restored(F.col(text), F.col("pii_mapping"))
            ),
        )
        .drop("pii_mapping")
    )
