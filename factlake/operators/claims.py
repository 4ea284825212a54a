"""From answers to numbered factual claims.

Everything happens inside the answer's own row, so the job is one scan without a
shuffle; only sentences that start with a pronoun look back at earlier ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from factlake.functions import fixed_values as fv
from factlake.functions.regex import NON_SPACES, SPACES, any_of, jvm, matches
from factlake.functions.text import (
    normalize_whitespace,
    split_conjunctions,
    split_sentences,
)
from factlake.operators.rows import unnest

# Anchored and possessive: one pass over the text, whatever its runs look like.
_FOUR_WORDS = rf"\A{SPACES[:-1]}*+{NON_SPACES}+(?:{SPACES}+{NON_SPACES}+){{{fv.MIN_CLAIM_WORDS - 1}}}"
#: Items whose results are put together at once.
_RUN = 128
_PRONOUNS = jvm(fv.LEADING_PRONOUN, ignore_case=True)


def is_factual(col: Column) -> Column:
    """Long enough, no opinion or advice at the start, and a factual sign or four words."""
    lower = F.lower(col)
    return (
        (F.length(col) >= fv.MIN_CLAIM_CHARS)
        & ~matches(lower, any_of(fv.NON_FACTUAL_STARTS))
        & (F.rlike(lower, F.lit(_FOUR_WORDS)) | matches(lower, any_of(fv.FACTUAL_SIGNS)))
    )


def claim_type(col: Column) -> Column:
    lower = F.lower(col)
    return (
        F.when(matches(lower, fv.STATISTIC), "statistical")
        .when(matches(lower, fv.CAUSAL), "causal")
        .when(matches(lower, fv.DEFINITIONAL), "definitional")
        .otherwise("factual")
    )


def resolve_coreferences(sentences: Column, coref: str = "compat") -> Column:
    """Replace a leading pronoun by the last proper noun seen.

    ``compat`` looks for the noun in the sentence itself first, where a capitalised
    pronoun counts as a proper noun.  ``previous`` looks at earlier sentences only
    and never takes a pronoun.
    """
    if coref not in ("compat", "previous"):
        raise ValueError(f"coref must be 'compat' or 'previous', not {coref!r}")
    noun = jvm(fv.PROPER_NOUN)

    def marked(sentence: Column) -> Column:
        found = F.regexp_extract(sentence, noun, 1)
        usable = found != ""
        if coref == "previous":
            usable &= F.regexp_extract(found, _PRONOUNS, 1) != found
        return F.struct(
            sentence.alias("sentence"),
            F.when(usable, found).alias("noun"),
            F.regexp_extract(sentence, _PRONOUNS, 1).alias("pronoun"),
        )

    def step(so_far: Column, s: Column) -> Column:
        last = F.coalesce(s["noun"], so_far["last"])
        antecedent = last if coref == "compat" else so_far["last"]
        rest = F.substr(s["sentence"], F.length(s["pronoun"]) + 1)
        resolved = F.when(
            s["pronoun"] != "", F.coalesce(F.concat(antecedent, rest), s["sentence"])
        ).otherwise(s["sentence"])
        return F.struct(
            last.alias("last"), F.concat(so_far["out"], F.array(resolved)).alias("out")
        )

    # Each sentence is looked at once; the last noun is carried along.
    return _scanned(F.transform(sentences, marked), "last", F.lit(None).cast("string"), "array<string>", step)


def _scanned(items: Column, carried: str, first: Column, kind: str, step: Callable) -> Column:
    """The array ``out`` of ``step`` (so_far, item), which gives a struct of ``carried`` and ``out``.

    ``step`` copies ``out`` to add to it, so it does so in short runs that are put together at
    the end: over one run the work would grow with the square of the items.
    """
    empty = F.array().cast(kind)

    def run(so_far: Column, items: Column) -> Column:
        return F.aggregate(
            items,
            F.struct(so_far[carried].alias(carried), empty.alias("out")),
            step,
            lambda done: F.struct(
                done[carried].alias(carried),
                F.concat(so_far["out"], F.array(done["out"])).alias("out"),
            ),
        )

    def scanned(items: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(_RUN))
        runs = F.transform(places, lambda i: F.slice(items, i, _RUN))
        start = F.struct(first.alias(carried), F.array().cast(f"array<{kind}>").alias("out"))
        done = F.aggregate(runs, start, run, lambda done: F.flatten(done["out"]))
        return F.when(items.isNotNull(), done)

    # As a lambda's argument the items are worked out once.
    return F.get(F.transform(F.array(items), scanned), F.lit(0))


def _starts(parts: Column) -> Column:
    """Where each part starts if one character stands between two, in one pass."""

    def step(so_far: Column, part: Column) -> Column:
        return F.struct(
            (so_far["at"] + F.length(part) + 1).alias("at"),
            F.concat(so_far["out"], F.array(so_far["at"])).alias("out"),
        )

    return _scanned(parts, "at", F.lit(0), "array<int>", step)


def with_claims(
    answers: DataFrame,
    text: str = "answer",
    max_claims: int | None = fv.MAX_CLAIMS,
    coref: str = "compat",
) -> DataFrame:
    """Add ``claims``: the first ``max_claims`` factual claims of each answer, all if None.

    ``claims_cut`` is the number of claims beyond the limit. Offsets count the split parts,
    factual or not, with one character between two.
    """
    staged = (
        answers.withColumn("_sentences", split_sentences(F.col(text)))
        .withColumn("_sentences", resolve_coreferences(F.col("_sentences"), coref))
        .withColumn("_parts", split_conjunctions(F.col("_sentences")))
        .withColumn(
            "_all",
            F.filter(
                F.transform(
                    "_parts",
                    lambda p, i: F.struct(normalize_whitespace(p).alias("text"), i.alias("part")),
                ),
                lambda c: is_factual(c["text"]),
            ),
        )
        .withColumn("_claims", F.slice("_all", 1, max_claims) if max_claims else F.col("_all"))
        .withColumn("claims_cut", F.size("_all") - F.size("_claims"))
        .withColumn("_starts", _starts(F.col("_parts")))
    )

    def finished(claim: Column, index: Column) -> Column:
        start = F.get("_starts", claim["part"])
        return F.struct(
            index.alias("claim_index"),
            claim["text"].alias("text"),
            claim_type(claim["text"]).alias("claim_type"),
            F.lit(fv.CLAIM_CONFIDENCE).alias("confidence"),
            start.alias("start_index"),
            (start + F.length(claim["text"])).alias("end_index"),
        )

    return staged.withColumn("claims", F.transform("_claims", finished)).drop(
        "_sentences", "_parts", "_all", "_claims", "_starts"
    )


def explode_claims(with_claims_df: DataFrame, *keep: str) -> DataFrame:
    """One row per claim from a frame made by :func:`with_claims`."""
    return unnest(with_claims_df, "claims", "answer_id", *keep).select(
        "answer_id", *keep, "item.*"
    )


def extract_claims(answers: DataFrame, **options) -> DataFrame:
    """Answers to claims, one row per claim."""
    return explode_claims(with_claims(answers, **options))


def no_claims_status(answers: DataFrame, claims: DataFrame) -> DataFrame:
    """Answers that gave no claim at all."""
    return (
        answers.join(claims.select("answer_id"), "answer_id", "left_anti")
        .select("answer_id", F.lit("NO_CLAIMS").alias("status"))
    )
