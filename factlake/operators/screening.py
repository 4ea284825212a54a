"""Rule-based screening of prompts: toxicity and instruction injection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from factlake.functions import fixed_values as fv
from factlake.functions.numbers import exact_round, let
from factlake.functions.regex import matches_in_long
from factlake.functions.text import is_blank

Rules = list[tuple[str, str, float]]

_LIKE_ASCII = "\u0130\u0131\u017f\u212a"

RESULT = "struct<flag:boolean,score:double,names:array<string>,risk_level:string>"


def case_folded(text: Column) -> Column:
    """Lower case in which every letter that matches an ASCII one is that one.

    Matching lower-case rules on it equals matching the rules without regard to case,
    and the rules then need no case folding per character.
    """
    # Writing a text anew letter by letter is slow, and few texts have any of them.
    # (No lambda: ``text`` may come from a Python function.)
    rare = F.rlike(text, F.lit(f"[{_LIKE_ASCII}]"))
    return F.lower(F.when(rare, F.translate(text, _LIKE_ASCII, "iisk")).otherwise(text))


def matched_rules(text: Column, rules: Rules) -> Column:
    """Names of the rules found anywhere in the text, in rule order."""

    def names(folded: Column) -> Column:
        found = [F.when(matches_in_long(folded, p.lower()), F.lit(name)) for name, p, _ in rules]
        return F.filter(F.array(*found), lambda n: n.isNotNull())

    return let(case_folded(text), names)


def rule_score(names: Column, rules: Rules) -> Column:
    """The largest weight, plus a little for every further rule, at most 1."""
    weights = F.create_map(*[F.lit(x) for name, _, weight in rules for x in (name, weight)])
    heaviest = F.coalesce(
        F.array_max(F.transform(names, lambda n: F.try_element_at(weights, n))), F.lit(0.0)
    )
    more = F.greatest(F.size(names) - 1, F.lit(0))
    return F.least(heaviest + F.lit(fv.EXTRA_RULE_BOOST) * more, F.lit(1.0))


def screen_level(score: Column) -> Column:
    level = F.lit("SAFE")
    for name, lowest in sorted(fv.SCREEN_LEVEL_MIN.items(), key=lambda item: item[1]):
        level = F.when(score >= lowest, name).otherwise(level)
    return level


def worst_level(left: Column, right: Column) -> Column:
    """The more severe of two levels."""
    order = F.array(*[F.lit(level) for level in fv.SCREEN_LEVELS])
    return F.element_at(
        order, F.greatest(F.array_position(order, left), F.array_position(order, right)).cast("int")
    )


def with_score(df: DataFrame, check: str, rules: Rules, threshold: float) -> DataFrame:
    """From ``{check}_names`` to ``{check}_flag`` (on the exact score) and ``{check}_score``."""
    names = F.col(f"{check}_names")
    return (
        df.withColumn(f"_{check}", rule_score(names, rules))
        .withColumn(f"{check}_flag", (F.size(names) > 0) & (F.col(f"_{check}") >= threshold))
        .withColumn(f"{check}_score", exact_round(F.col(f"_{check}"), 2))
        .drop(f"_{check}")
    )


def without_score(df: DataFrame, check: str) -> DataFrame:
    """The columns of a check that is not made."""
    return (
        df.withColumn(f"{check}_names", F.array().cast("array<string>"))
        .withColumn(f"{check}_flag", F.lit(False))
        .withColumn(f"{check}_score", F.lit(0.0))
    )


def result(check: str) -> Column:
    """The check's columns as one struct; the level is that of the rounded score."""
    score = F.coalesce(f"{check}_score", F.lit(0.0))
    return (
        F.struct(
            F.coalesce(f"{check}_flag", F.lit(False)),
            score,
            F.coalesce(f"{check}_names", F.array()),
            screen_level(score),
        )
        .cast(RESULT)
        .alias(check)
    )


def toxic_rules(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(is_blank(text), none).otherwise(
        matched_rules(text, fv.TOXICITY_RULES)
    )


def injection_rules(text: Column, plain: Column) -> Column:
    """Rules found in the raw text, then those only found in its plain form."""
    none = F.array().cast("array<string>")
    raw = matched_rules(text, fv.INJECTION_RULES)
    undone = F.when(
        plain.isNotNull(), matched_rules(plain, fv.INJECTION_RULES)
    ).otherwise(none)
    return F.when(is_blank(text), none).otherwise(F.array_union(raw, undone))
