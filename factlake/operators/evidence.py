"""Ranking, aligning and citing the evidence of a claim.

The functions work on *pairs*: one row per claim and evidence item with the claim's
text as ``claim``.  A claim without evidence has one row whose ``kb_id`` is null, so
that it is still there when the verdicts are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factlake.functions import fixed_values as fv
from factlake.functions.numbers import exact_round, ratio
from factlake.functions.regex import contains_any, find_all, matches
from factlake.functions.text import keywords, raw_tokens

CLAIM_KEY = ["answer_id", "claim_index"]


def pair(claims: DataFrame, evidence: DataFrame, how: str = "left") -> DataFrame:
    """Claims with their evidence.  Evidence that names no claim falls out."""
    return claims.select(*CLAIM_KEY, F.col("text").alias("claim"), "claim_type").join(
        evidence, CLAIM_KEY, how
    )


def source_credibility(source: Column) -> Column:
    """The weight of a known source; the table is a fixed, small one."""
    known = F.create_map(
        *[F.lit(x) for entry in fv.SOURCE_CREDIBILITY.items() for x in entry]
    )
    return F.coalesce(
        F.try_element_at(known, F.lower(source)), F.lit(fv.DEFAULT_CREDIBILITY)
    )


def raw_overlap(claim: Column, snippet: Column) -> Column:
    """Whitespace tokens of the claim that the snippet has, too."""
    return F.array_intersect(raw_tokens(claim), raw_tokens(snippet))


def composite_score(pairs_relevance: Column, source: Column, density: Column, url: Column) -> Column:
    w = fv.RANK_WEIGHTS
    bonus = F.when(
        F.coalesce(
            F.greatest(*[F.contains(url, F.lit(d)) for d in fv.AUTHORITY_DOMAINS]),
            F.lit(False),
        ),
        F.lit(fv.URL_BONUS),
    ).otherwise(F.lit(0.0))
    return F.least(
        F.lit(w["relevance"]) * pairs_relevance
        + F.lit(w["source"]) * source_credibility(source)
        + F.lit(w["density"]) * density
        + F.lit(w["url"]) * bonus,
        F.lit(1.0),
    )


def rank_evidence(pairs: DataFrame, top_k: int = fv.RANKED_PER_CLAIM) -> DataFrame:
    """Replace ``relevance_score`` by the composite score; the best ``top_k`` per claim.

    Ties keep the order of retrieval (``kb_rank``).
    """
    density = ratio(
        F.size(raw_overlap(F.col("claim"), F.col("snippet"))),
        F.greatest(F.size(raw_tokens(F.col("claim"))), F.lit(1)),
    )
    order = Window.partitionBy(*CLAIM_KEY).orderBy(F.desc("relevance_score"), "kb_rank")
    return (
        pairs.withColumn(
            "relevance_score",
            F.when(
                F.col("kb_id").isNotNull(),
                composite_score(F.col("relevance_score"), F.col("source"), density, F.col("url")),
            ),
        )
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_k)
    )


def _near_negation(lower: Column, overlap: Column) -> Column:
    """Does ``not`` stand within reach of a shared token on the same line?

    The text after each ``not`` is looked at directly, the text before it in the
    reversed snippet, so no pattern has to be built per row.
    """

    def follows(text: Column, negation: str, words: Column) -> Column:
        tails = find_all(text, rf"\b{negation}\b(?=(.*))", 1)
        return F.exists(
            words,
            lambda w: F.exists(
                tails,
                lambda t: F.contains(F.left(t, F.length(w) + fv.NEGATION_REACH), w),
            ),
        )

    return follows(lower, "not", overlap) | follows(
        F.reverse(lower), "ton", F.transform(overlap, F.reverse)
    )


def contradiction_signal(overlap: Column, snippet: Column) -> Column:
    """Does the snippet deny something it shares words with?  Substrings count."""
    lower = F.lower(snippet)
    shared = F.size(overlap)
    return (
        F.when(shared == 0, False)
        .when(matches(lower, fv.DOUBLE_NEGATION), False)
        .when(contains_any(lower, fv.STRONG_DENIALS), True)
        .when(shared < 2, False)
        .when(contains_any(lower, fv.WEAK_DENIALS), True)
        .when(F.contains(lower, F.lit("not")), _near_negation(lower, overlap))
        .otherwise(False)
    )


def with_alignment(pairs: DataFrame) -> DataFrame:
    """Add ``alignment``, ``contradiction`` and ``aligned``."""
    return (
        pairs.withColumn("_overlap", raw_overlap(F.col("claim"), F.col("snippet")))
        .withColumn(
            "alignment", ratio(F.size("_overlap"), F.size(raw_tokens(F.col("claim"))))
        )
        .withColumn("contradiction", contradiction_signal(F.col("_overlap"), F.col("snippet")))
        .withColumn(
            "aligned",
            F.col("kb_id").isNotNull()
            & F.when(F.col("contradiction"), F.col("alignment") >= fv.ALIGN_MIN_CONTRADICTING)
            .otherwise(F.col("alignment") >= fv.ALIGN_MIN),
        )
        .drop("_overlap")
    )


def align_evidence(pairs: DataFrame) -> DataFrame:
    """Only evidence that supports or contradicts its claim."""
    return with_alignment(pairs).where("aligned").drop("aligned")


def keep_aligned(pairs: DataFrame) -> DataFrame:
    """Like :func:`align_evidence`, but a dropped item leaves its claim's row behind."""
    flagged = with_alignment(pairs)
    blanked = ["kb_id", "source", "snippet", "url", "relevance_score"]
    return flagged.select(
        *[c for c in flagged.columns if c not in blanked + ["aligned", "alignment", "contradiction"]],
        *[F.when(F.col("aligned"), F.col(c)).alias(c) for c in blanked],
    )


def with_evidence_index(pairs: DataFrame) -> DataFrame:
    """Position of each evidence item in its answer: by claim, then by rank."""
    running = (
        Window.partitionBy("answer_id")
        .orderBy("claim_index", "rank")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return pairs.withColumn(
        "evidence_index",
        F.when(
            F.col("kb_id").isNotNull(),
            (F.count("kb_id").over(running) - 1).cast("int"),
        ),
    )


def citation_ratio(claim_keywords: Column, evidence_keywords: Column) -> Column:
    return ratio(
        F.size(F.array_intersect(claim_keywords, evidence_keywords)), F.size(claim_keywords)
    )


def cited(min_ratio: float = fv.CITATION_MIN_OVERLAP) -> Column:
    """Does a pair's evidence share enough keywords with its claim?"""
    claim_keywords = keywords(F.col("claim"))
    return (
        F.col("kb_id").isNotNull()
        & (F.size(claim_keywords) > 0)
        & (citation_ratio(claim_keywords, keywords(F.col("snippet"))) >= min_ratio)
    )


def check_citations(pairs: DataFrame, min_ratio: float = fv.CITATION_MIN_OVERLAP) -> DataFrame:
    """Evidence sharing enough keywords with its claim, as citations."""
    return pairs.where(cited(min_ratio)).select(
        *CLAIM_KEY,
        "evidence_index",
        "source",
        "url",
        exact_round(F.col("relevance_score"), 2).alias("confidence"),
    )
