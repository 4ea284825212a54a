"""Text expressions: sentences, keywords, tokens, safe previews."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from factlake.functions import fixed_values as fv
from factlake.functions.regex import NON_SPACES, SPACES, jvm


def strip(col: Column) -> Column:
    """Trim Unicode whitespace on both sides."""
    return F.trim(col, F.lit(fv.WHITESPACE))


def is_blank(col: Column) -> Column:
    return F.length(strip(col)) == 0


def normalize_whitespace(col: Column) -> Column:
    """Every run of whitespace becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(col, SPACES, " "))


def words(col: Column) -> Column:
    """Whitespace-separated words, punctuation kept."""
    return F.regexp_extract_all(col, F.lit(NON_SPACES), F.lit(0))


def raw_tokens(col: Column) -> Column:
    """Distinct lower-case whitespace-separated words."""
    return F.array_distinct(words(F.lower(col)))


def split_sentences(col: Column) -> Column:
    """Pieces between whitespace that follows ``.``, ``!`` or ``?``."""
    return F.filter(F.split(strip(col), jvm(fv.SENTENCE_BREAK), -1), lambda s: s != "")


def split_conjunctions(sentences: Column) -> Column:
    """Cut each sentence at a contrasting conjunction between spaces."""
    pattern = jvm(fv.CONJUNCTION_BREAK, ignore_case=True)
    return F.filter(
        F.flatten(
            F.transform(sentences, lambda s: F.transform(F.split(s, pattern, -1), strip))
        ),
        lambda p: p != "",
    )


def _words_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def keywords(col: Column, min_length: int = fv.KEYWORD_MIN_LENGTH) -> Column:
    """Distinct ASCII letter runs of the lower-case text, in order, minus stop words."""
    runs = F.regexp_extract_all(F.lower(col), F.lit(fv.KEYWORD_RUN), F.lit(0))
    return F.array_except(
        F.filter(runs, lambda w: F.length(w) >= min_length),
        _words_array(fv.KEYWORD_STOP_WORDS),
    )


def similarity_tokens(col: Column) -> Column:
    """Lower-case words without punctuation, >= 3 characters, duplicates kept."""
    cleaned = F.regexp_replace(F.lower(col), jvm(fv.SIMILARITY_PUNCTUATION), " ")
    return F.filter(
        words(cleaned),
        lambda w: (F.length(w) >= fv.SIMILARITY_MIN_LENGTH)
        & ~w.isin(fv.SIMILARITY_STOP_WORDS),
    )


def truncated(col: Column, length: int, mark: str = "…") -> Column:
    """The text, or its first ``length`` characters and a mark if it is longer."""
    return F.when(
        F.length(col) > length, F.concat(F.substring(col, 1, length), F.lit(mark))
    ).otherwise(col)


def safe_preview(col: Column, length: int = fv.PREVIEW_CHARS) -> Column:
    """One printable line: control characters out, whitespace collapsed, cut."""
    return truncated(
        normalize_whitespace(F.regexp_replace(col, fv.CONTROL_CHARS, " ")), length
    )


def content_hash(col: Column) -> Column:
    """A stable short identifier of the text."""
    return F.concat(F.lit("sha:"), F.substring(F.sha2(col, 256), 1, fv.HASH_CHARS))
