"""Quality rules: a decision list learned by sequential covering.

``text_statistics`` counts words, symbols and repetitions of every whole text.  ``learn``
grows threshold conjunctions ("rules") that reject, one after the other, on a bounded
sample of labelled rows, prunes each on rows held back, and stops when no rule is precise
enough.  ``verdict`` turns the list into one ordered Spark conditional expression.

Defined results: a null or empty text has no words and fails the base rule; equal texts
get equal verdicts; without usable labels the list is empty and only the base rule acts;
labels that contradict each other count as bad.  Columns of the caller are never replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from factlake.llm.common import column_udf, fresh, in_slices, sampled, utf8_rows

WINDOW = 8
COUNTS = {
    "n_words": "number of words",
    "word_chars": "code points in words",
    "n_symbols": "characters of SYMBOLS",
    "n_dup_lines": "lines with a word that equal an earlier line",
    "n_repeat_words": "words in windows of 8 that occur twice or more",
    "n_lines": "lines with a word",
    "n_upper": "capital letters A-Z",
    "n_digits": "digits 0-9",
    "n_marks": "characters ! and ?",
}
COUNTS_TYPE = f"struct<{', '.join(f'{name}: bigint' for name in COUNTS)}>"

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"


def _lookup(members: bytes) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    found[list(members)] = True
    return found


_SPACE = _lookup(SPACES)
_CONTINUES = np.zeros(256, dtype=bool)
_CONTINUES[0x80:0xC0] = True
_COUNTED = {
    "word_chars": ~_SPACE & ~_CONTINUES,
    "n_symbols": _lookup(SYMBOLS),
    "n_upper": _lookup(bytes(range(ord("A"), ord("Z") + 1))),
    "n_digits": _lookup(b"0123456789"),
    "n_marks": _lookup(b"!?"),
}


def _per_row(marks: np.ndarray, ends: np.ndarray) -> np.ndarray:
    running = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return np.diff(running[ends], prepend=0)


def _words_in_repeats(ids: np.ndarray, row_of: np.ndarray, n_rows: int) -> np.ndarray:
    """Per row, the words inside windows of WINDOW words that the row has twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return np.zeros(n_rows, dtype=np.int64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    key = row_of[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(WINDOW):
        key = key * np.uint64(0xFF51AFD7ED558CCD) + mixed[k : k + n]
    at = np.flatnonzero(row_of[:n] == row_of[WINDOW - 1 :])
    order = at[np.argsort(key[at], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    found = order[twice]
    if len(found):
        rows = np.column_stack([row_of[found], *(ids[found + k] for k in range(WINDOW))])
        alike = key[found[1:]] == key[found[:-1]]
        if not (rows[1:][alike] == rows[:-1][alike]).all():  # two windows share a key
            _, which, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
            found = found[count[which.ravel()] > 1]
    covered = np.zeros(len(ids) + 1, dtype=np.int32)
    np.add.at(covered, found, 1)
    np.add.at(covered, found + WINDOW, -1)
    inside = np.cumsum(covered[:-1]) > 0
    return np.bincount(row_of[inside], minlength=n_rows).astype(np.int64)


def _statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    out = {name: _per_row(found[data], ends) for name, found in _COUNTED.items()}
    words = [text.split() for text in texts]
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    numbers: dict[bytes, int] = {}
    ids = np.fromiter(
        (numbers.setdefault(word, len(numbers)) for row in words for word in row),
        np.int64,
        int(n_words.sum()),
    )
    row_of = np.repeat(np.arange(len(texts)), n_words)
    lines = [[line for line in text.split(b"\n") if line.strip()] for text in texts]
    out["n_words"] = n_words
    out["n_lines"] = np.fromiter(map(len, lines), np.int64, len(lines))
    out["n_dup_lines"] = out["n_lines"] - np.fromiter(
        (len(set(row)) for row in lines), np.int64, len(lines)
    )
    out["n_repeat_words"] = _words_in_repeats(ids, row_of, len(texts))
    return out


def _statistics_column(texts: pa.Array) -> pa.Array:
    parts = [_statistics(part) for part in in_slices(utf8_rows(texts))]
    columns = [
        pa.array(np.concatenate([p[name] for p in parts]) if parts else [], pa.int64())
        for name in COUNTS
    ]
    return pa.StructArray.from_arrays(columns, list(COUNTS))


def text_statistics(text: Column) -> Column:
    """A struct of COUNTS over the whole text; null counts as empty."""
    return column_udf(_statistics_column, COUNTS_TYPE)(text)


def features(counts: Column) -> dict[str, Column]:
    """What rules may test: counts and shares, 0 where the base is 0."""
    value = {name: counts[name].cast("double") for name in COUNTS}

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(value[part], value[whole]), F.lit(0.0))

    return {
        "n_words": value["n_words"],
        "symbol_share": share("n_symbols", "word_chars"),
        "upper_share": share("n_upper", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "mark_share": share("n_marks", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "word_length": share("word_chars", "n_words"),
        "line_words": share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        x = values[self.feature]
        return x >= self.threshold if self.above else x < self.threshold

    def column(self, values: dict[str, Column]) -> Column:
        x = values[self.feature]
        return x >= F.lit(self.threshold) if self.above else x < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, values: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(values) for c in rule), np.ones(n, dtype=bool))


def _candidates(values: dict[str, np.ndarray], thresholds: int) -> list[Condition]:
    found = []
    for name, x in values.items():
        cuts = np.unique(np.quantile(x, np.linspace(0, 1, thresholds + 1)[1:-1])) if len(x) else []
        cuts = {*map(float, cuts), *([float(x[x > 0].min())] if len(x) and (x > 0).any() else [])}
        found += [Condition(name, above, cut) for cut in sorted(cuts) for above in (True, False)]
    return found


def _grow(values, bad, candidates, most_conditions, precision) -> Rule:
    """Adds the condition of the best information gain until the rule is precise."""
    rule: Rule = ()
    covered = np.ones(len(bad), dtype=bool)
    tests = {c: c.holds(values) for c in candidates}
    while len(rule) < most_conditions:
        p, n = int((covered & bad).sum()), int(covered.sum())
        if p == 0 or (rule and p / n >= precision):
            break
        best, gain = None, 1e-9
        for c, holds in tests.items():
            both = covered & holds
            p1, n1 = int((both & bad).sum()), int(both.sum())
            if p1 and n1 < n and (g := p1 * (np.log2(p1 / n1) - np.log2(p / n))) > gain:
                best, gain = c, g
        if best is None:
            break
        rule += (best,)
        covered &= tests[best]
    return rule


def _prune(rule: Rule, values, bad) -> Rule:
    """The shortest prefix that does best on rows held back."""

    def worth(r: Rule) -> float:
        hit = _covers(r, values, len(bad))
        p, n = int((hit & bad).sum()), int(hit.sum())
        return (2 * p - n) / n if n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))


def learn(
    values: dict[str, np.ndarray],
    bad: np.ndarray,
    held_back: np.ndarray,
    *,
    max_rules: int = 12,
    max_conditions: int = 4,
    thresholds: int = 40,
    precision: float = 0.97,
    min_cover: int = 3,
) -> list[Rule]:
    """Rejecting rules in the order found: sequential covering with reduced-error pruning.

    A rule is kept if it is precise on rows held back as well as on those it grew on;
    the rows it covers then leave both sets.
    """
    rules: list[Rule] = []
    live = np.ones(len(bad), dtype=bool)
    for _ in range(max_rules):
        grow, prune = live & ~held_back, live & held_back
        part = lambda at: {k: v[at] for k, v in values.items()}
        on_grow, on_prune = part(grow), part(prune)
        rule = _grow(
            on_grow, bad[grow], _candidates(on_grow, thresholds), max_conditions, precision
        )
        if not rule:
            break
        rule = _prune(rule, on_prune, bad[prune])
        hit = _covers(rule, values, len(bad)) & live
        held = hit & held_back
        good = int((hit & bad).sum()) >= precision * hit.sum() and int(
            (held & bad).sum()
        ) >= precision * int(held.sum())
        if not good or int((hit & bad).sum()) < min_cover:
            break
        rules.append(rule)
        live &= ~hit
    return rules


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    sample_rows: int = 20_000,
    **settings: float,
) -> list[Rule]:
    """Learns from a hash sample of about ``sample_rows`` labelled documents.

    The bound is on what the driver sees; labels (doc_id, quality) of doc ids without a
    document are ignored.
    """
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    chosen = known.where(sampled("doc_id", sample_rows, known.count())).withColumn(
        "held_back", F.pmod(F.xxhash64("doc_id", F.lit("held back")), F.lit(3)) == 0
    )
    counts = fresh("counts")
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # about sample_rows rows at most
        .withColumn(counts, text_statistics(F.col("text")))
        .select(
            *[c.alias(name) for name, c in features(F.col(counts)).items()],
            (F.col("quality") == 0).alias("bad"),
            "held_back",
        )
        .toPandas()
    )
    values = {name: rows[name].to_numpy(float) for name in features(F.col(counts))}
    return learn(
        values, rows["bad"].to_numpy(bool), rows["held_back"].to_numpy(bool), **settings
    )


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < 20) | (
        100 * counts["n_repeat_words"] > 30 * counts["n_words"]
    )


def verdict(rules: list[Rule], counts: Column) -> Column:
    """False for what the base rule or the first matching rule rejects, else true."""
    values = features(counts)
    out = F.when(base_failed(counts), F.lit(False))
    for rule in rules:
        out = out.when(reduce(Column.__and__, (c.column(values) for c in rule)), F.lit(False))
    return out.otherwise(F.lit(True))


def judged(docs: DataFrame, rules: list[Rule], counts: str, keep: str) -> DataFrame:
    """``docs`` with a struct of counts and the verdict, under the two given names."""
    with_counts = docs.withColumn(counts, text_statistics(F.col("text")))
    return with_counts.withColumn(keep, verdict(rules, F.col(counts)))


def kept_documents(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    counts, keep = fresh("counts"), fresh("keep")
    return judged(docs, rules, counts, keep).where(F.col(keep)).drop(counts, keep)
