"""Hard negatives by matrix products in a residue number system.

Scores are inner products of integer vectors. For several small primes both matrices are
reduced to residues around zero and multiplied in float32; no partial sum exceeds 2^24, so
every product is exact modulo its prime. Chinese remaindering in centred mixed radix
(Garner's scheme) puts the residues together into the exact signed score. As many primes are
used as the largest component and the longest vector of the table ask for.

Two passes over the scores: the first keeps an anchor's best rows of its own label (the
positives), the second for each (anchor, positive) the best rows of other labels within the
window of scores that the positive sets. Scores are multiplied again rather than kept.

Scale: the anchors are a stated query set against all rows, in blocks. A unit of work is a
block of rows and a block of anchors, both bounded by ``BLOCK_BYTES`` whatever the table, so
a row travels once per block of anchors and a lost executor repeats its units only. A unit
returns at most k rows per anchor or pair; Spark's windows keep the best of all units. No
block depends on labels, so a label that holds a third of all rows is spread like the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from factlake.session import Scratch

POSITIVES, NEGATIVES = 5, 5
SCALE = 256
#: Least and greatest part of a positive's score that a negative may have, in percent.
WINDOW = (80, 100)
#: Components of a block of rows or anchors, counted at eight bytes.
BLOCK_BYTES = 32 << 20
#: Float32 counts every whole number up to this one.
_EXACT = 1 << 24
#: Scores that are worked on at a time: bounds the memory of a unit.
_CELLS = 1 << 20
#: Longest stretch of components that is multiplied before its sums are reduced.
_STRETCH = 256
_BLOCK = "ids binary, labels binary, width int, x binary"
_LEAST = np.iinfo(np.int64).min


def quantised(
    vectors: DataFrame,
    *,
    scale: int = SCALE,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """(vec_id, label, x: array of floor(scale * component)) of the rows that take part.

    Rows without id or label and vectors that are null or hold a null or non-finite
    component don't. Components beyond a long are held at its ends.
    """
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    known = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & x.isNotNull()
    whole = F.transform(x, lambda c: F.floor(scale * c.cast("double")))
    return vectors.where(known & F.coalesce(finite, F.lit(False))).select(
        F.col(vec_id).cast("bigint").alias("vec_id"),
        F.col(label).cast("bigint").alias("label"),
        whole.alias("x"),
    )


@lru_cache(maxsize=64)
def moduli(bound: int, width: int) -> tuple[int, ...]:
    """Primes, greatest first, whose product tells all scores from -bound to bound apart.

    None is so great that ``width`` (or a stretch of) products of its residues could add up
    beyond what float32 counts exactly.
    """
    terms = max(1, min(width, _STRETCH))
    out, product = [], 1
    prime = 2 * int((_EXACT / terms) ** 0.5) + 1
    prime -= 1 - prime % 2
    while product <= 2 * bound + 1:
        while any(prime % d == 0 for d in range(3, int(prime**0.5) + 1, 2)) or (
            terms * (prime // 2) ** 2 > _EXACT
        ):
            prime -= 2
        out.append(prime)
        product *= prime
        prime -= 2
    return tuple(out)


def _centred(x: np.ndarray, prime: int) -> np.ndarray:
    """Residues from -(prime - 1) / 2 to (prime - 1) / 2."""
    half = prime // 2
    return (x + half) % prime - half


def _residues(x: np.ndarray, prime: int) -> np.ndarray:
    return _centred(x % prime, prime).astype(np.float32)


def _product(a: np.ndarray, b: np.ndarray, prime: int) -> np.ndarray:
    """Residues of a @ b.T, both given as float32 residues."""
    out = None
    for at in range(0, max(1, a.shape[1]), _STRETCH):
        part = (a[:, at : at + _STRETCH] @ b[:, at : at + _STRETCH].T).astype(np.int64)
        out = part if out is None else out + part
    return _centred(out, prime)


def reconstructed(residues: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """The numbers with these centred residues, as longs (modulo 2^64 beyond them)."""
    digits: list[np.ndarray] = []
    for k, prime in enumerate(primes):
        known, place = 0, 1
        for digit, of in zip(digits, primes):
            known = known + digit * place
            place = place * of % prime
        digits.append(_centred((residues[k] - known) * pow(place, -1, prime) % prime, prime))
    value = np.zeros_like(residues[0])
    place = 1
    for digit, prime in zip(digits, primes):
        wrapped = place % 2**64
        value += digit * np.int64(wrapped - 2**64 if wrapped >= 2**63 else wrapped)
        place *= prime
    return value


class Block:
    """Rows of a block with their residues, worked out once per unit and prime."""

    def __init__(self, row) -> None:
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.labels = np.frombuffer(row["labels"], dtype=np.int64)
        self.x = np.frombuffer(row["x"], dtype=np.int64).reshape(len(self.ids), row["width"])

    def residues(self, primes: tuple[int, ...], width: int) -> list[np.ndarray]:
        """Shorter vectors are padded with zeros, which add nothing to a product."""
        missing = ((0, 0), (0, width - self.x.shape[1]))
        return [np.pad(_residues(self.x, p), missing) for p in primes]


def scores_of(anchors: Block, rows: Block, bound: int) -> Iterator[tuple[slice, np.ndarray]]:
    """The exact scores of some anchors at a time against all rows of the block."""
    width = max(anchors.x.shape[1], rows.x.shape[1])
    primes = moduli(bound, width)
    left, right = anchors.residues(primes, width), rows.residues(primes, width)
    step = max(1, _CELLS // max(1, len(rows.ids)))
    for at in range(0, len(anchors.ids), step):
        part = slice(at, min(at + step, len(anchors.ids)))
        found = [_product(a[part], b, p) for a, b, p in zip(left, right, primes)]
        yield part, reconstructed(found, primes)


def _best(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int):
    """(row, column) of each row's k highest allowed scores, ties to the smaller id."""
    held = np.where(allowed, scores, _LEAST)
    if held.shape[1] > k:
        kth = np.partition(held, held.shape[1] - k, axis=1)[:, -k]
        allowed = allowed & (held >= kth[:, None])
    row, column = np.nonzero(allowed)
    order = np.lexsort((ids[column], -held[row, column], row))
    row, column = row[order], column[order]
    starts = np.searchsorted(row, row, side="left")
    kept = np.arange(len(row)) - starts < k
    return row[kept], column[kept]


def _in_window(positive: np.ndarray, scores: np.ndarray, window: tuple[int, int]) -> np.ndarray:
    """least * positive <= 100 * score <= most * positive, without overflow."""
    least, most = window
    low = np.array([-(-least * int(p) // 100) for p in positive.tolist()], dtype=object)
    high = np.array([most * int(p) // 100 for p in positive.tolist()], dtype=object)
    ends = np.iinfo(np.int64)
    clip = lambda v: np.array([min(max(x, ends.min), ends.max) for x in v], dtype=np.int64)
    return (scores >= clip(low)[:, None]) & (scores <= clip(high)[:, None])


def _blocks(rows: DataFrame, number: int, *more: str) -> DataFrame:
    """(block, ids, labels, width, x, more...) with the rows dealt into ``number`` blocks."""

    def packed(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("vec_id", kind="stable")
        width = max(map(len, block["x"]))
        x = np.zeros((len(block), width), dtype=np.int64)
        for k, row in enumerate(block["x"]):
            x[k, : len(row)] = row
        out = {
            "block": [block["block"].iloc[0]],
            "ids": [block["vec_id"].to_numpy(np.int64).tobytes()],
            "labels": [block["label"].to_numpy(np.int64).tobytes()],
            "width": [width],
            "x": [x.tobytes()],
        }
        return pd.DataFrame(out | {name: [list(block[name])] for name in more})

    extra = "".join(f", {n} array<{rows.schema[n].dataType.simpleString()}>" for n in more)
    # A row's own hash, so that neither an id, a label nor a vector can fill a block alone.
    salt = F.pmod(F.xxhash64("vec_id", "x", F.monotonically_increasing_id()), F.lit(number))
    dealt = rows.withColumn("block", salt)
    return dealt.groupBy("block").applyInPandas(packed, f"block bigint, {_BLOCK}{extra}")


def _units(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> DataFrame:
    """Every block of rows beside every block of anchors, one task or a few units each."""
    numbers = lambda n: F.explode(F.expr(f"sequence(0L, {n - 1}L)"))
    left = rows.select(F.col("block").alias("b"), F.struct(rows.columns[1:]).alias("rows"))
    right = anchors.select(F.col("block").alias("a"), F.struct(anchors.columns[1:]).alias("anchors"))
    most = 16 * rows.sparkSession.sparkContext.defaultParallelism
    parts = min(n_rows * n_anchors, most)
    left = left.withColumn("a", numbers(n_anchors)).repartition(parts, "a", "b")
    return left.join(right.withColumn("b", numbers(n_rows)).repartition(parts, "a", "b"), ["a", "b"])


def _over_units(unit: Callable[[Block, Block, dict], pd.DataFrame]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, anchors in zip(batch["rows"], batch["anchors"]):
                yield unit(Block(rows), Block(anchors), anchors)

    return run


def _positives(bound: int, k: int):
    def unit(rows: Block, anchors: Block, _: dict) -> pd.DataFrame:
        parts = []
        for part, scores in scores_of(anchors, rows, bound):
            same = anchors.labels[part, None] == rows.labels[None, :]
            other = anchors.ids[part, None] != rows.ids[None, :]
            a, r = _best(scores, same & other, rows.ids, k)
            parts.append((anchors.ids[part][a], rows.ids[r], scores[a, r]))
        return _frame(["anchor_id", "positive_id", "positive_score"], parts)

    return _over_units(unit)


def _negatives(bound: int, k: int, window: tuple[int, int]):
    def unit(rows: Block, anchors: Block, row: dict) -> pd.DataFrame:
        parts = []
        for part, scores in scores_of(anchors, rows, bound):
            different = anchors.labels[part, None] != rows.labels[None, :]
            positives = list(row["positives"])[part]
            for nth in range(max(map(len, positives), default=0)):
                have = np.array([j for j, p in enumerate(positives) if len(p) > nth])
                ids = np.array([positives[j][nth]["positive_id"] for j in have], dtype=np.int64)
                of = np.array([positives[j][nth]["positive_score"] for j in have], dtype=np.int64)
                some = scores[have]
                allowed = different[have] & _in_window(of, some, window)
                a, r = _best(some, allowed, rows.ids, k)
                place = np.full(len(a), nth)
                parts.append(
                    (anchors.ids[part][have[a]], place, ids[a], rows.ids[r], of[a], some[a, r])
                )
        names = ["anchor_id", "nth", "positive_id", "negative_id", "positive_score", "negative_score"]
        return _frame(names, parts)

    return _over_units(unit)


def _frame(names: list[str], parts: list[tuple]) -> pd.DataFrame:
    columns = zip(*parts) if parts else [[np.zeros(0, np.int64)]] * len(names)
    return pd.DataFrame({n: np.concatenate(list(c)) for n, c in zip(names, columns)})


def _first(found: DataFrame, keys: list[str], score: str, tie: str, k: int) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    *,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    window: tuple[int, int] = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score).

    ``vectors`` is (vec_id, label, x), as ``quantised`` gives it; ``is_anchor`` a condition
    on vec_id. An anchor's positives are its best ``positives`` other rows of the same label,
    ties to the smaller vec_id; a positive's negatives the best ``negatives`` rows of other
    labels with window[0] * positive_score <= 100 * negative_score <= window[1] *
    positive_score. Anchors without positives and positives without negatives have no row; an
    empty table gives an empty result.

    Rows that repeat an id are rows of their own (a repeated positive has its ranks twice), but
    a row is never the positive of an anchor with its id; of anchors with one id that with the least (label, x) counts. Vectors of
    unequal length are compared as if the shorter one went on with zeros. Scores are longs,
    modulo 2^64 beyond them.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = scratch.table(vectors.select("vec_id", "label", "x"))
    ends = F.array_min("x"), F.array_max("x")
    n, width, low, high = rows.agg(
        F.count(F.lit(1)), F.max(F.size("x")), F.min(ends[0]), F.max(ends[1])
    ).first()
    bound = int(width or 0) * max(abs(low or 0), abs(high or 0)) ** 2
    least = F.min_by(F.struct("label", "x"), F.struct("label", "x")).alias("of")
    chosen = rows.where(is_anchor).groupBy("vec_id").agg(least).select("vec_id", "of.*")
    anchors = scratch.table(chosen)

    room = max(1, block_bytes // (8 * max(1, int(width or 1))))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n_rows = max(1, -(-n // room), min(cores, n // 1024))
    n_anchors = max(1, -(-anchors.count() // room))
    blocks = scratch.table(_blocks(rows, n_rows))

    asked = scratch.table(_blocks(anchors, n_anchors))
    found = _units(blocks, asked, n_rows, n_anchors).mapInPandas(
        _positives(bound, positives), "anchor_id bigint, positive_id bigint, positive_score bigint"
    )
    near = _first(found, ["anchor_id"], "positive_score", "positive_id", positives)
    of_anchor = near.groupBy("anchor_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("p")
    )
    both = F.transform("p", lambda p: F.struct(p["positive_id"], p["positive_score"]))
    of_anchor = of_anchor.select(F.col("anchor_id").alias("vec_id"), both.alias("positives"))
    paired = scratch.table(anchors.join(of_anchor, "vec_id"))
    asked_again = scratch.table(_blocks(paired, n_anchors, "positives"))
    scratch.drop(rows, anchors, asked, paired)

    found = _units(blocks, asked_again, n_rows, n_anchors).mapInPandas(
        _negatives(bound, negatives, window),
        "anchor_id bigint, nth bigint, positive_id bigint, negative_id bigint, "
        "positive_score bigint, negative_score bigint",
    )
    best = _first(found, ["anchor_id", "nth"], "negative_score", "negative_id", negatives)
    pair = ["anchor_id", "positive_id", "rank", "negative_id"]
    done = scratch.table(best.select(*pair, "positive_score", "negative_score"))
    scratch.drop(blocks, asked_again)
    return done
