"""Best-fit packing of documents into token sequences, in bulk-synchronous rounds.

Pieces are sorted by length over the whole cluster once, which gives every piece its rank
among those of its length. Each round then does, for all documents and gaps at once:

1. Sweep: from the longest length down, each length takes its successor, the smallest free
   gap that it fits; as many documents of that length go into it as fit, so that equal
   documents don't need a round each. The sweep needs only the number of documents and
   gaps of each size, at most ``capacity`` numbers each whatever the input.
2. Conflicts: of the documents that want the same gap size, the one of rank r gets the gap
   of rank r. Documents and gaps meet in one shuffled join on (size, rank), which is a
   different key for every gap.
3. Update: gaps shrink and get new ranks by arithmetic on their old ones; the table of
   gaps is written to the shared folder, so a lost executor repeats one round at most.
   Documents longer than every gap open new sequences, as many as their sum needs.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factlake.llm.common import column_udf, materialized
from factlake.llm.tokens import ids_of

CAPACITY = 2048
END_ID = 0
_PIECES = "array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint>>"


def _cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def token_pieces(
    docs: DataFrame,
    path: str,
    pattern: str,
    *,
    special: int | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every text's ids and ``end_id``."""
    schema = pa.list_(
        pa.struct(
            [
                ("piece", pa.int32()),
                ("start", pa.int64()),
                ("length", pa.int64()),
                ("ids_crc32", pa.int64()),
            ]
        )
    )

    def of_batch(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            ids = ids_of(text or "", path, pattern, special)
            ids.append(end_id)
            data = np.array(ids, dtype="<u4")
            out.append(
                [
                    (k, start, length, zlib.crc32(data[start : start + length].tobytes()))
                    for k, (start, length) in enumerate(_cut(len(data), capacity))
                ]
            )
        return pa.array(out, schema)

    pieces = column_udf(of_batch, _PIECES)(F.col("text")).alias("pieces")
    return docs.select("doc_id", pieces).selectExpr("doc_id", "inline(pieces)")


@dataclass
class Round:
    """What one round does, by size: bounded lists, no row of the tables."""

    #: length, first rank, end rank -> gap, its first rank, documents to a gap
    place: list[tuple] = field(default_factory=list)
    #: length, first rank, end rank -> first rank among gaps of capacity - length
    open: list[tuple] = field(default_factory=list)
    #: gap, first rank, end rank -> new gap, new first rank
    move: list[tuple] = field(default_factory=list)


def plan_rounds(counts: dict[int, int], capacity: int) -> list[Round]:
    """The rounds for ``counts[length]`` documents of each length below the capacity."""
    left = {length: [0, n] for length, n in counts.items() if n}
    gaps: dict[int, int] = {}
    rounds = []
    while left:
        now, new = Round(), defaultdict(int)

        def move(gap: int, first: int, n: int, to: int) -> None:
            if to:
                now.move.append((gap, first, first + n, to, new[to]))
                new[to] += n

        widest = max(gaps, default=0)
        stuck = sorted((length for length in left if length > widest), reverse=True)
        need = -(-sum(length * (left[length][1] - left[length][0]) for length in stuck) // capacity)
        for length in stuck:
            a, end = left[length]
            n = min(need, end - a)
            if n:
                now.open.append((length, a, a + n, new[capacity - length]))
                new[capacity - length] += n
                left[length][0] += n
                need -= n
        free = sorted(gaps.items())
        stack: list[list[int]] = []
        for length in sorted(left, reverse=True):
            while free and free[-1][0] >= length:
                gap, n = free.pop()
                stack.append([gap, 0, n])
            a, end = left[length]
            while a < end and stack:
                gap, first, last = stack[-1]
                each = gap // length
                full = min(last - first, (end - a) // each)
                if not full:  # fewer documents than one gap holds
                    each, full = end - a, 1
                now.place.append((length, a, a + full * each, gap, first, each))
                move(gap, first, full, gap - each * length)
                a += full * each
                stack[-1][1] += full
                if stack[-1][1] == last:
                    stack.pop()
            left[length][0] = a
        for gap, first, last in stack + [[gap, 0, n] for gap, n in free]:
            move(gap, first, last - first, gap)
        left = {length: span for length, span in left.items() if span[0] < span[1]}
        gaps = dict(new)
        rounds.append(now)
    return rounds


def _small(like: DataFrame, rows: list[tuple], names: str) -> DataFrame:
    """A driver-made table of at most a few thousand rows, bounded by the capacity."""
    schema = ", ".join(f"{name} bigint" for name in names.split())
    return F.broadcast(like.sparkSession.createDataFrame(rows, schema))


def _ranked(pieces: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """``pieces`` with their rank among those of equal length, and the number of each."""
    ordered = pieces.repartitionByRange("length", "uid").sortWithinPartitions("length", "uid")
    ordered = materialized(ordered.withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    number = F.count(F.lit(1)).alias("n")
    counts = dict(map(tuple, ordered.groupBy("length").agg(number).collect()))
    parts = sorted(map(tuple, ordered.groupBy(part.alias("p")).agg(number).collect()))
    before = np.concatenate([[0], np.cumsum([n for _, n in parts])])
    offsets = _small(pieces, [(p, int(b)) for (p, _), b in zip(parts, before)], "p before")
    lengths = sorted(counts)
    below = np.concatenate([[0], np.cumsum([counts[length] for length in lengths])])
    starts = _small(pieces, [(k, int(b)) for k, b in zip(lengths, below)], "length below")
    inside = F.col("place").bitwiseAND((1 << 33) - 1)
    ranked = (
        ordered.withColumn("p", part)
        .join(offsets, "p")
        .join(starts, "length")
        .withColumn("rank", F.col("before") + inside - F.col("below"))
    )
    return ranked.drop("p", "place", "before", "below"), counts


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``length`` is 1 to ``capacity``.

    Repeated rows are pieces of their own; an empty table gives an empty one. The columns
    uid, rank, sequence_id and offset are this function's.
    """
    columns = pieces.columns
    pieces = materialized(pieces.withColumn("uid", F.monotonically_increasing_id()))
    full = pieces.where(F.col("length") == capacity)
    packed = full.selectExpr(*columns, "uid AS sequence_id", "0L AS offset")
    ranked, counts = _ranked(pieces.where(F.col("length") < capacity))
    if not counts:
        return packed
    ranked = materialized(ranked)
    gaps = None
    for now in plan_rounds(counts, capacity):
        parts = []
        if now.open:
            spans = _small(pieces, now.open, "length a z r")
            opened = ranked.join(spans, "length").where("rank >= a AND rank < z")
            parts.append(
                opened.select(
                    F.col("uid").alias("sequence_id"),
                    (capacity - F.col("length")).alias("gap"),
                    (F.col("r") + F.col("rank") - F.col("a")).alias("gap_rank"),
                )
            )
            packed = packed.unionAll(
                opened.select(*columns, F.col("uid"), F.lit(0).cast("bigint"))
            )
        if now.place:
            spans = _small(pieces, now.place, "length a z gap r each")
            wants = ranked.join(spans, "length").where("rank >= a AND rank < z")
            wants = wants.select(
                *columns,
                "gap",
                F.expr("r + (rank - a) div each").alias("gap_rank"),
                F.expr(f"{capacity} - gap + (rank - a) % each * length").alias("offset"),
            )
            packed = packed.unionAll(
                wants.join(gaps, ["gap", "gap_rank"]).select(*columns, "sequence_id", "offset")
            )
        if now.move:
            spans = _small(pieces, now.move, "gap a z new_gap r")
            parts.append(
                gaps.join(spans, "gap")
                .where("gap_rank >= a AND gap_rank < z")
                .selectExpr("sequence_id", "new_gap AS gap", "r + gap_rank - a AS gap_rank")
            )
        if parts:
            gaps = parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])
            gaps = materialized(gaps)
    return packed


def packed_documents(
    docs: DataFrame,
    path: str,
    pattern: str,
    *,
    special: int | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty, which is the end id alone. Documents longer than the
    capacity are cut into pieces of it, only the first may be shorter; nothing is dropped.
    """
    pieces = token_pieces(docs, path, pattern, special=special, capacity=capacity, end_id=end_id)
    return pack(pieces, capacity)
