"""Exact removal of long repeats by run-length indexes of the places that may repeat.

A byte goes if it is covered by a string of ``LENGTH`` bytes (a window) that starts anywhere
else too. Only a fraction of a corpus is worth indexing, and equal windows have to meet:

1. Every window has one anchor, its least GRAM bytes by hash; equal windows have equal
   anchors at equal places. Consecutive windows of one anchor are a run: one row with the
   anchor's hash and the hash of all its bytes.
2. Runs of an anchor that occurs once can't repeat and go. Runs whose bytes occur again
   repeat as a whole. Both are found by grouping hashes, with partial sums before the
   shuffle, so a passage in a third of all documents is one row per task.
3. What is left, one run of each different content per repeated anchor, is fetched as text.
   Runs of one anchor go to one task, which builds a run-length index of them and streams
   the matching statistics: windows with a match of LENGTH bytes repeat.
4. An anchor with more than GROUP different runs is split, however many there are: its
   windows are halved by their distance from it, and what all windows at the distances of
   a half share is that half's new anchor. Steps 2 to 4 repeat; windows of one distance
   are decided in step 2.

So no task holds more than a few groups of bounded size, and nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from factlake.llm.common import fresh, materialized, utf8_rows
from factlake.llm.run_index import RunIndex

LENGTH = 200
GRAM = 48
GROUP = 500
#: Bytes of text worked on at once; longer texts are cut into overlapping parts.
PART = 4 << 20
INDEXED = 1 << 20
_RUNS = "f bigint, k bigint, dk bigint, th bigint, s bigint, n bigint, o bigint"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _joined(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
    """Hashes of the strings of ``a`` followed by those of ``b`` ``shift`` places on."""
    n = len(b) - shift
    x = a[:n] * _ODD + b[shift:]
    x ^= x >> np.uint64(31)
    x *= _MIX
    x ^= x >> np.uint64(29)
    return x


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM = 48 bytes from every place that has so many."""
    padded = np.concatenate([data, np.zeros(-len(data) % 8 + 8, np.uint8)])
    eight = np.empty(len(data) - 7, np.uint64)
    for k in range(8):
        at = padded[k : k + (len(padded) - k) // 8 * 8].view(np.uint64)
        eight[k::8] = at[: len(eight[k::8])]
    eight *= _MIX
    eight ^= eight >> np.uint64(32)
    sixteen = _joined(eight, eight, 8)
    return _joined(_joined(sixteen, sixteen, 16), sixteen, 32)


def _least_place(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every place the place of the least hash among ``width`` from it on, the first
    of equal ones: least over blocks from both sides."""
    low = np.uint64((1 << 24) - 1)
    key = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    padded = np.concatenate([key, np.full(-len(key) % width, ~np.uint64(0))]).reshape(-1, width)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(key) - width + 1
    return (np.minimum(after[:n], before[width - 1 :][:n]) & low).astype(np.int64)


def _parts(rows: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, place in it, bytes), together or alone about PART bytes.

    The parts of a long text overlap, so that every window is in exactly one.
    """
    out, size = [], 0
    for number, row in enumerate(rows):
        for at in range(0, max(1, len(row) - LENGTH + 1), PART):
            piece = row[at : at + PART + LENGTH - 1]
            if len(piece) < LENGTH:
                continue
            if out and size + len(piece) > PART:
                yield out
                out, size = [], 0
            out.append((number, at, piece))
            size += len(piece)
    if out:
        yield out


def _runs_of(parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """Of all runs: hash of the anchor, hash of the content, row, place of the first window,
    windows, distance of the first window from the anchor."""
    data = b"".join(piece for _, _, piece in parts)
    hashes = _gram_hashes(np.frombuffer(data, np.uint8))
    place = _least_place(hashes, LENGTH - GRAM + 1)
    sizes = np.array([len(piece) for _, _, piece in parts])
    offsets = np.cumsum(sizes) - sizes
    windows = sizes - LENGTH + 1
    part = np.repeat(np.arange(len(parts)), windows)
    start = np.arange(len(part)) + np.repeat(offsets - (np.cumsum(windows) - windows), windows)
    anchor = place[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    s, a = start[first], anchor[first]
    digest, view = xxhash.xxh3_64_intdigest, memoryview(data)
    content = [
        digest(view[x : x + c + LENGTH - 1], y - x)
        for x, c, y in zip(s.tolist(), count.tolist(), a.tolist())
    ]
    of_part = part[first]
    rows = np.array([number for number, _, _ in parts])[of_part]
    at = np.array([at for _, at, _ in parts])[of_part]
    anchors, contents = hashes[a].view(np.int64), np.array(content, np.uint64).view(np.int64)
    return anchors, contents, rows, at + s - offsets[of_part], count, a - s


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["f", "k", "dk", "th", "s", "n", "o"]
    for batch in batches:
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("dk", "th")]
        for parts in _parts(utf8_rows(batch.column("text"))):
            f, k, rows, s, n, o = _runs_of(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (f, k, *(key[rows] for key in keys), s, n, o)],
                names,
            )


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """Rows with the key (dk, th): equal for rows of equal doc_id and text only."""
    return docs.select(
        *more,
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("dk"),
        F.xxhash64("text", F.col("doc_id").isNull()).alias("th"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def _decided(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs that repeat as a whole, one run of each content where contents differ).

    ``runs`` has f, k, dk, th, s, n and may have more columns, which the second table
    keeps. A run whose f is alone is in neither.
    """
    where = ["dk", "th", "s", "n"]
    per_f = runs.groupBy("f").agg(
        F.count(F.lit(1)).alias("runs"), F.min("k").alias("low"), F.max("k").alias("high")
    )
    per_f = materialized(per_f.where("runs > 1").selectExpr("f", "low != high AS many"))
    more = [c for c in runs.columns if c not in ("f", "k", *where)]
    hits = materialized(runs.join(per_f, "f"))
    classes = hits.where("many").groupBy("f", "k")
    classes = materialized(
        classes.agg(F.count(F.lit(1)).alias("runs"), F.min(F.struct(*where, *more)).alias("one"))
    )
    again = hits.join(classes.where("runs > 1").select("f", "k"), ["f", "k"], "left_semi")
    whole = hits.where("NOT many").select(*where).unionAll(again.select(*where))
    return whole, classes.select("f", "one.*")


def _halves(runs: DataFrame) -> DataFrame:
    """The parts of every run on either side of the middle of its anchor's distances.

    The windows of an anchor are ``low`` to ``high`` bytes before it; a run's first is ``o``
    before it. What the windows of half of the distances share is the same for equal
    windows, whatever run they are in.
    """
    middle, at = F.expr("(low + high) div 2"), F.col("o")
    split = runs.withColumn("middle", middle).withColumn(
        "far", F.greatest(F.lit(0), F.least(F.col("n"), at - F.col("middle")))
    )

    def half(side: int, first: Column, windows: Column, low: Column, high: Column) -> DataFrame:
        def cut(start: Column, size: Column) -> Column:
            return F.col("context").substr((start + 1).cast("int"), size.cast("int"))

        shared = cut(at - low, low + LENGTH - high)
        text = cut(first, windows + LENGTH - 1)
        return split.where(windows > 0).select(
            F.xxhash64("f", F.lit(side), shared).alias("f"),
            F.xxhash64(text, at - first).alias("k"),
            "dk",
            "th",
            (F.col("s") + first).alias("s"),
            windows.alias("n"),
            (at - first).alias("o"),
            low.alias("low"),
            high.alias("high"),
            text.alias("context"),
        )

    far, middle = F.col("far"), F.col("middle")
    return half(0, F.lit(0), far, middle + 1, F.col("high")).unionAll(
        half(1, far, F.col("n") - far, F.col("low"), middle)
    )


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long matches of rows sorted by f, whole groups at a time."""
    rows: list[tuple] = []
    size = 0

    def matched() -> pa.RecordBatch:
        index = RunIndex([row[4] for row in rows], LENGTH)
        found = [
            (rows[k][1], rows[k][2], rows[k][3] + first, last - first + 1)
            for k, first, last in index.long_matches()
        ]
        columns = list(zip(*found)) or [[]] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], ["dk", "th", "s", "n"]
        )

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("f", "dk", "th", "s", "context"))):
            if size >= INDEXED and row[0] != rows[-1][0]:
                yield matched()
                rows, size = [], 0
            rows.append(row)
            size += len(row[4])
    if rows:
        yield matched()


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(dk, th, s, n): n windows from byte s of the text with that key start elsewhere too.

    Ranges may overlap and may come more than once.
    """
    runs = _keyed(docs).mapInArrow(_runs, _RUNS)
    whole, differing = _decided(materialized(runs))
    found = [whole]

    wanted = differing.groupBy("dk", "th").agg(
        F.collect_list(F.struct("f", "s", "n", "o")).alias("runs")
    )
    context = F.expr(
        f"substring(CAST(text AS BINARY), CAST(s AS INT) + 1, CAST(n AS INT) + {LENGTH - 1})"
    )
    left = materialized(
        _keyed(docs)
        .join(wanted, ["dk", "th"])
        .selectExpr("dk", "th", "text", "inline(runs)")
        .selectExpr("*", "0L AS low", f"{LENGTH - GRAM}L AS high")
        .select("f", "dk", "th", "s", "n", "o", "low", "high", context.alias("context"))
    )
    while True:
        sizes = materialized(left.groupBy("f").agg(F.count(F.lit(1)).alias("runs")))
        large = materialized(sizes.where(F.col("runs") > GROUP).select("f"))
        small = left.join(large, "f", "left_anti").select("f", "dk", "th", "s", "context")
        grouped = small.repartition("f").sortWithinPartitions("f")
        matched = grouped.mapInArrow(_index, "dk bigint, th bigint, s bigint, n bigint")
        found.append(materialized(matched))
        if large.isEmpty():
            return reduce(DataFrame.unionAll, found)
        whole, left = _decided(materialized(_halves(left.join(large, "f", "left_semi"))))
        found.append(whole)


def _kept(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, ranges in zip(utf8_rows(texts), spans.to_pylist()):
        kept, end, n_spans, removed = [], 0, 0, 0
        for start, stop in sorted((r["s"], r["s"] + r["n"] + LENGTH - 1) for r in ranges or ()):
            if start > end or not n_spans:
                kept.append(text[end:start])
                n_spans += 1
                end = start
            if stop > end:
                removed += stop - end
                end = stop
        kept.append(text[end:])
        out.append((removed, n_spans, b"".join(kept)))
    kind = pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
    return pa.array(out, kind)


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of ``docs``.

    ``kept`` is binary: what is left need not be whole characters. A null text counts as
    empty; texts shorter than LENGTH bytes stay whole. Rows that repeat a row have each
    other as elsewhere, so they lose everything if they are long enough; every row comes
    back once.
    """
    spans = repeated_windows(docs).distinct()
    spans = spans.groupBy("dk", "th").agg(F.collect_list(F.struct("s", "n")).alias("spans"))
    rows = _keyed(docs, "doc_id").join(materialized(spans), ["dk", "th"], "left")
    done = F.arrow_udf(_kept, "struct<n_removed: bigint, n_spans: bigint, kept: binary>")
    done = done.asNondeterministic()(F.col("text"), F.col("spans"))
    size = F.octet_length("text").cast("bigint").alias("n_bytes")
    return rows.select("doc_id", size, done.alias("done")).select("doc_id", "n_bytes", "done.*")
