"""Exact top-k inner products by a bit-sliced index.

Rows are dealt into blocks. A block's index holds, for every attribute, its leading bits as
bitmaps over the block's rows (slices), beside the whole integers. For a query the slices
are added up with bitmap arithmetic: attribute times weight is the sum of the slices shifted
by the weight's set bits, negative weights take the complement, and all slices of one weight
are reduced three to two by full adders. The sums, bit-sliced too, are searched from the most
significant slice downward for the k-th largest; every row that the bits left out could lift
to it is a boundary row and gets its exact score. So the result is exact.

Queries go against all rows in blocks: a pair of a block of queries and a block of rows is
one unit of work of bounded size, dealt by the pair. It returns at most k rows per query,
and Spark keeps the best k of all units.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from factlake.llm.common import materialized

K = 10
SCALE = 1024
BLOCK_ROWS = 4096
#: An index block travels once per block of queries, so these are as large as one of rows.
QUERY_ROWS = 4096
KEPT_BITS = 5
_INDEX = (
    "block bigint, ids binary, width int, item int, vectors binary, low binary, shift int, "
    "slices binary"
)


def quantised(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x: array of floor(SCALE * component)) of the rows that take part.

    Rows without id and vectors that are null or hold a null or non-finite component don't.
    """
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(SCALE * c.cast("double")))
    takes_part = F.col(vec_id).isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False))
    rows = vectors.where(takes_part)
    return rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), whole.alias("x"))


def _matrix(rows: list, width: int) -> np.ndarray:
    """Shorter vectors are padded with zeros, which add nothing to a product."""
    out = np.zeros((len(rows), width), dtype=np.int64)
    for k, row in enumerate(rows):
        out[k, : len(row)] = row[:width]
    return out


def _packed(bits: np.ndarray) -> np.ndarray:
    """0/1 over the last axis as 64-bit words."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    missing = -packed.shape[-1] % 8
    padded = np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, missing)])
    return np.ascontiguousarray(padded).view(np.uint64)


def _index_of(block: pd.DataFrame) -> pd.DataFrame:
    x = _matrix(list(block["x"]), max(map(len, block["x"])))
    low = x.min(axis=0) if x.size else np.zeros(x.shape[1], dtype=np.int64)
    above = (x - low).astype(np.uint64)
    shift = max(0, int(above.max(initial=0)).bit_length() - KEPT_BITS)
    kept = (above >> np.uint64(shift)).T
    levels = np.arange(KEPT_BITS, dtype=np.uint64)[None, :, None]
    slices = _packed(((kept[:, None, :] >> levels) & np.uint64(1)).astype(np.uint8))
    kind = next(k for k in (np.int16, np.int32, np.int64) if (x == x.astype(k)).all())
    return pd.DataFrame(
        {
            "block": [block["block"].iloc[0]],
            "ids": [block["vec_id"].to_numpy(np.int64).tobytes()],
            "width": [x.shape[1]],
            "item": [np.dtype(kind).itemsize],
            "vectors": [x.astype(kind).tobytes()],
            "low": [low.tobytes()],
            "shift": [shift],
            "slices": [slices.tobytes()],
        }
    )


class BlockIndex:
    """A block's slices, with the arithmetic on them."""

    def __init__(self, row) -> None:
        self.ids = np.frombuffer(row.ids, dtype=np.int64)
        self.width, self.shift = int(row.width), int(row.shift)
        kind = {2: np.int16, 4: np.int32, 8: np.int64}[int(row.item)]
        self.vectors = np.frombuffer(row.vectors, dtype=kind).reshape(len(self.ids), self.width)
        words = -(-len(self.ids) // 64)
        self.slices = np.frombuffer(row.slices, dtype=np.uint64).reshape(
            self.width, KEPT_BITS, words
        )
        self.every = _packed(np.ones((1, len(self.ids)), dtype=np.uint8))[0]

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the sum of |weight| times kept bits.

        A negative weight counts how far an attribute is from its largest kept value.
        """
        terms = np.where((query < 0)[:, None, None], self.every & ~self.slices, self.slices)
        weight = np.abs(query)
        carried: list[np.ndarray] = []
        out, at = [], 0
        top = int(weight.max(initial=0)).bit_length() + KEPT_BITS
        while at < top or carried:
            level = carried
            carried = []
            for bit in range(KEPT_BITS):
                if at - bit >= 0:
                    level = [*level, terms[(weight >> (at - bit)) & 1 == 1, bit]]
            x = np.concatenate(level) if level else np.zeros((0, len(self.every)), np.uint64)
            while len(x) > 1:
                if len(x) == 2:
                    carried.append(x[:1] & x[1:])
                    x = x[:1] ^ x[1:]
                    break
                n = len(x) // 3
                a, b, c = x[:n], x[n : 2 * n], x[2 * n : 3 * n]
                half = a ^ b
                carried.append((a & b) | (c & half))
                x = np.concatenate([half ^ c, x[3 * n :]])
            out.append(x[0] if len(x) else np.zeros(len(self.every), np.uint64))
            at += 1
        return out

    def boundary(self, query: np.ndarray, valid: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the k best: found from the top slice downward."""
        sums = self.sums(query)
        above, equal, kth = np.zeros_like(valid), valid, 0
        for level in range(len(sums) - 1, -1, -1):
            more = above | (equal & sums[level])
            if int(np.bitwise_count(more).sum()) >= k:
                equal = equal & sums[level]
                kth |= 1 << level
            else:
                above, equal = more, equal & ~sums[level]
        # What the bits left out can add, in units of the kept ones.
        weight = int(np.abs(query).astype(object).sum())
        slack = (((1 << self.shift) - 1) * weight >> self.shift) + 1
        least = max(0, kth - slack)
        above, equal = np.zeros_like(valid), valid
        for level in range(len(sums) - 1, -1, -1):
            if least >> level & 1:
                equal = equal & sums[level]
            else:
                above, equal = above | (equal & sums[level]), equal & ~sums[level]
        found = np.unpackbits((above | equal).view(np.uint8), bitorder="little")
        return np.flatnonzero(found[: len(self.ids)])

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows but the query's own, ties to the smaller id."""
        query = np.pad(query[: self.width], (0, max(0, self.width - len(query))))
        valid = self.every
        own = np.flatnonzero(self.ids == query_id)
        if len(own):
            valid = valid.copy()
            for row in own.tolist():
                valid[row >> 6] &= ~np.uint64(1 << (row & 63))
        rows = self.boundary(query, valid, k)
        scores = self.vectors[rows].astype(np.int64) @ query
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][order], scores[order]


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """The index table, written to the shared folder, of ``quantised`` rows; its blocks."""
    n = max(1, -(-vectors.count() // block_rows))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", "x"), F.lit(n)))
    return materialized(dealt.groupBy("block").applyInPandas(_index_of, _INDEX)), n


def _search(k: int):
    def of_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                index = BlockIndex(row)
                for query in row.queries:
                    x = np.asarray(query["x"], dtype=np.int64)
                    ids, scores = index.best(query["vec_id"], x, k)
                    yield pd.DataFrame(
                        {"query_id": query["vec_id"], "vec_id": ids, "score": scores}
                    )

    return of_pairs


def top_k(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = K,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of every query's k best rows but its own.

    ``is_query`` is a condition on vec_id. With fewer other rows, all of them are returned;
    an empty table gives an empty result. Rows that repeat an id are rows of their own, and
    a query leaves out all rows of its id. Vectors of unequal length are compared as if the
    shorter one went on with zeros. Scores are longs, modulo 2^64.
    """
    vectors = materialized(vectors)
    index, n_blocks = build_index(vectors, block_rows)
    queries = vectors.where(is_query).dropDuplicates(["vec_id"])
    n_queries = max(1, -(-queries.count() // query_rows))
    dealt = queries.withColumn("queries_no", F.pmod(F.xxhash64("vec_id"), F.lit(n_queries)))
    grouped = dealt.groupBy("queries_no").agg(
        F.collect_list(F.struct("vec_id", "x")).alias("queries")
    )
    grouped = materialized(grouped)
    spark = vectors.sparkSession
    parts = min(n_blocks * n_queries, 8 * spark.sparkContext.defaultParallelism)
    numbers = lambda n: F.explode(F.expr(f"sequence(0L, {n - 1}L)"))
    of_rows = index.withColumn("queries_no", numbers(n_queries))
    of_queries = grouped.withColumn("block", numbers(n_blocks))
    pair = ["block", "queries_no"]
    units = of_rows.repartition(parts, *pair).join(of_queries.repartition(parts, *pair), pair)
    found = units.mapInPandas(_search(k), "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
