"""SimHash near-duplicates by a self-join of the binary trie of all fingerprints.

The trie's upper levels are joined by Spark: a fingerprint goes to its own block (a trie
node at depth BLOCK_BITS) and to every block that differs from it in few enough bits. Blocks
with too many keys are split further down. Below that, each task walks pairs of nodes of its block together, adds up differing bits and
leaves a pair as soon as the bits exceed the budget.

Two tries are walked, one over the bits as they are and one with the halves exchanged: of
two fingerprints at most ``distance`` bits apart, one half differs in at most
``distance // 2`` bits. So the budget is small in the half that is walked first, where the
trie branches, and the whole ``distance`` only below; no pair is lost.

A task writes a spanning forest of the links it found, not every pair: as many links as
its block has fingerprints, at most, however large a group of near copies is. Exact
copies are one fingerprint from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from factlake.llm.common import column_udf, fresh, materialized, utf8_rows
from factlake.llm.components import components

WORDS = 4
DISTANCE = 4
SEED = 42
BITS = 64
HALF = BITS // 2
BLOCK_BITS = 10
#: Keys of a group of blocks that one task walks; more are split at so many further bits.
MOST_ROWS = 200_000
SPLIT_BITS = 6
FRONTIER = 1 << 15
SMALL = 64
CHUNK = 1 << 15


def fingerprint_of(text: bytes, words: int = WORDS) -> int:
    """64 bits, each set if over half of the shingles' hashes have it set; 0 if no word."""
    found = text.lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not found:
        return 0
    joined = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size).tolist()
    ends = ends.tolist()[min(words, len(found)) - 1 :]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(ends), CHUNK):
        part = zip(starts[at : at + CHUNK], ends[at : at + CHUNK])
        hashes = np.array([digest(joined[s:e], SEED) for s, e in part], dtype=">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(total * 2 > len(ends)).tobytes(), "big")


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """The fingerprint as a signed long; a null text counts as empty."""

    def of_batch(texts: pa.Array) -> pa.Array:
        found = [fingerprint_of(row, words) for row in utf8_rows(texts)]
        return pa.array(np.array(found, dtype=np.uint64).view(np.int64))

    return column_udf(of_batch, "bigint")(text)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class _Forest:
    """Spanning forest over 0..n-1, fed with arrays of links."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                break
            high, low = np.maximum(a, b), np.minimum(a, b)
            np.minimum.at(self.root, high, low)
            while True:
                above = self.root[self.root]
                if (above == self.root).all():
                    break
                self.root = above


def _pairs(xl, xh, yl, yh):
    """All index pairs of the ranges [xl, xh) x [yl, yh)."""
    nx, ny = xh - xl, yh - yl
    size = nx * ny
    which = np.repeat(np.arange(len(size)), size)
    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return xl[which] + k // ny[which], yl[which] + k % ny[which]


def walk(
    keys: np.ndarray, n_own: int, first_half: int, distance: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of linked keys (an own key and any key), pair of nodes by pair of nodes.

    ``keys``: the own keys sorted, then all keys of the block's neighbourhood sorted. A
    node is a range of equal leading bits; the stack holds bounded frontiers, depth first.
    """
    own, rest = keys[:n_own], keys[n_own:]
    one = np.uint64(1)
    zeros: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def split(which: int, depth: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if depth not in zeros:
            shift = np.uint64(BITS - 1 - depth)
            zeros[depth] = tuple(
                np.concatenate([[0], np.cumsum(((part >> shift) & one) == 0)])
                for part in (own, rest)
            )
        count = zeros[depth][which]
        return low + count[high] - count[low]

    start = tuple(np.array([x]) for x in (0, len(own), 0, len(rest), 0))
    stack = [(0, start)]
    while stack:
        depth, (xl, xh, yl, yh, bits) = stack.pop()
        if len(xl) > FRONTIER:
            half = len(xl) // 2
            stack += [
                (depth, tuple(c[:half] for c in (xl, xh, yl, yh, bits))),
                (depth, tuple(c[half:] for c in (xl, xh, yl, yh, bits))),
            ]
            continue
        whole = bits + (BITS - depth) <= distance
        if whole.any():  # nothing below can exceed the budget: a star says it all
            for a, b, c, d in zip(xl[whole], xh[whole], yl[whole], yh[whole]):
                yield np.full(d - c, a), n_own + np.arange(c, d)
                yield np.arange(a, b), np.full(b - a, n_own + c)
        small = ~whole & ((xh - xl) * (yh - yl) <= SMALL)
        if small.any():
            a, b = _pairs(xl[small], xh[small], yl[small], yh[small])
            apart = own[a] ^ rest[b]
            near = (_bits(apart) <= distance) & (
                _bits(apart >> np.uint64(HALF)) <= first_half
            )
            yield a[near], n_own + b[near]
        go = ~whole & ~small
        if not go.any():
            continue
        xl, xh, yl, yh, bits = (c[go] for c in (xl, xh, yl, yh, bits))
        xm, ym = split(0, depth, xl, xh), split(1, depth, yl, yh)
        children = [
            (xl, xm, yl, ym, bits),
            (xm, xh, ym, yh, bits),
            (xl, xm, ym, yh, bits + 1),
            (xm, xh, yl, ym, bits + 1),
        ]
        joined = tuple(np.concatenate(c) for c in zip(*children))
        budget = first_half if depth < HALF else distance
        fine = (joined[0] < joined[1]) & (joined[2] < joined[3]) & (joined[4] <= budget)
        if fine.any():
            stack.append((depth + 1, tuple(c[fine] for c in joined)))


def _swapped(keys: np.ndarray) -> np.ndarray:
    return (keys << np.uint64(HALF)) | (keys >> np.uint64(HALF))


def _links_in_block(budgets: tuple[int, int], distance: int):
    def of_block(block: pd.DataFrame) -> pd.DataFrame:
        swap = bool(block["swapped"].iloc[0])
        keys = block["fp"].to_numpy(np.int64).view(np.uint64)
        keys = _swapped(keys) if swap else keys
        own = np.sort(keys[block["own"].to_numpy(bool)])
        every = np.sort(keys)
        both = np.concatenate([own, every])
        forest = _Forest(len(both))
        forest.link(np.arange(len(own)), len(own) + np.searchsorted(every, own))
        for a, b in walk(both, len(own), budgets[swap], distance):
            forest.link(a, b)
        found = np.flatnonzero(forest.root != np.arange(len(both)))
        u, v = both[found], both[forest.root[found]]
        u, v = (_swapped(x) if swap else x for x in (u[u != v], v[u != v]))
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return of_block


def _masks(bits: int, most: int) -> Column:
    """All (mask, used): numbers of so many bits with at most ``most`` of them set."""
    return F.array(
        *[
            F.struct(F.lit(sum(1 << k for k in chosen)).cast("bigint").alias("mask"), F.lit(n).alias("used"))
            for n in range(most + 1)
            for chosen in combinations(range(bits), n)
        ]
    )


def _lead(swapped: int, depth: int, bits: int) -> Column:
    """The bits below ``depth`` of the half that this trie starts with."""
    top = F.shiftrightunsigned("fp", (HALF if swapped else BITS) - depth - bits)
    return top.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def _first_blocks(prints: DataFrame, swapped: int, budget: int) -> DataFrame:
    """Every key in its own block and in those above it that differ in few enough bits."""
    home = prints.select("fp", _lead(swapped, 0, BLOCK_BITS).alias("home"))
    spread = home.select("*", F.inline(_masks(BLOCK_BITS, budget)))
    # Each pair of blocks once.
    spread = spread.withColumn("block", F.col("home").bitwiseXOR(F.col("mask"))).where("block <= home")
    return spread.select(
        "fp", "block", (F.col("mask") == 0).alias("own"), (F.lit(budget) - F.col("used")).alias("left")
    )


def _deeper(rows: DataFrame, swapped: int, depth: int, budget: int) -> DataFrame:
    """Rows of blocks at ``depth``, dealt to the nodes SPLIT_BITS below."""
    rows = rows.withColumn("home", _lead(swapped, depth, SPLIT_BITS))
    spread = rows.select("*", F.inline(_masks(SPLIT_BITS, budget))).where("used <= left")
    spread = spread.withColumn("node", F.col("home").bitwiseXOR(F.col("mask")))
    spread = spread.where("NOT own OR node <= home")  # pairs of own keys once
    return spread.select(
        "fp",
        (F.shiftleft("block", SPLIT_BITS) + F.col("node")).alias("block"),
        (F.col("own") & (F.col("mask") == 0)).alias("own"),
        (F.col("left") - F.col("used")).alias("left"),
    )


def blocks_of(prints: DataFrame, distance: int, most_rows: int) -> DataFrame:
    """(fp, swapped, depth, block, own): the groups that are walked.

    A group of more than ``most_rows`` keys is split at further leading bits of the trie,
    where a key goes only to nodes that its bits so far leave a budget for; down to 28 of the
    32 bits that a trie starts with.
    """
    out = []
    for swapped, budget in enumerate((distance // 2, distance - distance // 2 - 1)):
        if budget < 0:
            continue
        rows, depth = _first_blocks(prints, swapped, budget), BLOCK_BITS
        while True:
            if depth + SPLIT_BITS > HALF:
                large = None
            elif depth == BLOCK_BITS:
                # From the sizes of the blocks, without making their rows.
                sizes = prints.groupBy(_lead(swapped, 0, BLOCK_BITS).alias("home")).count()
                sizes = sizes.select("*", F.inline(_masks(BLOCK_BITS, budget)))
                sizes = sizes.withColumn("block", F.col("home").bitwiseXOR(F.col("mask")))
                large = sizes.where("block <= home").groupBy("block").agg(F.sum("count").alias("n"))
            else:
                large = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
            done = rows
            if large is not None:
                large = materialized(large.where(F.col("n") > most_rows).select("block"))
                if large.isEmpty():
                    large = None
                else:
                    done = rows.join(large, "block", "left_anti")
            out.append(
                done.select("fp", F.lit(swapped).alias("swapped"), F.lit(depth).alias("depth"), "block", "own")
            )
            if large is None:
                break
            rows = materialized(_deeper(rows.join(large, "block", "left_semi"), swapped, depth, budget))
            depth += SPLIT_BITS
    return reduce(DataFrame.unionAll, out)


def near_links(
    prints: DataFrame, distance: int = DISTANCE, most_rows: int = MOST_ROWS
) -> DataFrame:
    """Links (u, v) that connect the distinct longs ``fp`` exactly as all pairs within
    ``distance`` bits would."""
    budgets = (distance // 2, distance - distance // 2 - 1)
    groups = blocks_of(prints, distance, most_rows).groupBy("swapped", "depth", "block")
    return groups.applyInPandas(_links_in_block(budgets, distance), "u bigint, v bigint")


def near_duplicates(
    docs: DataFrame, *, words: int = WORDS, distance: int = DISTANCE
) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most ``distance`` bits.
    Null and empty texts have fingerprint 0 and are linked like any other; rows whose
    doc_id is null are linked too, but never name a component (null if it has no other id).
    Repeated rows come back as often as they went in; other columns are not looked at.
    """
    prints = materialized(
        docs.select("doc_id", fingerprint(F.col("text"), words).alias("fp"))
    )
    _, named = _named(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), distance)
    return prints.join(named, "fp").select("doc_id", "fp", F.col("named").alias("component_id"))


def _named(grouped: DataFrame, distance: int) -> tuple[DataFrame, DataFrame]:
    """(fp, least) written, and (fp, named): the smallest ``least`` of the component."""
    nodes = materialized(grouped)
    linked = materialized(components(near_links(nodes.select("fp"), distance)))
    rooted = nodes.join(linked, nodes["fp"] == linked["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    names = materialized(rooted.groupBy("root").agg(F.min("least").alias("named")))
    return nodes, materialized(rooted.join(names, "root").select("fp", "named"))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_per_group(
    docs: DataFrame, *, words: int = WORDS, distance: int = DISTANCE
) -> DataFrame:
    """One row of ``docs`` for each component; copies go.

    The row that stays is that with the smallest doc_id, and of rows that share this id with
    different texts that with the smallest hash of its text: they are documents of their own
    and each stands in the component of its own text. Rows equal in doc_id and text are one.
    Rows without a doc_id can't be named as the one that stays, so all of them stay.
    """
    of, key = fresh("id"), fresh("key")
    text_key = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.where(F.col("doc_id").isNotNull())
    prints = rows.select("doc_id", text_key.alias("key"), fingerprint(F.col("text"), words).alias("fp"))
    least = prints.groupBy("fp").agg(F.min(F.struct("doc_id", "key")).alias("least"))
    _, named = _named(least, distance)
    stays = materialized(named.select(F.col("named.doc_id").alias(of), F.col("named.key").alias(key)).distinct())
    same = (F.col("doc_id") == F.col(of)) & (F.col(key) == text_key)
    kept = rows.join(stays, same).dropDuplicates([of, key]).drop(of, key)
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))
