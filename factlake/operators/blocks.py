"""An inverted index in blocks of bounded size, searched by weights with numpy inside a task.

A block holds some entries, numbered in the order of their ids, and for each token the sorted
numbers (places) of those that have it. Claims are dealt into parts; every part meets every
block, and a pair of both is one task's work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, GroupedData, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from factlake.functions import fixed_values as fv

#: Entries of a block, and claims of a part: most, and how many are worth a part of their own.
BLOCK, PART, SMALL_PART = 1 << 19, 1 << 17, 1 << 11
#: Postings of a block, at most on average.
POSTINGS = 1 << 25
#: Pairs of parts and blocks that there should be, so that all cores have work.
PAIRS = 32
#: Partitions for each of the groups that are a task each, and most partitions.
SPREAD, MOST_PARTITIONS = 4, 1 << 12
#: A list so many times longer than all that was seen isn't gone through.
LONG_LIST = 12
_CLAIM_KEY = ["answer_id", "claim_index"]


def inverted_blocks(entries: DataFrame, tokens: str, size: int = BLOCK) -> DataFrame:
    """``block, token, places and kb_ids, credibilities`` of ``entries`` (kb_id, credibility, tokens).

    ``places`` are the bytes of sorted 32-bit numbers. Ids and credibilities are in one row of a
    block, without a token, by place.
    """
    held = entries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(tokens)), F.lit(0))).first()
    blocks = max(1, -(-held[0] // size), -(-held[1] // POSTINGS))
    block = F.pmod(F.xxhash64("kb_id"), F.lit(blocks)).cast("int").alias("block")
    placed = entries.select(block, "kb_id", "credibility", F.col(tokens).alias("tokens"))
    schema = StructType(
        [
            StructField("block", IntegerType()),
            StructField("token", placed.schema["tokens"].dataType.elementType),
            StructField("places", BinaryType()),
            StructField("kb_ids", ArrayType(placed.schema["kb_id"].dataType)),
            StructField("credibilities", ArrayType(DoubleType())),
        ]
    )
    return _by_pair(placed, ("block",), blocks).applyInArrow(_inverted, schema)


def _by_pair(rows: DataFrame, key: tuple[str, ...], pairs: int) -> GroupedData:
    """The rows grouped by ``key``, in so many partitions that hardly two groups share one."""
    return rows.repartition(min(SPREAD * pairs, MOST_PARTITIONS), *key).groupBy(*key)


def _inverted(entries: pa.Table) -> pa.Table:
    order = [("kb_id", "ascending"), ("credibility", "ascending")]
    entries = entries.take(pc.sort_indices(entries, sort_keys=order, null_placement="at_start"))
    offsets, tokens = _lists(entries, "tokens")
    place = np.repeat(np.arange(entries.num_rows, dtype="<i4"), np.diff(offsets))
    tokens = tokens[offsets[0] : offsets[-1]]
    # Stable: the places of a token stay in order.
    order = np.argsort(tokens, kind="stable")
    tokens, place = tokens[order], place[order]
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else order
    ends = np.concatenate([starts, [len(tokens)]]).astype("int64") * place.itemsize
    places = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(place)]
    ).cast(pa.binary())
    block, n = entries["block"][0], len(starts)

    def names(column: str) -> pa.Array:
        values = _column(entries, column)
        ends = pa.array(np.array([0] * (n + 1) + [len(values)], "int32"))
        none = pa.array(np.arange(n + 1) < n)
        return pa.ListArray.from_arrays(ends, values, mask=none)

    return pa.table(
        {
            "block": pa.repeat(block, n + 1),
            "token": pa.concat_arrays([pa.array(tokens[starts]), pa.nulls(1, pa.from_numpy_dtype(tokens.dtype))]),
            "places": pa.concat_arrays([places, pa.nulls(1, pa.binary())]),
            "kb_ids": names("kb_id"),
            "credibilities": names("credibility"),
        }
    )


def search_blocks(claims: DataFrame, blocks: DataFrame, k: int, tie: float) -> DataFrame:
    """``answer_id, claim_index, total, kb_id, credibility, weight``: entries that may be among the
    best k of their claim.

    ``claims`` has ``total``, ``least`` (the score to reach, or null), ``tokens`` and their
    ``weights``, the heaviest first. Of each block come the best k, and those whose score
    differs by no more than ``tie`` from the k-th best; of equal scores the first k ids.
    Entries that share one token with the claim may be missing.

    A pair of a part and a block is a task of its own, whatever the number of shuffle partitions.
    """
    n_blocks = blocks.agg(F.max("block")).first()[0] + 1
    n_claims = claims.count()
    wished = min(-(-PAIRS // n_blocks), -(-n_claims // SMALL_PART))
    parts = max(1, wished, -(-n_claims // PART))
    looked_for = blocks.join(
        claims.select(F.explode("tokens").alias("token")).distinct(), "token", "left_semi"
    ).unionByName(blocks.where("token IS NULL"))
    part = F.pmod(F.xxhash64(*_CLAIM_KEY), F.lit(parts)).cast("int").alias("part")
    left = claims.select("*", part).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    )
    right = looked_for.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    ids = next(f for f in blocks.schema if f.name == "kb_ids").dataType.elementType
    schema = StructType(
        [claims.schema[c] for c in (*_CLAIM_KEY, "total")]
        + [StructField("kb_id", ids), StructField("credibility", DoubleType()), StructField("weight", LongType())]
    )

    def search(claims: pa.Table, block: pa.Table) -> pa.Table:
        return _search(claims, block, k, tie)

    pair, pairs = ("part", "block"), parts * n_blocks
    both = _by_pair(left, pair, pairs).cogroup(_by_pair(right, pair, pairs))
    return both.applyInArrow(search, schema)


def _column(table: pa.Table, name: str):
    column = table[name].combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a column of arrays."""
    column = _column(table, name)
    return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)


def _numbers(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a column of the bytes of 32-bit numbers."""
    column = _column(table, name).cast(pa.large_binary())
    _, offsets, values = column.buffers()
    if not len(column):
        return np.zeros(1, "int64"), np.zeros(0, np.intp)
    offsets = np.frombuffer(offsets, "int64")[column.offset : column.offset + len(column) + 1] // 4
    return offsets, np.frombuffer(values, "<i4", count=int(offsets[-1])).astype(np.intp)


def _search(claims: pa.Table, block: pa.Table, k: int, tie: float) -> pa.Table:
    if not (claims.num_rows and block.num_rows):
        named, ids = pa.array([], pa.int64()), pa.nulls(0, block.schema.field("kb_ids").type.value_type)
        return _answer(claims, named, ids, np.zeros(0), np.zeros(0, "int64"))
    names = block["token"].is_null().to_numpy()
    at = int(np.flatnonzero(names)[0])
    ids = _column(block, "kb_ids")[at].values
    credibility = _column(block, "credibilities")[at].values.to_numpy(zero_copy_only=False)
    # What credibility is worth in shared weight, for a claim of total 1.
    extra = fv.KB_CREDIBILITY_WEIGHT / fv.RELEVANCE_WEIGHT * credibility
    most = extra.max()

    posted = block.filter(block["token"].is_valid())
    starts, places = _numbers(posted, "places")
    token = posted["token"].to_numpy()
    order = np.argsort(token)
    offsets, tokens = _lists(claims, "tokens")
    weights = _lists(claims, "weights")[1]
    # For each token of a claim its row here; those that the block hasn't got are left out.
    found = np.searchsorted(token[order], tokens)
    row = order[np.minimum(found, len(order) - 1)] if len(order) else np.zeros(len(tokens), "int64")
    known = (token[row] == tokens) if len(order) else np.zeros(len(tokens), bool)
    total = claims["total"].to_numpy().astype("float64")
    least = claims["least"].to_numpy(zero_copy_only=False).astype("float64")
    least[np.isnan(least)] = -np.inf
    # The same for the score to reach, with a margin for the rounding of doubles.
    needed = (least / fv.RELEVANCE_WEIGHT - 1e-9) * total
    running = np.concatenate([[0], np.cumsum(np.where(known, weights, 0))])
    some = np.concatenate([[0], np.cumsum(known)])
    ends = offsets[1:], offsets[:-1]
    hopeful = (running[ends[0]] - running[ends[1]] + most * total >= needed) & (some[ends[0]] - some[ends[1]] >= 2)

    def best(found: list) -> tuple[np.ndarray, ...]:
        """Of what was found for some claims each one's best."""
        claim, place, weight = (np.concatenate(c) for c in zip(*found))
        score = fv.RELEVANCE_WEIGHT * (weight / total[claim]) + fv.KB_CREDIBILITY_WEIGHT * credibility[place]
        order = np.lexsort((place, -score, claim))
        claim, place, weight, score = claim[order], place[order], weight[order], score[order]
        number = np.arange(len(claim))
        new = np.concatenate([[True], claim[1:] != claim[:-1]])
        first = np.flatnonzero(new)
        kth = np.full(len(first), -np.inf)
        some = np.diff(np.concatenate([first, [len(claim)]])) >= k
        kth[some] = score[first[some] + k - 1]
        lowest = np.maximum(least[claim], (kth - tie)[np.cumsum(new) - 1])
        level = new | np.concatenate([[True], score[1:] != score[:-1]])
        kept = (score >= lowest) & (number - np.maximum.accumulate(np.where(level, number, 0)) < k)
        return claim[kept], place[kept], weight[kept]

    sums = np.zeros(len(credibility), "int64")
    out, found, n_found = [], [], 0
    for claim in np.flatnonzero(hopeful).tolist():
        mine = slice(offsets[claim], offsets[claim + 1])
        there = known[mine]
        rows, heavy = row[mine][there], weights[mine][there].tolist()
        lists = [places[i:j] for i, j in zip(starts[rows].tolist(), starts[rows + 1].tolist())]
        slack = (tie / fv.RELEVANCE_WEIGHT + 1e-9) * total[claim]
        seen, weight = _shared(lists, heavy, float(needed[claim]), total[claim], extra, most, k, slack, sums)
        if len(seen):
            found.append((np.full(len(seen), claim), seen, weight))
            n_found += len(seen)
        if n_found > BLOCK:
            out.append(best(found))
            found, n_found = [], 0
    if found:
        out.append(best(found))
    claim, place, weight = (np.concatenate(c) if out else np.zeros(0, "int64") for c in (zip(*out) if out else "abc"))
    return _answer(claims, pa.array(claim), ids.take(pa.array(place)), credibility[place], weight)


def _shared(
    lists: list[np.ndarray],
    weights: list[int],
    needed: float,
    total: float,
    extra: np.ndarray,
    most: float,
    k: int,
    slack: float,
    sums: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Places and their shared weights, of all that may be among the best k and reach ``needed``,
    which counts ``total`` times ``extra`` of the place as well, with two tokens or more. ``most``
    is the highest ``extra``.

    ``sums`` is all zero before and after. Of a list only those places cost more than one look
    that an earlier list has, too.
    """
    left, rest = [0] * (len(weights) + 1), 0
    for i in range(len(weights) - 1, -1, -1):
        left[i] = rest = rest + weights[i]
    top, begin, several = total * most, 0, []
    # An entry whose heaviest shared token is this one has at most what is left from it on.
    while begin == 0 or (begin < len(lists) - 1 and left[begin] + top >= needed):
        some, weight = lists[begin], weights[begin]
        if begin:
            so_far = sums[some]
            at = np.flatnonzero(so_far)
            so_far += weight
            sums[some] = so_far
            if len(at):
                hit, so_far = some[at], so_far[at]
                several.append(hit)
                if len(at) >= k:
                    worth = so_far + total * extra[hit]
                    worth.partition(len(worth) - k)
                    needed = max(needed, worth[-k] - slack)
        else:
            sums[some] = weight
        begin += 1
    first, before = lists[:begin], None
    n_first = sum(map(len, first))
    for i in range(begin, len(lists)):
        some = lists[i]
        if len(some) > LONG_LIST * n_first:
            # Those seen so far are looked up in the list instead.
            before = np.unique(np.concatenate(first)) if before is None else before
            at = np.minimum(np.searchsorted(some, before), len(some) - 1)
            hit = before[some[at] == before]
        else:
            hit = some[np.flatnonzero(sums[some])]
        if len(hit):
            sums[hit] += weights[i]
            several.append(hit)
    hopeful = np.concatenate(several) if several else np.zeros(0, np.intp)
    weight = sums[hopeful]
    may = weight + total * extra[hopeful] >= needed
    hopeful, at = np.unique(hopeful[may], return_index=True)
    weight = weight[may][at]
    for some in first:
        sums[some] = 0
    return hopeful, weight


def _answer(claims: pa.Table, claim: pa.Array, ids: pa.Array, credibility, weight) -> pa.Table:
    columns = {c: claims[c].take(claim) for c in (*_CLAIM_KEY, "total")}
    return pa.table(columns | {"kb_id": ids, "credibility": pa.array(credibility, pa.float64()), "weight": pa.array(weight, pa.int64())})
