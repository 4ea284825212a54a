"""Shards of nearly equal bytes: minimax contiguous partition of ordered atomic groups.

Documents of equal text are one group and never parted. Groups are ordered by the SHA-256
of their text; a shard is a contiguous range of groups. The smallest capacity for which
``n_shards`` ranges suffice is found by search: a capacity is feasible if filling shard
after shard greedily, each up to the capacity, uses up all groups. If one group is as large
as that, the shards of several groups get the smallest capacity of their own by a second
search, in which a larger group fills a shard alone. Shards left over halve the widest.

The groups' running sums are a table, written in order. A greedy step is one look-up in it,
"the last sum that is not beyond this target", and needs only rows within the largest
group's size of the target, which Parquet's statistics find. Several capacities are checked
at once, so a step is one small job and a round divides the interval by their number.
The driver sees a few sums and the cuts, whatever the input. A document finds its shard by
comparing its own hash with the cuts: no join, so a group with a third of all rows is
nothing special.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factlake.llm.common import materialized

N_SHARDS = 8
PROBES = 15
_BLOCKS = 4096
_CELLS = 1024


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _key() -> Column:
    return F.unhex(F.sha2(_text(), 256))


def _size() -> Column:
    return F.octet_length(_text()).cast("bigint") + 1


def running_sums(docs: DataFrame) -> DataFrame:
    """(key, size, upto) of every group in order; ``upto`` counts it and all before it."""
    keyed = docs.select(_key().alias("key"), _size().alias("size"))
    groups = materialized(keyed.groupBy("key").agg(F.sum("size").alias("size")))
    block = F.conv(F.substring(F.hex("key"), 1, 3), 16, 10).cast("int")
    blocked = groups.withColumn("block", block).repartitionByRange("block")
    inside = Window.partitionBy("block").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    summed = materialized(blocked.withColumn("part", F.sum("size").over(inside)))
    # At most _BLOCKS rows, whatever the input.
    totals = summed.groupBy("block").agg(F.sum("size").alias("total"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before")
    )
    upto = F.col("before") + F.col("part")
    with_sums = summed.join(F.broadcast(offsets), "block").select("key", "size", upto.alias("upto"))
    return materialized(with_sums)


class _Sums:
    """Look-ups in the table of running sums."""

    def __init__(self, table: DataFrame) -> None:
        self.table = table
        found = table.agg(F.max("upto"), F.max("size")).first()
        self.total, self.largest = found[0] or 0, found[1] or 0
        self.steps = 0

    def last_up_to(self, targets: list[int]) -> list[int]:
        """For each target the largest running sum that is not beyond it, or 0."""
        if not targets:
            return []
        near = [
            (F.col("upto") <= t) & (F.col("upto") > max(0, t - self.largest)) for t in targets
        ]
        any_near = near[0]
        for condition in near[1:]:
            any_near |= condition
        best = [F.max(F.when(c, F.col("upto"))) for c in near]
        return [x or 0 for x in self.table.where(any_near).agg(*best).first()]

    def first_after(self, starts: list[int]) -> list[int]:
        """For each start the smallest running sum beyond it, or the total."""
        upto = F.col("upto")
        near = [(upto > a) & (upto <= a + self.largest) for a in starts]
        any_near = near[0]
        for condition in near[1:]:
            any_near |= condition
        best = [F.min(F.when(c, upto)) for c in near]
        return [x or self.total for x in self.table.where(any_near).agg(*best).first()]

    def greedy(
        self, capacities: list[int], n_shards: int, alone: bool = False
    ) -> list[list[int]]:
        """The ends of each capacity's shards, filled one after the other.

        With ``alone`` a group beyond the capacity is a shard by itself.
        """
        ends: list[list[int]] = [[] for _ in capacities]
        at = [0] * len(capacities)
        for _ in range(n_shards):
            start = at
            at = self.last_up_to([min(self.total, a + c) for a, c in zip(at, capacities)])
            stuck = [k for k, a in enumerate(start) if at[k] <= a < self.total]
            if alone and stuck:
                for k, end in zip(stuck, self.first_after([start[k] for k in stuck])):
                    at[k] = end
            for end, a in zip(ends, at):
                end.append(a)
        return ends

    def halved(self, ends: list[int], n_shards: int) -> list[int]:
        """The ends with the widest shard of several groups halved until all are used."""
        whole: set[int] = set()
        while len(ends) < n_shards:
            spans = [(end - a, a, end) for a, end in zip([0, *ends], ends) if end not in whole]
            if not spans:
                break
            size, a, end = max(spans)
            cut = self.last_up_to([a + size // 2])[0]
            if cut <= a:
                cut = self.first_after([a])[0]
            if cut < end:
                ends = sorted([*ends, cut])
            else:
                whole.add(end)
        return ends


def _smallest(found: _Sums, low: int, high: int, n_shards: int, alone: bool) -> int:
    """The smallest feasible capacity from ``low`` to ``high``, which is feasible."""
    while low < high:
        step = max(1, (high - low) // (PROBES + 1))
        probes = sorted({min(high - 1, low + k * step) for k in range(PROBES)})
        fine = [ends[-1] == found.total for ends in found.greedy(probes, n_shards, alone)]
        feasible = [c for c, ok in zip(probes, fine) if ok]
        short = [c for c, ok in zip(probes, fine) if not ok]
        high = min(feasible, default=high)
        low = max([low, *(c + 1 for c in short if c < high)])
    return high


def minimax_cuts(sums: DataFrame, n_shards: int = N_SHARDS) -> tuple[int, list[bytes]]:
    """(smallest feasible capacity, keys of the last group of each shard but the last)."""
    found = _Sums(sums)
    if not found.total:
        return 0, []
    low = max(-(-found.total // n_shards), found.largest)
    # low + largest is always feasible: no shard is left with room for a group
    capacity = _smallest(found, low, low + found.largest, n_shards, False)
    level = capacity
    if capacity == found.largest:
        level = _smallest(found, 1, capacity, n_shards, True)
    last = found.greedy([level], n_shards, True)[0]
    ends = found.halved(sorted({*last, found.total}), n_shards)[:-1]
    at = sums.where(F.col("upto").isin(ends)).select("upto", "key").collect()
    return capacity, [bytes(key) for _, key in sorted(map(tuple, at))]


def sharded(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``.

    A null text counts as the empty one and shares its group. Slots count the rows of a
    shard from 0 without gaps; repeated rows get slots of their own. With fewer groups
    than shards the last shards are empty.
    """
    _, cuts = minimax_cuts(running_sums(docs), n_shards)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("key") > F.lit(cut)).cast("int")
    keyed = docs.select(
        "doc_id",
        _size().alias("size"),
        F.crc32(_text().cast("binary")).alias("text_crc32"),
        _key().alias("key"),
    )
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(_CELLS))
    placed = materialized(
        keyed.select("doc_id", "size", "text_crc32", shard.alias("shard"), cell.alias("cell"))
    )
    counts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id")
    slot = F.col("before") + F.row_number().over(inside) - 1
    # n_shards * _CELLS rows at most
    return placed.join(F.broadcast(offsets), ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", "shard", slot.cast("bigint").alias("slot")
    )
