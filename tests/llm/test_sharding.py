import zlib
from collections import Counter, defaultdict

import pytest
from helpers import texts_of

from factlake.llm import queries, sharding
from factlake.llm.common import table

SF = "/root/testdata/sf0.001"


def fewest(sizes, capacity):
    n, at = 1, 0
    for size in sizes:
        if at + size > capacity:
            n, at = n + 1, 0
        at += size
    return n


@pytest.mark.parametrize("which", ["odd", "given"])
def test_smallest_capacity(spark, odd, which):
    import hashlib

    docs = odd if which == "odd" else table(spark, SF, "documents")
    rows = sharding.sharded(docs).collect()
    source = texts_of(docs)
    want = [(d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in source]
    assert sorted((tuple(r)[:3] for r in rows), key=repr) == sorted(want, key=repr)
    groups = Counter()
    for _, text in source:
        groups[hashlib.sha256(text.encode()).digest()] += len(text.encode()) + 1
    sizes = [groups[k] for k in sorted(groups)]
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fewest(sizes, middle) <= 8 else (middle + 1, high)
    held, slots, of_text = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        held[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        of_text[r["text_crc32"], r["size"]].add(r["shard"])
    assert max(held.values()) <= low and set(held) <= set(range(8))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(shards) == 1 for shards in of_text.values())


def test_a_third_in_one_group(spark):
    """The other groups are spread over all other shards."""
    sizes = [10] * 60 + [600] + [10] * 60
    rows, upto = [], 0
    for k, size in enumerate(sizes):
        upto += size
        rows.append((bytearray([k]), size, upto))
    sums = spark.createDataFrame(rows, "key binary, size bigint, upto bigint")
    capacity, cuts = sharding.minimax_cuts(sums)
    of_shard = Counter()
    for key, size, _ in rows:
        of_shard[sum(bytes(key) > cut for cut in cuts)] += size
    assert capacity == 600 and sorted(of_shard) == list(range(8))
    assert sorted(of_shard.values())[-2:] == [200, 600]


def test_few_groups_and_none(spark, none):
    assert sharding.sharded(none).collect() == []
    same = spark.createDataFrame([(k, "same") for k in range(40)], "doc_id bigint, text string")
    assert {r["shard"] for r in sharding.sharded(same).collect()} == {0}


def test_query_columns(spark):
    out = queries.op3_sharding(spark, SF)
    assert out.columns == [
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard",
    ]
    assert dict(out.dtypes)["grown_shard"] == "int" and dict(out.dtypes)["shard"] == "int"
