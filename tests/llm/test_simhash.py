import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from factlake.llm import simhash
from factlake.llm.common import table
from factlake.llm.components import components
from conftest import prose
from helpers import texts_of

SF = "/root/testdata/sf0.001"


def print_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]
    if not words:
        return 0
    parts = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints, distance):
    """Index of the first element of each element's group, by all pairs."""
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(prints))]


@pytest.mark.parametrize("which", ["odd", "given"])
def test_equals_all_pairs(spark, odd, which):
    docs = odd if which == "odd" else table(spark, SF, "documents")
    rows = texts_of(docs)
    prints = [print_of(t) for _, t in rows]
    groups = grouped(prints, 4)
    ids: dict[int, list] = {}
    for (doc_id, _), group in zip(rows, groups):
        ids.setdefault(group, []).append(doc_id)
    least = {g: min((i for i in found if i is not None), default=None) for g, found in ids.items()}
    want = sorted(
        ((d, p, least[g]) for (d, _), p, g in zip(rows, prints, groups)), key=repr
    )
    got = simhash.near_duplicates(docs).withColumn("fp", simhash.hex_fingerprint(F.col("fp")))
    got = sorted(
        ((r["doc_id"], int(r["fp"], 16), r["component_id"]) for r in got.collect()), key=repr
    )
    assert got == want


@pytest.mark.parametrize("distance", [0, 1, 3, 4, 6])
def test_walk_finds_every_link(spark, distance):
    rnd = random.Random(distance)
    prints = {rnd.getrandbits(64) for _ in range(150)}
    for p in list(prints):
        for _ in range(rnd.randint(0, 4)):
            q = p
            for bit in rnd.sample(range(64), rnd.randint(1, 7)):
                q ^= 1 << bit
            prints.add(q)
    low = rnd.getrandbits(64) >> 8 << 8
    prints |= {low + k for k in range(256)}  # whole subtrees
    signed = sorted(np.array(sorted(prints), dtype=np.uint64).view(np.int64).tolist())
    df = spark.createDataFrame(pd.DataFrame({"fp": signed}))
    roots = dict(map(tuple, components(simhash.near_links(df, distance)).collect()))
    got = [roots.get(p, p) for p in signed]
    want = [signed[k] for k in grouped([p % 2**64 for p in signed], distance)]
    assert got == want


@pytest.mark.parametrize("most_rows", [2000, 150, 10])
def test_large_blocks_are_split(spark, most_rows):
    """A third of all fingerprints has the same leading bits, in either half."""
    rnd = random.Random(4)
    prefix = 0xABCDE << 44
    keys = {rnd.getrandbits(64) for _ in range(600)}
    keys |= {prefix | rnd.getrandbits(44) for _ in range(500)}
    keys |= {rnd.getrandbits(32) << 32 | 0x1234 << 16 | rnd.getrandbits(16) for _ in range(300)}
    keys |= {k ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4))) for k in rnd.sample(sorted(keys), 500)}
    signed = sorted(k - 2**64 if k >= 2**63 else k for k in keys)
    prints = spark.createDataFrame([(k,) for k in signed], "fp bigint")
    links = simhash.near_links(prints, 4, most_rows)
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    got = [roots.get(p, p) for p in signed]
    assert got == [signed[k] for k in grouped([p % 2**64 for p in signed], 4)]
    sizes = simhash.blocks_of(prints, 4, most_rows).groupBy("swapped", "depth", "block").count().collect()
    deepest = max(r["depth"] for r in sizes)
    assert all(r["count"] <= most_rows or r["depth"] > 22 for r in sizes)
    assert (deepest > 10) == (most_rows < 2000)


def test_one_stays(spark, odd, none):
    kept = simhash.one_per_group(odd)
    assert kept.columns == odd.columns
    found = simhash.near_duplicates(odd).where("doc_id = component_id").select("doc_id").distinct()
    assert sorted(r[0] for r in kept.where("doc_id IS NOT NULL").select("doc_id").collect()) == sorted(
        r[0] for r in found.collect()
    )
    assert kept.where("doc_id IS NULL").count() == odd.where("doc_id IS NULL").count()
    assert simhash.one_per_group(none).collect() == []
    assert simhash.near_duplicates(none).collect() == []


def test_different_texts_of_one_doc_id_both_stay(spark):
    rows = [(1, prose(1, 40), "a"), (1, prose(2, 40), "b"), (1, prose(2, 40), "b"), (2, prose(1, 40), "c"), (3, prose(2, 40), "d"), (0, prose(3, 40), "e")]
    kept = simhash.one_per_group(spark.createDataFrame(rows, "doc_id int, text string, key string"))
    assert sorted(map(tuple, kept.collect())) == sorted([rows[0], rows[1], rows[5]])


def test_components(spark):
    rnd = random.Random(1)
    links = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)]
    links += [(1000, k) for k in range(1000, 1200)] + [(k, k + 1) for k in range(2000, 2080)]
    links += [(None, 5), (7, None), (9, 9)]
    root: dict[int, int] = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = components(spark.createDataFrame(links, "u bigint, v bigint")).collect()
    assert {r["node"]: r["root"] for r in got} == {x: find(x) for x in root}
    assert len(got) == len(root)
    assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []
