import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factlake.llm import topk


def brute(rows, is_query, k=10):
    live = [
        (i, [int(np.floor(1024 * float(c))) for c in x])
        for i, x in rows
        if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)
    ]
    out = set()
    for q in {i for i, _ in live if is_query(i)}:
        x = next(x for i, x in live if i == q)
        scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in live if i != q)
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)}
    return out


@pytest.mark.parametrize("case", ["ties", "signs", "wide", "odd"])
def test_equals_brute_force(spark, case):
    rng = np.random.default_rng(3)
    if case == "ties":  # a third of the rows are one vector
        x = rng.integers(-2, 3, (400, 6)) / 8
        x[::3] = x[0]
    elif case == "signs":
        x = rng.standard_normal((300, 16)) / 4
    elif case == "wide":
        x = rng.standard_normal((150, 5)) * 10.0 ** rng.integers(-3, 5, (150, 5))
    else:
        x = rng.standard_normal((30, 3))
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    if case == "odd":
        rows += [
            (100, None), (200, [None, 1.0, 2.0]), (300, [float("nan")] * 3), (None, [1.0, 2.0, 3.0]),
            (400, [float("inf"), 0.0, 0.0]), (500, [0.5]), (600, []), (7, rows[7][1]), (8, rows[9][1]),
        ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    df = df.withColumn("x", F.lit("theirs")).withColumn("block", F.lit("theirs"))
    found = topk.top_k(
        topk.quantised(df), F.col("vec_id") % 5 == 0, block_rows=64, query_rows=16
    ).collect()
    as_float = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    assert {tuple(r) for r in found} == brute(as_float, lambda i: i % 5 == 0)
    assert len(found) == len(set(found))


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.top_k(topk.quantised(df), F.col("vec_id") % 100 == 0).collect() == []


def test_slices_add_up():
    rng = np.random.default_rng(0)
    x = rng.integers(-600, 600, (500, 12))
    block = pd.DataFrame({"block": 0, "vec_id": np.arange(500), "x": list(x)})
    index = topk.BlockIndex(next(topk._index_of(block).itertuples()))
    query = rng.integers(-600, 600, 12)
    bits = [np.unpackbits(s.view(np.uint8), bitorder="little")[:500] for s in index.sums(query)]
    kept = (x - x.min(axis=0)) >> index.shift
    most = (1 << topk.KEPT_BITS) - 1
    want = (np.abs(query) * np.where(query < 0, most - kept, kept)).sum(axis=1)
    assert (sum(b.astype(np.int64) << k for k, b in enumerate(bits)) == want).all()
    assert len(index.boundary(query, index.every, 10)) < 250
