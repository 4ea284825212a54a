import numpy as np
import pytest
from pyspark.sql import functions as F

from factlake.llm import mining


def brute(rows, is_anchor, scale=256):
    live = [
        (i, label, [int(np.floor(scale * float(c))) for c in x])
        for i, x, label in rows
        if i is not None and label is not None and x is not None
        and all(c is not None and np.isfinite(c) for c in x)
    ]
    out = []
    for a in {i for i, _, _ in live if is_anchor(i)}:
        label, x = min((lab, v) for i, lab, v in live if i == a)
        score = lambda y: sum(p * q for p, q in zip(x, y))
        same = sorted((-score(y), i) for i, lab, y in live if lab == label and i != a)[:5]
        other = sorted((-score(y), i) for i, lab, y in live if lab != label)
        for p, pid in same:
            fits = [(s, i) for s, i in other if 80 * -p <= 100 * -s <= 100 * -p][:5]
            out += [(a, pid, r, i, -p, -s) for r, (s, i) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("case", ["ties", "signs", "wide", "large", "odd"])
def test_equals_brute_force(spark, case):
    rng = np.random.default_rng(5)
    if case == "ties":  # a third of the rows are one vector, and a third have one label
        x = rng.integers(0, 3, (300, 6)) / 8
        x[::3] = x[0]
    elif case == "signs":
        x = rng.standard_normal((300, 16)) / 4 + 0.2
    elif case == "wide":
        x = np.abs(rng.standard_normal((60, 700)))
    elif case == "large":
        x = np.abs(rng.standard_normal((120, 5))) * 10.0 ** rng.integers(-2, 5, (120, 5))
    else:
        x = rng.standard_normal((40, 3)) + 1
    rows = [(k, [float(np.float32(c)) for c in v], [0, 0, 1, 2][k % 4]) for k, v in enumerate(x)]
    if case == "odd":
        rows += [
            (100, None, 1), (200, [None, 1.0, 2.0], 1), (300, [float("nan")] * 3, 1),
            (None, [1.0, 2.0, 3.0], 1), (105, [1.0, 2.0, 3.0], None), (400, [float("inf"), 0.0, 0.0], 2),
            (500, [0.5], 2), (600, [], 1), (7, rows[7][1], 0), rows[9], (10, rows[11][1], 2), rows[10],
        ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    for name in ("x", "block", "rank", "rows", "anchors", "ids"):
        df = df.withColumn(name, F.lit("theirs"))
    found = mining.hard_negatives(
        mining.quantised(df), F.col("vec_id") % 5 == 0, block_bytes=8 * 64 * x.shape[1]
    ).collect()
    assert sorted(tuple(r) for r in found) == brute(rows, lambda i: i % 5 == 0)
    assert len(found) > 20


def test_empty_and_without_anchors(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert mining.hard_negatives(mining.quantised(none), F.col("vec_id") % 100 == 0).collect() == []
    one = spark.createDataFrame([(1, [1.0], 1), (2, [], 2)], none.schema)
    assert mining.hard_negatives(mining.quantised(one), F.col("vec_id") == 7).collect() == []
    empty = spark.createDataFrame([(0, [], 1), (1, [], 1), (2, [], 2)], none.schema)
    found = mining.hard_negatives(mining.quantised(empty), F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in found] == [(0, 1, 1, 2, 0, 0)]


@pytest.mark.parametrize("top, width", [(1, 1), (300, 64), (40_000, 1500), (2**40, 7)])
def test_residues_give_exact_scores(top, width):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-top, top + 1, (9, width)), rng.integers(-top, top + 1, (11, width))
    a[0], b[0] = top, -top
    exact = a.astype(object) @ b.astype(object).T
    bound = width * top * top
    primes = mining.moduli(bound, width)
    product = 1
    for p in primes:
        assert all(p % d for d in range(2, p)) and min(width, mining._STRETCH) * (p // 2) ** 2 <= 1 << 24
        product *= p
    assert product > 2 * bound
    found = [mining._product(mining._residues(a, p), mining._residues(b, p), p) for p in primes]
    wrapped = np.vectorize(lambda v: (int(v) + 2**63) % 2**64 - 2**63, otypes=[np.int64])(exact)
    assert (mining.reconstructed(found, primes) == wrapped).all()


def test_units_are_bounded(spark):
    rows = spark.range(5000).selectExpr("id AS vec_id", "id % 3 AS label", "array(id, 1L) AS x")
    blocks = mining._blocks(rows, 20).select(F.length("ids").alias("n")).collect()
    assert len(blocks) == 20 and max(r["n"] for r in blocks) < 8 * 2 * 250
