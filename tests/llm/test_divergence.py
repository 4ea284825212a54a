import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import prose
from pyspark.sql import functions as F

from factlake.llm import divergence


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(rows, least_docs=3, top=200):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = Counter(terms(text))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        groups = {s: c for (of, s), c in counts.items() if of == lang}
        whole = Counter()
        for c in groups.values():
            whole.update(c)

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        for s, c in groups.items():
            pairs = [
                (-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in groups if o != s
            ]
            best = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if c[t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", best, top)):
                found = sorted(found, key=lambda x: (x[0], x[1].encode()))[:most]
                out += [(lang, s, part, t, -v, r) for r, (v, t) in enumerate(found, 1)]
    return sorted(out)


ODD = [
    ("en", "a", "The cat, the CAT-cat the cat's"), ("en", "a", "cat dog"), ("en", "b", "the dog the"),
    ("en", "b", "cat"), ("en", None, "the dog É é dog"), (None, "a", "cat cat"), (None, None, None),
    ("en", "c", None), ("en", "d", "123 ... "), ("fr", "a", "été été ÉTÉ"), ("fr", "a", "été İ été"),
    ("fr", "b", "été\u0000ete ete"), ("de", "x", "nur einmal"), ("de", "y", "anderes"), ("en", "a", "cat dog"),
    ("e", "\u0000n", "cat"), ("e\u0000", "n", "cat"), ("en", "b", "😀 😀x the"), ("fr", "", "ete été"),
    ("en", "e", "a" * 70_000 + " cat " * 30_000),
]


def made():
    rows = [("en", f"s{k % 7 if k % 3 else 0}", prose(k % 90, 5 + k % 40)) for k in range(300)]
    return rows + [("fr", f"s{k % 2}", prose(k, 12)) for k in range(60)]


@pytest.mark.parametrize("case", ["odd", "made"])
@pytest.mark.parametrize("shard_rows", [100_000, 40])
def test_equals_brute_force(spark, case, shard_rows, monkeypatch):
    rows = ODD if case == "odd" else made()
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    for name in "term n docs shard row value rank item part".split():
        df = df.withColumn(name, F.lit("theirs"))
    found = divergence.source_divergence(df, shard_rows=shard_rows, top_terms=20)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == brute(rows, top=20)


def test_empty(spark, none):
    assert divergence.source_divergence(none).collect() == []
    one = spark.createDataFrame([(None, None, None)], "lang string, source string, text string")
    assert divergence.source_divergence(one).collect() == []


def test_partial_counts_don_t_depend_on_slices(monkeypatch):
    rows = ODD + made()
    batch = pa.RecordBatch.from_pylist(
        [{"lang": a or "", "source": b or "", "text": c or ""} for a, b, c in rows]
    )
    whole = divergence._merged([divergence.partial_counts(batch)]).sort_by([(k, "ascending") for k in divergence._KEYS])
    monkeypatch.setattr(divergence, "_SLICE_BYTES", 500)
    monkeypatch.setattr(divergence, "_MERGED_ROWS", 300)
    parts = list(divergence._counted(iter([batch])))
    assert len(parts) > 1
    again = divergence._merged([pa.Table.from_batches(parts)]).sort_by([(k, "ascending") for k in divergence._KEYS])
    assert whole.equals(again)


def test_arithmetic_is_exact_for_any_count():
    rng = np.random.default_rng(2)
    count = np.concatenate([rng.integers(0, 10**15, 200), [0, 1, 10**15 - 1]])
    total = count + np.concatenate([rng.integers(1, 10**15, 200), [1, 10**15, 1]])
    want = [1 + 10**9 * (c + 1) // t for c, t in zip(count.tolist(), total.tolist())]
    assert divergence._share(count, total).tolist() == want
    p, q = rng.integers(1, 10**9 + 2, (2, 300))
    p[0], q[0] = 10**9 + 1, 1
    want = [(a - b) ** 2 // b for a, b in zip(p.tolist(), q.tolist())]
    assert divergence._distance(p, q).tolist() == want


def test_sums_leave_the_range_of_a_long_unharmed(monkeypatch):
    counts = np.zeros((40, 2), dtype=np.int64)
    counts[:, 0] = 10**12
    totals = np.array([10**12 + 1, 10**15])
    p, q = divergence._share(counts[:1, 0], totals[:1])[0], divergence._share(counts[:1, 1], totals[1:])[0]
    assert divergence._sums(counts, totals)[0, 1] == 40 * ((int(p) - int(q)) ** 2 // int(q)) > 2**63
