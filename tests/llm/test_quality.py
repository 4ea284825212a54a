import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from factlake.llm import quality, queries
from factlake.llm.common import table

SF = "/root/testdata/sf0.001"


def counted(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside),
        "n_lines": len(lines),
        "n_upper": sum("A" <= c <= "Z" for c in text),
        "n_digits": sum("0" <= c <= "9" for c in text),
        "n_marks": sum(c in "!?" for c in text),
    }


def test_counts_and_base_rule(spark, odd):
    for docs in (odd, table(spark, SF, "documents")):
        rows = quality.judged(docs, [], "c_", "k_").select("text", "c_", "k_").collect()
        assert len(rows) == docs.count()
        for row in rows:
            want = counted(row["text"] or "")
            assert row["c_"].asDict() == want
            failed = want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]
            assert row["k_"] == (not failed)


def test_all_columns_stay(odd, none):
    kept = quality.kept_documents(odd, [])
    assert kept.columns == odd.columns
    assert quality.kept_documents(none, []).collect() == []


def test_shared_keys_are_told_apart():
    ids = np.array([1, 2, 3, 4, 5, 6, 7, 8] * 2 + list(range(20, 40)))
    rows = np.zeros(len(ids), dtype=int)
    assert quality._words_in_repeats(ids, rows, 1).tolist() == [16]
    rows[8:] = 1
    assert quality._words_in_repeats(ids, rows, 2).tolist() == [0, 0]


def test_list_is_learned_and_is_one_conditional(spark):
    rng = np.random.default_rng(0)
    x = {"a": rng.random(3000), "b": rng.random(3000)}
    bad = (x["a"] > 0.8) | ((x["b"] < 0.2) & (x["a"] > 0.5))
    rules = quality.learn(x, bad, rng.random(3000) < 0.3)
    hit = np.zeros(3000, bool)
    for rule in rules:
        hit |= quality._covers(rule, x, 3000)
    assert (hit & ~bad).sum() <= 0.01 * hit.sum() and (hit & bad).sum() >= 0.9 * bad.sum()
    assert quality.learn(x, np.zeros(3000, bool), rng.random(3000) < 0.3) == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels")
    even, odd_ones = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    docs = table(spark, sf, "documents")
    rules = quality.fit(docs, even)
    found = quality.judged(docs, rules, "c_", "k_").join(odd_ones, "doc_id")
    found = found.where(~quality.base_failed(F.col("c_"))).select("quality", "k_").toPandas()
    good, bad = found[found.quality == 1], found[found.quality == 0]
    assert good.k_.mean() > 0.98 and (~bad.k_).mean() > 0.8


def test_no_usable_labels(spark, odd):
    labels = spark.createDataFrame([(None, 0), (1, None)], "doc_id bigint, quality int")
    assert quality.fit(odd, labels) == []


def test_query_columns(spark):
    out = queries.op10_quality_rules(spark, SF)
    assert out.columns == [
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    ]
    assert out.where("base_failed AND kept").isEmpty()
