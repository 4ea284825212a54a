import random
import re

import pytest
from conftest import WORDS, prose
from pyspark.sql import functions as F

from factlake.llm import winnow
from factlake.llm.common import table

SF = "/root/testdata/sf0.001"
ITEMS = "item_id bigint, text string"


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), 10)
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    lengths = {len(x) for x in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (at := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[at]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), ids))
    return sorted(out, key=repr)


def ours(docs, items):
    found = winnow.contamination(docs, items).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found), key=repr)


def odd_items():
    items = [(k, prose(100 + k, 12 + 3 * k)) for k in range(12)]
    items += [(20 + k, prose(200 + k, k)) for k in range(12)]  # 0 to 11 words
    items += [(3, prose(300, 30)), (40, items[5][1]), (41, items[5][1]), (None, prose(301, 15))]
    items += [(50, None), (51, ""), (52, "--- !!"), (53, "a " * 40), (100, items[6][1]), items[2]]
    return items


def test_equals_brute_force(spark, odd):
    rnd = random.Random(7)
    items = odd_items()
    docs = [tuple(r) for r in odd.where("length(text) < 40000 OR text IS NULL").select("doc_id", "text").collect()]
    for k, (_, text) in enumerate(items):
        w = (text or "").split()
        some = w[rnd.randrange(3) :][: rnd.randrange(8, 25)]
        docs.append((500 + k, prose(k, 30) + " " + " ".join(some).upper() + ". " + prose(k + 50, 9)))
        docs.append((600 + k, ", ".join(some[:9])))
        changed = list(w)
        changed[9::10] = ["other"] * len(changed[9::10])
        docs.append((700 + k, " ".join(changed)))
    docs += [(800, "a " * 200), (801, "A a\na-a " * 3), (500, items[4][1] * 2), (802, items[4][1] * 2), docs[20]]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    i = spark.createDataFrame(items, ITEMS)
    for name in "words key1 key2 prints shared start length span n s1 s2 item_id".split():
        d = d.withColumn(name, F.lit("theirs"))
        i = i if name == "item_id" else i.withColumn(name, F.lit("theirs"))
    want = brute(docs, items)
    assert ours(d, i.withColumn("doc_id", F.lit("theirs"))) == want
    assert sum(r[2] > 0 for r in want) > 40


def test_hot_passage(spark):
    passage = prose(1, 60)
    items = [(k, passage if k % 3 == 0 else prose(900 + k, 25)) for k in range(60)]
    docs = [(k, prose(k, 20) + " " + (passage if k % 3 == 0 else "") + prose(k + 1, 9)) for k in range(90)]
    docs += [(k, passage) for k in range(100, 150)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert ours(d, spark.createDataFrame(items, ITEMS)) == brute(docs, items)


def test_empty_tables(spark, none):
    items = spark.createDataFrame(odd_items(), ITEMS)
    assert ours(none, items) == []
    docs = spark.createDataFrame([(1, prose(1, 20)), (2, None)], "doc_id bigint, text string")
    assert ours(docs, items.limit(0)) == [(1, 20, 0, []), (2, 0, 0, [])]


def test_given_tables(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    rows = lambda df, *c: [tuple(r) for r in df.select(*c).collect()]
    assert ours(docs, items) == brute(rows(docs, "doc_id", "text"), rows(items, "item_id", "text"))


@pytest.mark.parametrize("length", range(1, 11))
def test_equal_spans_have_equal_fingerprints(spark, length):
    gram, window = winnow.gram_and_window(length)
    assert gram + window - 1 == length
    shared = random.Random(length).choices(WORDS, k=length)
    rows = [(prose(k, k).split() + shared + prose(90 + k, 15).split(), k) for k in range(12)]
    df = winnow.with_fingerprints(spark.createDataFrame(rows, "words array<string>, at int"), [length])
    assert len({r[f"prints{length}"][r["at"]] for r in df.collect()}) == 1


def test_only_built_in_functions(spark, odd, monkeypatch):
    from factlake.session import Scratch

    plans, write = [], Scratch.table

    def written(self, df):
        plans.append(df._jdf.queryExecution().toString())
        return write(self, df)

    monkeypatch.setattr(Scratch, "table", written)
    plans.append(
        winnow.contamination(odd, spark.createDataFrame(odd_items(), ITEMS))._jdf.queryExecution().toString()
    )
    assert len(plans) > 5
    assert not any(re.search("Python|Pandas|Arrow", p) for p in plans)
