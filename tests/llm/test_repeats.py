import hashlib
import random
from collections import Counter

import pytest
from helpers import texts_of

from factlake.llm import queries, repeats
from factlake.llm.common import table
from factlake.llm.run_index import RunIndex

SF = "/root/testdata/sf0.001"


def left_over(texts, length=200):
    """(bytes, removed, spans, digest) per text, by counting every window."""
    data = [t.encode() for t in texts]
    seen = Counter(x[k : k + length] for x in data for k in range(len(x) - length + 1))
    out = []
    for x in data:
        gone = bytearray(len(x))
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(x)))
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [500, 3])
@pytest.mark.parametrize("which", ["odd", "given", "copies"])
def test_equals_counting(spark, odd, none, monkeypatch, which, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "PART", 9000)  # long texts are cut
    if which == "given":
        docs = table(spark, SF, "documents").limit(150)
    elif which == "odd":
        docs = odd
    else:  # one passage in many documents, with letters changed here and there
        rnd = random.Random(1)
        passage = "".join(rnd.choices("abcd ", k=700))
        rows = []
        for k in range(60):
            text = list("".join(rnd.choices("abcd ", k=60)) + passage + str(k) * 20)
            for _ in range(rnd.randint(0, 3)):
                text[rnd.randrange(len(text))] = "é"
            rows.append((k, "".join(text)))
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs = docs.persist()
    source = texts_of(docs)
    want = [(d, *x) for (d, _), x in zip(source, left_over([t for _, t in source]))]
    got = [
        (r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())
        for r in repeats.without_repeats(docs).collect()
    ]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_table(none):
    assert repeats.without_repeats(none).collect() == []


def test_index_equals_counting():
    rnd = random.Random(5)
    for _ in range(300):
        least = rnd.choice([16, 17, 40])
        base = [bytes(rnd.choices(b"ab", k=rnd.randint(0, 90))) for _ in range(3)]
        texts = [
            b"".join(rnd.choice(base)[rnd.randint(0, 20) :] for _ in range(rnd.randint(0, 3)))
            for _ in range(rnd.randint(1, 8))
        ]
        seen = Counter(t[k : k + least] for t in texts for k in range(len(t) - least + 1))
        want = {
            (j, k)
            for j, t in enumerate(texts)
            for k in range(len(t) - least + 1)
            if seen[t[k : k + least]] > 1
        }
        index = RunIndex(texts, least)
        assert {(j, k) for j, a, b in index.long_matches() for k in range(a, b + 1)} == want
        runs = index.letters[1:], index.letters[:-1]
        assert ((runs[0] != runs[1]) | (runs[0] == 0)).all()


def test_query_columns(spark):
    assert queries.op1_repeats(spark, SF).columns == [
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256",
    ]
