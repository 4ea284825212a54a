import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import texts_of
from tokenizers import Tokenizer

from factlake.llm import packing, queries
from factlake.llm.common import table

SF = "/root/testdata/sf0.001"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.mark.parametrize("which", ["odd", "given"])
def test_pieces_and_sequences(spark, odd, which):
    docs = odd if which == "odd" else table(spark, SF, "documents")
    rows = packing.packed_documents(docs, PATH, PATTERN, special=50256).collect()
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    want = []
    for doc_id, text in texts_of(docs):
        ids = np.array([*encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= 1.03 * total / 2048 + 2


def test_rounds_place_everything():
    rng = np.random.default_rng(0)
    for lengths in (
        np.clip(rng.lognormal(6.5, 1, 5000), 1, 2047).astype(int),
        np.ones(10_000, int),
        np.full(500, 700),
        rng.integers(1, 2048, 3000),
        np.array([2047]),
    ):
        size, n = np.unique(lengths, return_counts=True)
        rounds = packing.plan_rounds(dict(zip(size.tolist(), n.tolist())), 2048)
        placed = sum(z - a for r in rounds for _, a, z, *_ in r.place + r.open)
        opened = sum(z - a for r in rounds for _, a, z, _ in r.open)
        assert placed == len(lengths)
        # Best fit decreasing by one process, as a yardstick.
        gaps: list[int] = []
        for length in sorted(lengths.tolist(), reverse=True):
            fits = [g for g in gaps if g >= length]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - length)
            else:
                gaps.append(2048 - length)
            if len(gaps) > 4000:
                break
        else:
            assert opened <= 1.02 * len(gaps) + 1


def test_empty_table(none):
    assert packing.packed_documents(none, PATH, PATTERN).collect() == []


def test_query_columns(spark):
    assert queries.op6_packing(spark, SF).columns == [
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
    ]
