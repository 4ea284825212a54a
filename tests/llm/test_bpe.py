import hashlib
import random
import time

import public_tokenizers
import pytest
import tiktoken
from helpers import texts_of
from pyspark.sql import functions as F

from factlake.llm import bpe
from factlake.llm.common import table

SF = "/root/testdata/sf0.001"
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module", params=["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def both(request):
    path = public_tokenizers.path(request.param)
    ranks = bpe.read_ranks(path)
    theirs = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return path, ranks, theirs


def test_transducer_equals_merging(both):
    _, ranks, theirs = both
    ours = bpe.Transducer(ranks, most_states=2000)  # small, so that it is emptied
    rnd, tokens = random.Random(2), list(ranks)
    for k in range(6000):
        data = b"".join(rnd.choices(tokens, k=rnd.randint(1, 4)))
        if k % 3 == 0:
            data = bytes(rnd.choices(b"abcdeinorst 01", k=rnd.randint(1, 30)))
        elif k % 3 == 1:
            data = bytes(rnd.choices(b"aab", k=rnd.randint(1, 40)))
        assert list(ours.encode(data)) == theirs._core_bpe.encode_single_piece(data), data
        assert max(len(s.rest) for s in ours.states.values()) <= 2 * ours.merges.longest


@pytest.mark.parametrize("which", ["odd", "given"])
def test_round_trip(spark, odd, none, both, which):
    path, _, theirs = both
    docs = odd if which == "odd" else table(spark, SF, "documents")
    done = bpe.round_trip(F.col("text"), path, PATTERN)
    for row in docs.select("text", done.alias("done")).collect():
        text = row["text"] or ""
        ids = theirs.encode_ordinary(text)
        assert row["done"].asDict() == {
            "n_tokens": len(ids),
            "ids_sha256": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            "decoded_sha256": hashlib.sha256(text.encode()).hexdigest(),
        }
    assert none.select(done).collect() == []


def test_columns(spark, odd, both):
    path, _, theirs = both
    ids = odd.select("text", bpe.encoded(F.col("text"), path, PATTERN).alias("ids"))
    back = ids.select("text", "ids", bpe.decoded(F.col("ids"), path, PATTERN).alias("back"))
    for row in back.collect():
        assert row["ids"] == theirs.encode_ordinary(row["text"] or "")
        assert row["back"] == (row["text"] or "")
    assert len(texts_of(odd)) == back.count()


def test_decoder_follows_utf8(both):
    _, ranks, _ = both
    decode = bpe.Decoder(ranks).decode
    rnd = random.Random(4)
    for _ in range(3000):
        data = bytes(rnd.choices(b"a\xc3\xa9\xe2\x82\xac\xf0\x9f\x98\x80\xff\xed\xa0\xc0", k=rnd.randint(0, 9)))
        ids = [ranks[data[k : k + 1]] for k in range(len(data))]
        assert decode(ids) == data.decode(errors="replace").encode()


def test_a_match_without_a_break_takes_linear_time(both):
    _, ranks, _ = both
    ours = bpe.Transducer(ranks)
    letters = bytes(random.Random(1).choices(b"abcdeinorst", k=1_000_000))
    ours.encode(letters[:100_000])
    start = time.perf_counter()
    ids = ours.encode(letters)
    assert time.perf_counter() - start < 10
    token = {number: value for value, number in ranks.items()}
    assert b"".join(token[k] for k in ids) == letters
