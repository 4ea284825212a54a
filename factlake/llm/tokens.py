"""Byte-level BPE ids of whole texts, by a public vocabulary given as a parameter."""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import tiktoken

SPECIAL = "<|endoftext|>"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str):
    """text -> list of ids; one per Python worker, whatever number of batches it sees."""
    encoding = tiktoken.Encoding(
        "public", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={}
    )
    return encoding.encode_ordinary


def ids_of(text: str, path: str, pattern: str, special: int | None) -> array:
    """The ids as unsigned 32-bit numbers.

    Where ``special`` is given, the text SPECIAL stands for that id, as the vocabulary's
    JSON file has it.
    """
    encode = encoder(path, pattern)
    if special is None or SPECIAL not in text:
        return array("I", encode(text))
    out = array("I")
    for k, part in enumerate(text.split(SPECIAL)):
        if k:
            out.append(special)
        out.extend(encode(part))
    return out
