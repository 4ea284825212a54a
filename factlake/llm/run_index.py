"""Run-length index of texts: run-compressed BWT with samples at the ends of its runs.

Suffixes are ordered by doubling. Neighbours in that order share the longest matches. Inside
a run of equal letters of the Burrows-Wheeler transform, the neighbours' matches are those of
the suffixes one letter further left, shortened by that letter; so lengths are needed at run
ends only. Streaming the samples over the text, one letter less per step, gives every
suffix's longest match with any other suffix: its matching statistics without itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_WORD = 8
_PAIRS = 4096


def _suffix_order(symbols: np.ndarray, to_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, apart): apart[i] is a power of two above the length that the suffixes at
    order[i - 1] and order[i] share, and at most twice it. Symbol 0 ends a text."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(_WORD, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(_WORD):
        key = (key << np.uint64(8)) | padded[k : k + n]
    ended = to_end < _WORD
    beyond = np.uint64(8) * (_WORD - to_end[ended]).astype(np.uint64)
    key[ended] = np.where(beyond < 64, key[ended] >> (beyond % 64) << (beyond % 64), 0)
    order = np.argsort(key)
    in_order, ended = key[order], ended[order]
    head = np.ones(n, bool)
    head[1:] = (in_order[1:] != in_order[:-1]) | ended[1:]
    apart = np.where(head, _WORD, 0)
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, slots, 0))
    alone = head & np.append(head[1:], True)
    active = slots[~alone]
    known = _WORD
    while len(active):
        at = order[active]
        both = rank[at] * n + rank[at + known]
        sort = np.argsort(both)
        at, both = at[sort], both[sort]
        order[active] = at
        new = np.ones(len(active), bool)
        new[1:] = both[1:] != both[:-1]
        apart[active[new & ~head[active]]] = 2 * known
        head[active] |= new
        rank[at] = np.maximum.accumulate(np.where(new, active, 0))
        alone = new & np.append(new[1:], True)
        active = active[~alone]
        known *= 2
    return order, apart


class RunIndex:
    """The index of some texts, for matches of at least ``least`` bytes (16 or more)."""

    def __init__(self, texts: list[bytes], least: int) -> None:
        self.least = least
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.ends = np.cumsum(size) - 1
        self.starts = self.ends - size + 1
        # UTF-8 has no byte 255, so letters are 1 to 255 and 0 ends a text.
        raw = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8)
        self.symbols = raw + np.uint8(1)
        to_end = np.repeat(self.ends, size) - np.arange(len(raw))
        order, apart = _suffix_order(self.symbols, to_end)
        before = self.symbols[order - 1]
        before[order == 0] = 0
        #: Run-compressed transform: where runs begin in the order, and their letters. The
        #: ends of texts are all different, so each is a run.
        border = np.ones(len(order), bool)
        border[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        self.run_heads = np.flatnonzero(border)
        self.letters = before[self.run_heads]
        self._sample(order, apart)

    def _sample(self, order: np.ndarray, apart: np.ndarray) -> None:
        """At each border of runs the last suffix of one and the first of the next, with
        the length they share, where it can reach ``least``."""
        at = self.run_heads[1:]
        at = at[apart[at] > self.least]
        self.left, self.right = order[at - 1], order[at]
        self.shared = np.empty(len(at), np.int64)
        surely = apart[at] // 2
        for k in range(0, len(at), _PAIRS):
            part = slice(k, k + _PAIRS)
            self.shared[part] = self._shared(self.left[part], self.right[part], surely[part])

    def _shared(self, a: np.ndarray, b: np.ndarray, surely: np.ndarray) -> np.ndarray:
        length, todo, last = surely.copy(), np.arange(len(a)), len(self.symbols) - 1
        step = np.arange(64)
        while len(todo):
            x = self.symbols[np.minimum(last, (a[todo] + length[todo])[:, None] + step)]
            y = self.symbols[np.minimum(last, (b[todo] + length[todo])[:, None] + step)]
            differ = (x != y) | (x == 0)
            some = differ.any(axis=1)
            length[todo] += np.where(some, differ.argmax(axis=1), len(step))
            todo = todo[~some]
        return length

    def matching_statistics(self) -> np.ndarray:
        """For every place the length of its longest match with another place, where that
        is at least ``least``; less than ``least`` elsewhere."""
        longest = np.zeros(len(self.symbols), np.int64)
        np.maximum.at(longest, self.left, self.shared)
        np.maximum.at(longest, self.right, self.shared)
        places = np.arange(len(longest))
        return np.maximum.accumulate(places + longest) - places

    def long_matches(self) -> Iterator[tuple[int, int, int]]:
        """(text number, first, last) of the maximal ranges of places at which a match of
        ``least`` bytes begins."""
        found = np.concatenate([[False], self.matching_statistics() >= self.least, [False]])
        edges = np.flatnonzero(found[1:] != found[:-1])
        first, last = edges[::2], edges[1::2] - 1
        text = np.searchsorted(self.ends, first)
        yield from zip(
            text.tolist(), (first - self.starts[text]).tolist(), (last - self.starts[text]).tolist()
        )
