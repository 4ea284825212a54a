"""Byte-level BPE as a lazily determinised transducer; decoding by a UTF-8 state machine.

Encoding. Merging greedily by rank is the same as the one way to cut a text into tokens in
which every two neighbours could stand side by side (``Merges.fit``). So the last token of
every prefix is fixed, and the cuts of all prefixes form a tree. Reading byte by byte, only
some places can still be where the next token starts: those from which the bytes read are
the beginning of some token. What all of them have in common will not change any more and is
put out; the rest, the bytes since then and the token before, is the state. A state holds
fewer bytes than a few tokens, so tokens come out after a bounded look ahead. States and
moves are made when a text first needs them and kept in a table of bounded size.

Decoding. A token may end inside a character. The state of the decoder is what has been read
of an unfinished character; a token leads to the bytes that are complete now and to the next
state. Moves are made when first needed; which bytes may follow is the UTF-8 automaton.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import Column, functions as F

from factlake.llm.common import column_udf
from factlake.llm.tokens import read_ranks

NEVER = float("inf")


class Merges:
    """What the ranks say about single tokens and about two tokens side by side."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        #: beginning of tokens -> the least rank among the longer tokens that have it
        self.beginnings: dict[bytes, int] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if rank < self.beginnings.get(token[:k], NEVER):
                    self.beginnings[token[:k]] = rank
        self._halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._fits: dict[tuple[bytes, bytes], bool] = {}
        self._edges: dict[tuple[bytes, int], list] = {}

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens that merge last when ``token`` is built; empty for a byte, None
        if merging its bytes doesn't lead to it."""
        if token not in self._halves:
            parts = [token[k : k + 1] for k in range(len(token))]
            last: tuple[bytes, bytes] | None = (b"", b"")
            while len(parts) > 1:
                rank, k = min(
                    (self.ranks.get(parts[k] + parts[k + 1], NEVER), k)
                    for k in range(len(parts) - 1)
                )
                if rank == NEVER:
                    last = None
                    break
                last = (parts[k], parts[k + 1])
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self._halves[token] = last
        return self._halves[token]

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, float, float]]:
        """The parts that stand at one end while ``token`` is built, the token first, each
        with the ranks at which it comes and goes."""
        found = self._edges.get((token, side))
        if found is None:
            found, goes, part = [], NEVER, token
            while part:
                rank = self.ranks[part] if len(part) > 1 else -1
                found.append((part, rank, goes))
                halves = self.halves(part)
                part, goes = (halves[side] if halves else b""), rank
            self._edges[token, side] = found
        return found

    def matters(self, left: bytes, rest: bytes) -> bool:
        """Whether some merge could cross from ``left`` into what begins with ``rest``."""
        ranks, beginnings = self.ranks, self.beginnings
        for x, _, goes in self._edge(left, 1):
            if beginnings.get(x + rest, NEVER) < goes:
                return True
            for k in range(1, len(rest) + 1):
                if ranks.get(x + rest[:k], NEVER) < goes:
                    return True
        return False

    def fit(self, left: bytes, right: bytes) -> bool:
        """Whether no merge crosses the border while the two tokens are built."""
        known = self._fits.get((left, right))
        if known is None:
            known = self._fits[left, right] = not any(
                y_comes < x_goes
                and x_comes <= y_goes
                and (rank := self.ranks.get(x + y, NEVER)) < x_goes
                and rank <= y_goes
                and rank != NEVER
                for x, x_comes, x_goes in self._edge(left, 1)
                for y, y_comes, y_goes in self._edge(right, 0)
            )
            if len(self._fits) > 500_000:
                self._fits.clear()
        return known


class _State(dict):
    """byte -> (next state, ids put out); missing moves are worked out once."""

    __slots__ = ("owner", "before", "rest", "cuts", "open", "end")

    def __init__(self, owner: Transducer, before: bytes, rest: bytes, cuts: tuple, open: tuple):
        super().__init__()
        #: The token before ``rest``, empty if none can matter; the last token of each
        #: beginning of ``rest``; the places where the next token may start.
        self.owner, self.before, self.rest = owner, before, rest
        self.cuts, self.open = cuts, open
        #: The ids that are put out if the text ends here.
        self.end = owner.ids(cuts, 0, len(rest))

    def __missing__(self, byte: int) -> tuple[_State, tuple[int, ...]]:
        found = self[byte] = self.owner.move(self, byte)
        return found


class Transducer:
    """Bytes in, ids out, one match of the pattern at a time."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = 400_000) -> None:
        self.merges, self.most_states = Merges(ranks), most_states
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple[bytes, bytes], _State] = {}
        self.start = self._state(b"", b"", (), (0,))

    def _state(self, before: bytes, rest: bytes, cuts: tuple, open: tuple) -> _State:
        if before and not self.merges.matters(before, rest):
            before = b""
        found = self.states.get((before, rest))
        if found is None:
            found = self.states[before, rest] = _State(self, before, rest, cuts, open)
        return found

    def ids(self, cuts: tuple, start: int, end: int) -> tuple[int, ...]:
        """The tokens of the cut between two of its borders."""
        out = []
        while end > start:
            token = cuts[end - 1]
            out.append(self.merges.ranks[token])
            end -= len(token)
        return tuple(reversed(out))

    def _last_token(self, state: _State, rest: bytes) -> bytes:
        """The token that ends the cut of ``rest``, whose last byte is new."""
        merges, ranks = self.merges, self.merges.ranks
        for start in state.open:
            token = rest[start:]
            if token in ranks and merges.halves(token) is not None:
                left = state.cuts[start - 1] if start else state.before
                if not left or merges.fit(left, token):
                    return token
        raise ValueError(f"no token ends {rest!r}")

    def move(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        rest = state.rest + bytes([byte])
        cuts = (*state.cuts, self._last_token(state, rest))
        n, beginnings = len(rest), self.merges.beginnings
        open_ = [k for k in state.open if rest[k:] in beginnings]
        open_.append(n)
        # The nearest border that the cuts up to all open places share.
        borders = set(open_)
        while len(borders) > 1:
            last = max(borders)
            borders.remove(last)
            borders.add(last - len(cuts[last - 1]))
        fixed = borders.pop()
        if not fixed:
            return self._state(state.before, rest, cuts, tuple(open_)), ()
        after = self._state(
            cuts[fixed - 1], rest[fixed:], cuts[fixed:], tuple(k - fixed for k in open_)
        )
        return after, self.ids(cuts, 0, fixed)

    def encode(self, match: bytes) -> tuple[int, ...]:
        if len(self.states) > self.most_states:
            self._reset()
        state, out = self.start, []
        for byte in match:
            state, ids = state[byte]
            if ids:
                out.extend(ids)
        out.extend(state.end)
        return tuple(out)


def _follows() -> dict[str, dict[int, str]]:
    """The UTF-8 automaton: state -> byte -> state; "" is between characters."""
    tail = range(0x80, 0xC0)

    def to(state: str, bytes_: range) -> dict[int, str]:
        return dict.fromkeys(bytes_, state)

    return {
        "": to("", range(0x80))
        | to("1", range(0xC2, 0xE0))
        | to("E0", range(0xE0, 0xE1))
        | to("2", range(0xE1, 0xF0))
        | to("ED", range(0xED, 0xEE))
        | to("F0", range(0xF0, 0xF1))
        | to("3", range(0xF1, 0xF4))
        | to("F4", range(0xF4, 0xF5)),
        "1": to("", tail),
        "2": to("1", tail),
        "3": to("2", tail),
        "E0": to("1", range(0xA0, 0xC0)),
        "ED": to("1", range(0x80, 0xA0)),
        "F0": to("2", range(0x90, 0xC0)),
        "F4": to("2", range(0x80, 0x90)),
    }


class _Unfinished(dict):
    """id -> (next state, bytes of the characters that are complete now)."""

    __slots__ = ("owner", "at", "bytes")

    def __init__(self, owner: Decoder, at: str, pending: bytes) -> None:
        super().__init__()
        self.owner, self.at, self.bytes = owner, at, pending

    def __missing__(self, token: int) -> tuple[_Unfinished, bytes]:
        found = self[token] = self.owner.move(self, token)
        return found


class Decoder:
    """Ids in, whole characters out; what can't be UTF-8 becomes U+FFFD."""

    BAD = "�".encode()

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.follows = _follows()
        self.states: dict[bytes, _Unfinished] = {}
        self.start = self._state("", b"")

    def _state(self, at: str, pending: bytes) -> _Unfinished:
        if pending not in self.states:
            self.states[pending] = _Unfinished(self, at, pending)
        return self.states[pending]

    def move(self, state: _Unfinished, token: int) -> tuple[_Unfinished, bytes]:
        at, pending, out = state.at, state.bytes, b""
        for byte in self.bytes_of[token]:
            step = self.follows[at].get(byte)
            if step is None and pending:  # an unfinished character ends here
                out, pending = out + self.BAD, b""
                step = self.follows[""].get(byte)
            if step is None:
                out, at = out + self.BAD, ""
                continue
            pending += bytes([byte])
            at = step
            if not at:
                out, pending = out + pending, b""
        return self._state(at, pending), out

    def decode(self, ids) -> bytes:
        """The text's UTF-8 bytes."""
        state, out = self.start, []
        for token in ids:
            state, done = state[token]
            out.append(done)
        return b"".join(out) + (self.BAD if state.bytes else b"")


class Coder(dict):
    """Match of the pattern -> its ids, for the matches seen often enough to be kept."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_matches: int = 200_000) -> None:
        super().__init__()
        self.transducer, self.decoder = Transducer(ranks), Decoder(ranks)
        self.matches = regex.compile(pattern).findall
        self.most_matches = most_matches
        self.written = {rank: str(rank) for rank in ranks.values()}

    def __missing__(self, match: str) -> tuple[int, ...]:
        found = self.transducer.encode(match.encode())
        if len(match) <= 32:
            if len(self) >= self.most_matches:
                self.clear()
            self[match] = found
        return found

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.matches(text))))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    """One per Python worker, so that its tables serve all batches."""
    return Coder(read_ranks(path), pattern)


def encoded(text: Column, path: str, pattern: str) -> Column:
    """The ids of the whole text; null counts as empty, and has none."""

    def of_batch(texts: pa.Array) -> pa.Array:
        code = coder(path, pattern)
        return pa.array([code.encode(t or "") for t in texts.to_pylist()], pa.list_(pa.int32()))

    return column_udf(of_batch, "array<int>")(text)


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """The text of the ids; null counts as no ids."""

    def of_batch(rows: pa.Array) -> pa.Array:
        decode = coder(path, pattern).decoder.decode
        out = [decode(row or ()) for row in rows.to_pylist()]
        return pa.array(out, pa.binary()).cast(pa.string())

    return column_udf(of_batch, "string")(ids)


def round_trip(text: Column, path: str, pattern: str) -> Column:
    """Per text: the number of ids, the digest of the ids written with commas, and the
    digest of the text decoded from them. Ids don't leave the worker."""
    kind = pa.struct(
        [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    )

    def of_batch(texts: pa.Array) -> pa.Array:
        code = coder(path, pattern)
        decode, write = code.decoder.decode, code.written.__getitem__
        out = []
        for row in texts.to_pylist():
            ids = code.encode(row or "")
            listed = ",".join(map(write, ids)).encode()
            out.append(
                (
                    len(ids),
                    hashlib.sha256(listed).hexdigest(),
                    hashlib.sha256(decode(ids)).hexdigest(),
                )
            )
        return pa.array(out, kind)

    return column_udf(
        of_batch, "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>"
    )(text)
