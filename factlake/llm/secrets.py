"""Secret scans by one combined deterministic automaton over bytes.

The rules' expressions are compiled, reversed, into one automaton by subset construction
and minimised into an array of transitions. One pass over a text's bytes, from the last to
the first, marks for all rules together where a match starts. At the leftmost mark a rule's
own forward automaton finds the longest end; the next match starts behind it. So the spans
are the leftmost, longest, non-overlapping ones of each rule.

Defined results: a null text counts as empty and has no span; spans of one kind never
overlap, spans of different kinds may; positions are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from factlake.llm.common import column_udf, utf8_rows

SPANS_TYPE = "array<struct<kind: string, start: bigint, end: bigint>>"


@dataclass(frozen=True)
class Rule:
    """``head`` followed by one or more of the class ``tail``, then ``rest`` if it is there.

    A match counts if its tail has ``least`` characters; others are dropped after they
    were matched. ``rest`` lengthens a match but doesn't decide where one starts. ``sure``: so many tail characters are asked for before a start is marked,
    which may be over 1 only where it can't change what matches.
    """

    kind: str
    head: str
    tail: str
    least: int
    sure: int = 1
    any_case: bool = False
    rest: str = ""


# The three base rules.
BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""",
        r"[A-Za-z0-9+/_.=-]",
        8,
        any_case=True,
    ),
    Rule("access", r"AKIA", r"[A-Z0-9]", 12),
    Rule("hex", r"", r"[0-9a-f]", 32, sure=32),
)
#: A line break as such or written as \\n; white space or these; a key's characters.
_BREAK = r"[\x20\x09]*([\x0a\x0d]|\x5c+[nr])[\x20\x09]*"
_SPACE = r"([\x20\x09\x0a\x0d]|\x5c+[nr])*"
_BASE64 = r"[A-Za-z0-9+/=_-]"
#: All up to the END line; or, where there is none before the next five dashes, the header
#: fields and body lines: stretches of at least 16 characters, and a shorter last line.
_KEY_BODY = (
    r"(-?-?-?-?[\x00-\x2c\x2e-\xff])*-----END ([A-Z]+ )*PRIVATE KEY-----"
    rf"|(({_BREAK})+[A-Z][A-Za-z-]*:[\x20-\x5b\x5d-\xff]*)*"
    rf"({_SPACE}{_BASE64 * 15}{_BASE64}+)+(({_BREAK})+[A-Za-z0-9+/=]+)?"
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]", 36),
    Rule("slack", r"xox[abprs]-", r"[A-Za-z0-9-]", 10),
    Rule("google", r"AIza", r"[A-Za-z0-9_-]", 35),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", r"[A-Za-z0-9_-]", 10),
    Rule("private", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY----", r"[-]", 1, rest=_KEY_BODY),
)
RULES = BASE_RULES + MORE_RULES
BASE_KINDS = tuple(rule.kind for rule in BASE_RULES)


# ---- expressions: sets of bytes, sequences, alternatives, repetitions -----------------


class _Reader:
    """Reads the notation used above: classes, groups, ``|``, ``? * +`` and ``\\x20``."""

    def __init__(self, text: str, any_case: bool) -> None:
        self.text, self.at, self.any_case = text, 0, any_case

    def _more(self) -> str:
        return self.text[self.at : self.at + 1]

    def _byte(self) -> int:
        sign = self.text[self.at]
        self.at += 1
        if sign != "\\":
            return ord(sign)
        sign = self.text[self.at]
        self.at += 1
        if sign == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(sign)

    def _set(self, members: set[int]) -> tuple:
        if self.any_case:
            letters = {m for m in members if chr(m).isascii() and chr(m).isalpha()}
            members |= {ord(chr(m).swapcase()) for m in letters}
        return ("set", frozenset(members))

    def _class(self) -> tuple:
        members: set[int] = set()
        while self._more() != "]":
            low = self._byte()
            if self._more() == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                members |= set(range(low, self._byte() + 1))
            else:
                members.add(low)
        self.at += 1
        return self._set(members)

    def _one(self) -> tuple:
        sign = self._more()
        if sign == "[":
            self.at += 1
            return self._class()
        if sign == "(":
            self.at += 1
            inside = self.read()
            self.at += 1
            return inside
        return self._set({self._byte()})

    def read(self) -> tuple:
        choices, parts = [], []
        while self._more() not in ("", ")"):
            if self._more() == "|":
                self.at += 1
                choices.append(("seq", parts))
                parts = []
                continue
            part = self._one()
            while self._more() and self._more() in "?*+":
                part = ({"?": "maybe", "*": "any", "+": "some"}[self._more()], part)
                self.at += 1
            parts.append(part)
        choices.append(("seq", parts))
        return ("or", choices)


def _reversed(node: tuple) -> tuple:
    kind, inside = node
    if kind == "set":
        return node
    if kind == "seq":
        return (kind, [_reversed(x) for x in inside][::-1])
    if kind == "or":
        return (kind, [_reversed(x) for x in inside])
    return (kind, _reversed(inside))


class _Graph:
    """Nondeterministic automaton: free moves and moves on sets of bytes."""

    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, node: tuple, start: int) -> int:
        """Adds ``node`` behind ``start``; the state where it ends."""
        kind, inside = node
        if kind == "seq":
            for part in inside:
                start = self.add(part, start)
            return start
        end = self.state()
        if kind == "set":
            self.moves[start].append((inside, end))
        elif kind == "or":
            for part in inside:
                self.free[self.add(part, start)].append(end)
        else:
            loop = self.state()
            self.free[start].append(loop)
            last = self.add(inside, loop)
            self.free[last].append(end)
            if kind != "maybe":
                self.free[last].append(loop)
            if kind != "some":
                self.free[start].append(end)
        return end

    def closed(self, states: set[int]) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in found:
                    found.add(to)
                    todo.append(to)
        return frozenset(found)


@dataclass
class Automaton:
    """``step[state, of_byte[byte]]`` is the next state; ``label[state]`` a bit per rule."""

    step: np.ndarray
    of_byte: np.ndarray
    label: np.ndarray
    start: int
    key: bytes = field(default=b"")

    def __post_init__(self) -> None:
        parts = (self.step, self.of_byte, self.label, np.array([self.start]))
        self.key = hashlib.sha256(b"".join(p.tobytes() for p in parts)).digest()


def _byte_classes(sets: list[frozenset]) -> tuple[np.ndarray, list[int]]:
    seen: dict[tuple, int] = {}
    of_byte = np.zeros(256, dtype=np.int64)
    examples = []
    for byte in range(256):
        sign = tuple(byte in s for s in sets)
        if sign not in seen:
            seen[sign] = len(seen)
            examples.append(byte)
        of_byte[byte] = seen[sign]
    return of_byte, examples


def _determined(graph: _Graph, starts: set[int], ends: dict[int, int], anywhere: bool) -> Automaton:
    """Subset construction; ``anywhere``: a match may begin at any byte."""
    of_byte, examples = _byte_classes(
        sorted({s for moves in graph.moves for s, _ in moves}, key=sorted)
    )
    first = graph.closed(starts)
    number, steps, todo = {first: 0}, [], deque([first])
    while todo:
        states = todo.popleft()
        row = []
        for byte in examples:
            to = {t for s in states for members, t in graph.moves[s] if byte in members}
            after = graph.closed(to | starts if anywhere else to)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append(number[after])
        steps.append(row)
    label = np.array(
        [sum(1 << r for r in {ends[s] for s in states if s in ends}) for states in number],
        dtype=np.int64,
    )
    return _minimised(Automaton(np.array(steps, dtype=np.int64), of_byte, label, 0))


def _minimised(machine: Automaton) -> Automaton:
    """States that no text can tell apart become one: the partition is refined until
    every state of a part moves to the same parts."""
    _, part = np.unique(machine.label, return_inverse=True)
    n = 0
    while True:
        signs = np.column_stack([part, part[machine.step]])
        _, first, part = np.unique(signs, axis=0, return_index=True, return_inverse=True)
        part = part.ravel()
        if len(first) == n:
            break
        n = len(first)
    return Automaton(
        part[machine.step[first]], machine.of_byte, machine.label[first], int(part[machine.start])
    )


def _alone(node: tuple) -> Automaton:
    graph = _Graph()
    start = graph.state()
    return _determined(graph, {start}, {graph.add(node, start): 0}, anywhere=False)


_ROWS: dict[bytes, list] = {}


def _rows(machine: Automaton) -> list:
    """The transitions as rows that hold the next rows themselves, the label at 256, and
    at 257 whether the state is never left.

    Built once per Python worker: one index step per byte is all that the scan does.
    """
    if machine.key not in _ROWS:
        rows = [[None] * 258 for _ in range(len(machine.step))]
        steps = machine.step[:, machine.of_byte]
        for k, row in enumerate(rows):
            row[:256] = [rows[to] for to in steps[k]]
            row[256] = int(machine.label[k])
            row[257] = bool((steps[k] == k).all())
        _ROWS[machine.key] = rows
    return _ROWS[machine.key]


class Scanner:
    """All rules compiled; small arrays only, so that it travels with the task."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        graph, starts, ends = _Graph(), set(), {}
        self.whole, self.heads = [], []
        for k, rule in enumerate(rules):
            head = _Reader(rule.head, rule.any_case).read()
            tail = _Reader(rule.tail, rule.any_case).read()
            start = graph.state()
            starts.add(start)
            marked = ("seq", [head, *[tail] * (rule.sure - 1), ("some", tail)])
            ends[graph.add(_reversed(marked), start)] = k
            rest = ("maybe", _Reader(rule.rest, rule.any_case).read())
            self.whole.append(_alone(("seq", [head, ("some", tail), rest])))
            self.heads.append(_alone(head))
        self.marks = _determined(graph, starts, ends, anywhere=True)

    def _starts(self, text: bytes) -> list[tuple[int, int]]:
        """(place, label) wherever some rule's match starts, the last place first."""
        row = first = _rows(self.marks)[self.marks.start]
        for byte in reversed(text):
            row = row[byte]
            if row[256]:
                break
        else:
            return []
        found, row, at = [], first, len(text)
        for byte in reversed(text):
            row = row[byte]
            at -= 1
            if row[256]:
                found.append((at, row[256]))
        return found

    @staticmethod
    def _longest(machine: Automaton, text: bytes, start: int) -> int:
        """Where the longest match from ``start`` ends, -1 if there is none."""
        row = _rows(machine)[machine.start]
        end = start if row[256] else -1
        for at in range(start, len(text)):
            row = row[text[at]]
            if row[256]:
                end = at + 1
            elif row[257]:
                break
        return end

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in bytes, in order."""
        found = []
        marks = self._starts(text)[::-1]
        for k, rule in enumerate(self.rules if marks else ()):
            behind = 0
            for start, label in marks:
                if start < behind or not label >> k & 1:
                    continue
                end = behind = self._longest(self.whole[k], text, start)
                if end - self._longest(self.heads[k], text, start) >= rule.least:
                    found.append((start, k, end))
        return sorted(found)


def _code_points(text: bytes, places: list[int]) -> dict[int, int]:
    """Byte place -> code points before it."""
    out, at, count = {}, 0, 0
    for place in sorted(set(places)):
        count += len(text[at:place].decode())
        out[place] = count
        at = place
    return out


def secret_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The spans of all rules, ordered by start, then by rule."""
    scanner = Scanner(rules)
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    )

    def of_batch(texts: pa.Array) -> pa.Array:
        out = []
        for row in utf8_rows(texts):
            spans = scanner.spans(row)
            at = _code_points(row, [p for s, _, e in spans for p in (s, e)])
            out.append([(scanner.rules[k].kind, at[s], at[e]) for s, k, e in spans])
        return pa.array(out, kind)

    return column_udf(of_batch, SPANS_TYPE)(text)


def redacted(text: Column, rules: tuple[Rule, ...] = RULES, mask: str = "[secret]") -> Column:
    """The text with every stretch of overlapping spans replaced by ``mask``; null stays."""
    scanner = Scanner(rules)
    replacement = mask.encode()

    def of_batch(texts: pa.Array) -> pa.Array:
        out = []
        for row, known in zip(utf8_rows(texts), texts.is_valid().to_pylist()):
            parts, behind = [], 0
            for start, _, end in scanner.spans(row):
                if start >= behind:
                    parts += [row[behind:start], replacement]
                behind = max(behind, end)
            out.append(b"".join([*parts, row[behind:]]) if known else None)
        return pa.array(out, pa.binary()).cast(pa.string())

    return column_udf(of_batch, "string")(text)


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas; the empty string if there is none."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
