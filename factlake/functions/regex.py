"""Patterns written in Python's notation, for the JVM's regular expressions.

The JVM's ``\\w \\d \\s \\b`` are ASCII by default and differ from Python's even
with its Unicode flag (combining marks, fractions, control separators), so each
shorthand is spelled out.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from re import _constants as node, _parser

from pyspark.sql import Column, functions as F

_WORD = r"\p{L}\p{N}_"
_SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"
_DIGIT = r"\p{Nd}"
_EDGE = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"

SPACES = f"[{_SPACE}]+"
NON_SPACES = f"[^{_SPACE}]+"
NON_ASCII = r"[^\x00-\x7F]"


def jvm(pattern: str, ignore_case: bool = False) -> str:
    """``pattern`` in JVM syntax; ``.`` stops at a line feed only."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            shorthand = {"w": _WORD, "s": _SPACE, "d": _DIGIT}.get(pattern[i + 1])
            if shorthand:
                out.append(shorthand if in_class else f"[{shorthand}]")
            elif pattern[i + 1] == "b" and not in_class:
                out.append(_EDGE)
            else:
                out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        out.append(c)
        i += 1
    return ("(?iud)" if ignore_case else "(?d)") + "".join(out)


#: So many texts at most are looked for ahead of a pattern.
_MOST_LITERALS = 12


def _literals(items, letters: bool) -> frozenset[str] | None:
    """Texts of which every match of a parsed pattern holds one, or None if none are known."""
    found, run = [], ""

    def better(texts: frozenset[str]) -> tuple:
        shortest = min(map(len, texts))
        return min(shortest, 3), -len(texts), shortest

    for op, value in [*items, (None, None)]:
        if op is node.LITERAL and (letters or chr(value).isascii() and not chr(value).isalpha()):
            run += chr(value)
            continue
        if run:
            found.append(frozenset([run]))
            run = ""
        if op is node.SUBPATTERN:
            found.append(_literals(value[-1], letters))
        elif op is node.MAX_REPEAT and value[0] > 0:
            found.append(_literals(value[2], letters))
        elif op is node.BRANCH:
            each = [_literals(branch, letters) for branch in value[1]]
            found.append(None if None in each else frozenset().union(*each))
    known = [texts for texts in found if texts and len(texts) <= _MOST_LITERALS]
    return max(known, key=better, default=None)


@lru_cache
def literals(pattern: str, ignore_case: bool = False) -> tuple[str, ...]:
    """Texts of which every match of the pattern holds at least one; none if unknown."""
    return tuple(sorted(_literals(_parser.parse(pattern), not ignore_case) or ()))


#: So many texts at most are looked for ahead of a pattern if all that a match holds is looked for.
_MOST_HELD = 80


def _held(items, letters: bool) -> tuple | None:
    """What every match of a parsed pattern holds: ("text", t), ("all", ...) or ("any", ...)."""
    found, run = [], ""
    for op, value in [*items, (None, None)]:
        if op is node.LITERAL and (letters or chr(value).isascii() and not chr(value).isalpha()):
            run += chr(value)
            continue
        if run:
            found.append(("text", run))
            run = ""
        if op is node.SUBPATTERN:
            found.append(_held(value[-1], letters))
        elif op is node.MAX_REPEAT and value[0] > 0:
            found.append(_held(value[2], letters))
        elif op is node.BRANCH:
            each = [_held(branch, letters) for branch in value[1]]
            found.append(None if None in each else ("any", *dict.fromkeys(each)))
    known = [part for part in found if part]
    # Short texts are nearly everywhere.
    known = [part for part in known if _shortest(part) > 2] or known
    return ("all", *dict.fromkeys(known)) if len(known) > 1 else known[0] if known else None


def _shortest(part: tuple) -> int:
    """Of the texts one of which must be there the shortest one's length."""
    kind, *rest = part
    if kind == "text":
        return len(rest[0])
    return (max if kind == "all" else min)(map(_shortest, rest))


def _size(part: tuple) -> int:
    return 1 if part[0] == "text" else sum(map(_size, part[1:]))


@lru_cache
def held(pattern: str, ignore_case: bool = False) -> tuple | None:
    """What every match of the pattern holds, as nested ("all", ...), ("any", ...), ("text", t)."""
    found = _held(_parser.parse(pattern), not ignore_case)
    if found and _size(found) > _MOST_HELD:
        few = literals(pattern, ignore_case)
        return ("any", *[("text", t) for t in few]) if few else None
    return found


def holds(col: Column, part: tuple) -> Column:
    """Does the text hold all that ``part`` says? What is likely to be missing comes first."""
    kind, *rest = part
    if kind == "text":
        return F.contains(col, F.lit(rest[0]))
    if kind == "any":
        if all(p[0] == "text" for p in rest):
            # One expression, however many texts there are.
            texts = F.array(*[F.lit(p[1]) for p in rest])
            return F.exists(texts, lambda text: F.contains(col, text))
        return reduce(Column.__or__, [holds(col, p) for p in rest])
    return reduce(Column.__and__, [holds(col, p) for p in sorted(rest, key=_shortest, reverse=True)])


def matches(col: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Does the pattern occur?

    Looking for a plain text is many times faster than a pattern, so texts that every match
    holds come first. Testing for a word edge at every character is slow on the JVM, so the
    pattern without its edges, which matches wherever the pattern does, is tried next.
    """
    exact = _exact(col, pattern, ignore_case)
    found = [F.contains(col, F.lit(text)) for text in literals(pattern, ignore_case)]
    return reduce(Column.__or__, found) & exact if found else exact


def matches_in_long(col: Column, pattern: str, ignore_case: bool = False) -> Column:
    """:func:`matches` for long texts: all that every match holds comes first.

    ``col`` is used often: pass a column, not an expression.
    """
    exact, part = _exact(col, pattern, ignore_case), held(pattern, ignore_case)
    return holds(col, part) & exact if part else exact


def _exact(col: Column, pattern: str, ignore_case: bool) -> Column:
    exact = F.rlike(col, F.lit(jvm(pattern, ignore_case)))
    loose = pattern.replace(r"\b", "")
    if loose != pattern:
        exact = F.rlike(col, F.lit(jvm(loose, ignore_case))) & exact
    return exact


def find_all(col: Column, pattern: str, group: int = 0, ignore_case: bool = False) -> Column:
    return F.regexp_extract_all(col, F.lit(jvm(pattern, ignore_case)), F.lit(group))


def any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def contains_any(col: Column, words: list[str]) -> Column:
    """Does the text contain any of the words, as substrings?"""
    return F.rlike(col, F.lit("|".join(words)))
