"""Digits of any script, and rounding that does not depend on a double's printed form."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, functions as F

_SCALE = 1 << 62
#: Decimal digits of all scripts but ASCII's; patterns accept them, casts don't.
_OTHER_DIGITS = "".join(
    chr(c) for c in range(128, 0x110000) if unicodedata.category(chr(c)) == "Nd"
)
_THEIR_VALUES = "".join(str(unicodedata.decimal(d)) for d in _OTHER_DIGITS)


def ascii_digits(col: Column) -> Column:
    """The text with every decimal digit written as 0 to 9."""
    return F.translate(col, _OTHER_DIGITS, _THEIR_VALUES)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def exact_round(value: Column, digits: int) -> Column:
    """Half-even rounding of the exact binary value, for 0 <= value <= 1.

    ``round`` works on the printed decimal (0.125 -> 0.13).  Only values within a
    hair of a tie need the exact integer arithmetic, so the others stay on the
    double path.  ``value`` is used several times: pass a column, not an expression.
    """
    unit = 10**digits
    scaled = value * F.lit(float(unit))
    whole = F.floor(scaled).cast("long")
    units = (value * F.lit(float(_SCALE))).cast("long").cast("decimal(20,0)")
    scale, half = F.lit(str(_SCALE)).cast("decimal(20,0)"), F.lit(str(_SCALE // 2)).cast("decimal(26,0)")
    rest = units * F.lit(unit).cast("decimal(6,0)") - whole.cast("decimal(12,0)") * scale
    up = (rest > half) | ((rest == half) & (whole % 2 == 1))
    near_tie = F.abs(scaled - whole - F.lit(0.5)) < 1e-6
    return F.when(near_tie, whole + up.cast("long")).otherwise(F.floor(scaled + 0.5)) / F.lit(
        float(unit)
    )


def fixed2(value: Column) -> Column:
    """The value with two decimals, as text."""
    return F.format_string("%.2f", exact_round(value, 2))


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """``part / whole`` as a double, or ``empty`` where there is nothing to divide by."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(
        F.lit(empty)
    )
