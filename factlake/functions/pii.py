"""Personal data: finding, replacing and restoring it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from factlake.functions import fixed_values as fv
from factlake.functions.numbers import ascii_digits, let
from factlake.functions.regex import held, holds, jvm

SPAN = "struct<pii_type:string,value:string,start:int,end:int>"

# The characters a match can start with.  Looking at them first is far cheaper than
# looking for a word edge at every character.
_FIRST = {
    "api_key": "[skAg]",
    "email": r"[A-Za-z0-9._%+\-]",
    "ssn": r"\p{Nd}",
    "credit_card": r"\p{Nd}",
    "phone": r"[+(\p{Nd}]",
    "ip_address": r"\p{Nd}",
    "ipv6": "[A-Fa-f0-9:]",
    "iban": "[A-Z]",
    "token_in_url": "[tasbTASB\u017f]",
}


def luhn_ok(card: Column) -> Column:
    """Luhn checksum of 13 to 19 digits with separators between them."""
    digits = F.split(F.reverse(ascii_digits(F.regexp_replace(card, r"\P{Nd}", ""))), "")

    def worth(d: Column, i: Column) -> Column:
        n = d.cast("int")
        twice = F.when(n > 4, n * 2 - 9).otherwise(n * 2)
        return F.when(i % 2 == 1, twice).otherwise(n)

    total = F.aggregate(F.transform(digits, worth), F.lit(0), lambda a, d: a + d)
    return F.size(digits).between(13, 19) & (total % 10 == 0)


def _spans_of(text: Column, pii_type: str) -> Column:
    """All matches of one type; positions come from the lengths of the gaps between them."""
    rule, ignore_case = fv.PII_PATTERNS[pii_type], pii_type in fv.PII_IGNORE_CASE
    pattern = f"(?={_FIRST[pii_type]})(?:{jvm(rule, ignore_case)})"

    def placed(parts: Column) -> Column:
        def span(value: Column, i: Column) -> Column:
            start = F.aggregate(
                F.slice(parts["widths"], 1, i), F.lit(0), lambda a, w: a + w
            ) + F.element_at(parts["gaps"], i + 1)
            return F.struct(
                F.lit(pii_type).alias("pii_type"),
                value.alias("value"),
                start.alias("start"),
                (start + F.length(value)).alias("end"),
            )

        return F.transform(parts["found"], span)

    none = F.array().cast(f"array<{SPAN}>")

    def cut(found: Column) -> Column:
        """The text between the matches is looked for only where there are any."""
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        spans = let(
            F.struct(found.alias("found"), gaps.alias("gaps")),
            lambda p: let(
                F.struct(
                    p["found"].alias("found"),
                    p["gaps"].alias("gaps"),
                    F.zip_with(
                        p["found"], F.slice(p["gaps"], 1, F.size(p["found"])), lambda v, g: F.length(v) + g
                    ).alias("widths"),
                ),
                placed,
            ),
        )
        return F.when(F.size(found) > 0, spans).otherwise(none)

    spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), cut)
    if pii_type == "credit_card":
        spans = F.filter(spans, lambda s: luhn_ok(s["value"]))
    part = held(rule, ignore_case)
    return F.when(holds(text, part) if part else text.isNotNull(), spans).otherwise(none)


def pii_spans(text: Column) -> Column:
    """``array<struct<pii_type,value,start,end>>`` sorted by start.

    Each type is looked for in the original text; a match that overlaps one of a type
    of higher priority is dropped.
    """

    def free(kept: Column, found: Column) -> Column:
        return F.concat(
            kept,
            F.filter(
                found,
                lambda s: ~F.exists(kept, lambda k: (s["start"] < k["end"]) & (k["start"] < s["end"])),
            ),
        )

    by_type = F.array(*[_spans_of(text, t) for t in fv.PII_PATTERNS])
    kept = F.aggregate(by_type, F.array().cast(f"array<{SPAN}>"), free)
    by_start = F.sort_array(F.transform(kept, lambda s: F.struct(s["start"].alias("at"), s.alias("s"))))
    return F.transform(by_start, lambda x: x["s"])


def with_placeholders(spans: Column) -> Column:
    """Add ``placeholder``: the k-th span of a type in text order is ``[TYPE_k]``."""

    def named(s: Column, i: Column) -> Column:
        nth = F.size(F.filter(F.slice(spans, 1, i + 1), lambda o: o["pii_type"] == s["pii_type"]))
        return F.struct(
            s["pii_type"].alias("pii_type"),
            s["value"].alias("value"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.format_string("[%s_%d]", F.upper(s["pii_type"]), nth).alias("placeholder"),
        )

    return F.transform(spans, named)


def scrubbed(text: Column, named: Column) -> Column:
    """The text with every span replaced by its placeholder."""
    ends = F.concat(F.array(F.lit(0)), F.transform(named, lambda s: s["end"]))
    pieces = F.transform(
        named,
        lambda s, i: F.concat(
            F.substr(text, F.element_at(ends, i + 1) + 1, s["start"] - F.element_at(ends, i + 1)),
            s["placeholder"],
        ),
    )
    rest = F.substr(text, F.element_at(ends, -1) + 1)
    return F.when(F.size(named) == 0, text).otherwise(F.concat(F.array_join(pieces, ""), rest))


def vault_map(named: Column) -> Column:
    """``map<placeholder, value>``."""
    return F.map_from_arrays(
        F.transform(named, lambda s: s["placeholder"]), F.transform(named, lambda s: s["value"])
    )


def restored(text: Column, mapping: Column) -> Column:
    """Every placeholder in the text replaced by its original."""
    return F.aggregate(
        F.map_entries(mapping), text, lambda t, e: F.replace(t, e["key"], e["value"])
    )
