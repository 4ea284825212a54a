"""Turning arrays into rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def unnest(df: DataFrame, array: str, *keep: str, name: str = "item", position: str | None = None) -> DataFrame:
    """One row per array element, with the ``keep`` columns.

    A plain ``explode`` of a computed column makes the optimizer add a filter on the
    array's size and push it, with the whole expression, below the projection, so
    that the array is computed twice or more.  The outer form does not.
    """
    if position:
        out = df.select(*keep, F.posexplode_outer(array).alias(position, name))
    else:
        out = df.select(*keep, F.explode_outer(array).alias(name))
    return out.where(F.col(name).isNotNull())


def staged(df: DataFrame, *names: str) -> DataFrame:
    """The same rows, with the columns ``names`` behind a stage boundary.

    Catalyst writes the expression of a column into every place above that uses it, and
    moves filters below the projection that makes it: over several steps that build on each
    other the plan grows without end. It does neither across a generator, so each of
    ``names`` is worked out once and is a plain column from here on. Nothing is written and
    nothing is shuffled; it works on streams, too.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c not in names]
    one = F.array(F.struct(*[F.col(f"`{c}`") for c in names]))
    return df.select(*others, F.inline_outer(one))
