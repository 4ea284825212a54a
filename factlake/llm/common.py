"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factlake.session import materialized

__all__ = ["materialized", "table", "fresh", "utf8_rows", "in_slices", "column_udf", "sha256_hex", "sampled"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str) -> str:
    """A column name that no caller's column can clash with."""
    return f"__{name}_{uuid4().hex[:12]}"


def utf8_rows(texts: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes, null as empty; nothing is decoded."""
    wide = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return [b"" if x is None else x for x in texts.cast(wide).to_pylist()]


def in_slices(rows: list[bytes], most: int = 4 << 20) -> Iterator[list[bytes]]:
    """Consecutive rows, at most ``most`` bytes together or one longer row: bounds memory."""
    part, size = [], 0
    for row in rows:
        if part and size + len(row) > most:
            yield part
            part, size = [], 0
        part.append(row)
        size += len(row)
    if part:
        yield part


def column_udf(function: Callable[[pa.Array], pa.Array], returns: str) -> Callable[..., Column]:
    """An Arrow function of one column, evaluated once where it stands.

    Without the mark Catalyst could push it into a filter and evaluate it again.
    """
    return F.arrow_udf(function, returns).asNondeterministic()


def sha256_hex(column: Column) -> Column:
    return F.sha2(column, 256)


def sampled(key: str, rows: int, of: int) -> Column:
    """True for about ``rows`` of ``of`` rows, chosen by a hash of ``key``; for all if there
    are no more. The hash is compared as 63 bits, so no number of rows leaves none."""
    share = min(1.0, rows / max(1, of))
    place = F.shiftrightunsigned(F.xxhash64(key, F.lit("sample")), 1)
    return place <= F.lit(min(int(share * 2**63), 2**63 - 1))
