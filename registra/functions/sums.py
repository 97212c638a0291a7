"""Sums that never wrap, and group keys as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def checked_sum(name: str) -> Column:
    """SUM as bigint or decimal; ANSI arithmetic raises when the result is out of range."""
    return F.sum(F.col(name))


def exact_sum(name: str, kind: T.DataType) -> Column:
    """SUM beyond 64 bits: bigint is summed as a decimal of 29 digits, int as bigint, decimals with ten digits more."""
    return F.sum(F.col(name).cast("decimal(19,0)")) if isinstance(kind, T.LongType) else F.sum(F.col(name))


def key_text(names: list[str]) -> Column:
    """Group keys joined by |, NULL as \\N, which no number renders as."""
    return F.concat_ws("|", *[F.coalesce(F.col(n).cast("string"), F.lit("\\N")) for n in names])
