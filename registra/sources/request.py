"""What is asked of a source: a table or path, columns in order, and one closed range on a key."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from registra.functions.types import RANGED, check_types


class RequestError(ValueError):
    """A request that no source may answer; nothing is read."""


def in_range(df: DataFrame, key: str, lo: Any = None, hi: Any = None) -> DataFrame:
    """Rows with lo <= key <= hi; a bound that is None is no bound."""
    if lo is not None:
        df = df.where(F.col(key) >= lo)
    return df.where(F.col(key) <= hi) if hi is not None else df


def contains(lo: Any, hi: Any, inner_lo: Any, inner_hi: Any) -> bool:
    """Whether lo..hi holds all of inner_lo..inner_hi; None is no bound."""
    return (lo is None or inner_lo is not None and lo <= inner_lo) and (hi is None or inner_hi is not None and hi >= inner_hi)


def meets(lo: Any, hi: Any, other_lo: Any, other_hi: Any) -> bool:
    """Whether two ranges have a value in common; None is no bound."""
    return (lo is None or other_hi is None or lo <= other_hi) and (hi is None or other_lo is None or other_lo <= hi)


@dataclass(frozen=True)
class ScanRequest:
    source: Any  # a table name, a path, or a DataFrame
    columns: tuple[str, ...]
    key: str | None = None  # the ranged column; the first one unless told otherwise
    lo: Any = None
    hi: Any = None

    @property
    def ranged(self) -> bool:
        return self.lo is not None or self.hi is not None

    @property
    def on(self) -> str:
        return self.key or self.columns[0]

    def within(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` in the request's range."""
        return in_range(df, self.on, self.lo, self.hi)

    def validate(self, schema: T.StructType) -> None:
        """Refuse unknown and repeated columns, foreign types, and bounds that the key's type cannot hold."""
        if not self.columns:
            raise RequestError("no column requested")
        if repeated := {c for c in self.columns if self.columns.count(c) > 1}:
            raise RequestError(f"column requested more than once: {', '.join(sorted(repeated))}")
        if unknown := [c for c in (*self.columns, self.on) if c not in schema.names]:
            raise RequestError(f"unknown column: {', '.join(unknown)}")
        check_types(schema, list(self.columns))
        if self.ranged:
            check_types(schema, [self.on], RANGED)
            bits = {T.IntegerType: 31, T.LongType: 63}.get(type(schema[self.on].dataType))
            for bound in (self.lo, self.hi):
                if bits and bound is not None and not -(1 << bits) <= bound < 1 << bits:
                    raise RequestError(f"bound {bound} is outside the range of {self.on}")
