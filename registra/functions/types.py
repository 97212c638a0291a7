"""The types that a source may deliver, and the fingerprint of a schema."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import types as T

#: Carried and computed on; strings and binaries are carried, compared and grouped.
SCANNED = (T.IntegerType, T.LongType, T.DecimalType, T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)
MEASURES = (T.IntegerType, T.LongType, T.DecimalType)
RANGED = (T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType)


class UnsupportedTypeError(TypeError):
    """A column's type is outside the contract; the message names both."""


def check_types(schema: T.StructType, names: list[str], allowed: tuple[type, ...] = SCANNED) -> None:
    for name in names:
        if not isinstance(kind := schema[name].dataType, allowed):
            raise UnsupportedTypeError(f"column {name} has unsupported type {kind.simpleString()}")


def schema_fingerprint(schema: T.StructType, names: list[str] | None = None) -> str:
    """A hash of the ordered (name, type, nullable) list. Parquet reads are always nullable, so files are compared by name and type."""
    fields = [schema[n] for n in names] if names else schema.fields
    return hashlib.sha256(json.dumps([(f.name, f.dataType.jsonValue()) for f in fields]).encode()).hexdigest()
