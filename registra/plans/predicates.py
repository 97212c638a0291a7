"""Which conjuncts a source can take, for explaining plans. Answers never depend on it: Spark filters whatever is left."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

_COMPARISON = re.compile(r"^\s*(?P<a>[^<>=]+?)\s*(?P<op><=|>=|=|<|>)\s*(?P<b>[^<>=]+?)\s*$")
_FLIP = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "=": "="}
_CONSTANT = re.compile(r"^(-?\d+|date\s*'[^']*'|timestamp\s*'[^']*')$", re.IGNORECASE)
_PUSHED = (T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class Classified:
    pushed: tuple[tuple[str, str, str], ...]
    residual: tuple[str, ...]


def classify_predicates(conjuncts: list[str], schema: T.StructType) -> Classified:
    """Column-and-constant comparisons over ranged types are pushed, with the column first; the rest is residual."""
    pushed, residual = [], []
    for text in conjuncts:
        m = _COMPARISON.match(text)
        a, op, b = (m["a"], m["op"], m["b"]) if m else ("", "", "")
        if _CONSTANT.match(a):
            a, op, b = b, _FLIP[op], a
        if a in schema.names and isinstance(schema[a].dataType, _PUSHED) and _CONSTANT.match(b):
            pushed.append((a, op, b))
        else:
            residual.append(text)
    return Classified(tuple(pushed), tuple(residual))
