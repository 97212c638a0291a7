"""Mixed representations: each partition comes from its zone where one covers all of it, from its table otherwise."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from registra.sources.request import RequestError, ScanRequest, meets
from registra.sources.zones import ZoneCatalog


@dataclass(frozen=True)
class Partition:
    """A child table whose keys are declared to lie in lo..hi; None is no bound."""

    path: str
    lo: Any = None
    hi: Any = None


def route(spark: SparkSession, children: list[str], columns: list[str], zones: ZoneCatalog | None = None) -> list[tuple[str, str]]:
    """(child, path to read) for each child; a zone's path stands for the child's only if it holds every row."""
    out = []
    for child in children:
        zone = zones.covering(child, columns) if zones else None
        out.append((child, zone.path if zone else child))
    return out


def union_partitions(spark: SparkSession, children: list[str | Partition], request: ScanRequest, zones: ZoneCatalog | None = None) -> DataFrame:
    """All rows of the children in the request's range, as one relation with its columns. A child whose declared range does
    not meet the request's is not read; neither are rows without a key, if the request has a range."""
    if not children:
        raise RequestError("no partition")
    parts = [c if isinstance(c, Partition) else Partition(c) for c in children]
    read = [p.path for p in parts if meets(p.lo, p.hi, request.lo, request.hi)]
    frames = []
    for _, path in route(spark, read or [parts[0].path], list(request.columns), zones):
        df = spark.read.parquet(path)
        request.validate(df.schema)
        df = request.within(df).select(*request.columns)
        frames.append(df if read else df.limit(0))
    return reduce(DataFrame.unionByName, frames)
