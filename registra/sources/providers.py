"""The provider registry: names behind which rows come from tables, Parquet files, zones or something of one's own."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from registra.sources.request import RequestError, ScanRequest
from registra.sources.zones import ZoneCatalog

ABI = 1


@dataclass(frozen=True)
class Provider:
    """``create`` gives rows with the requested columns at least. Unless it ``filters_rows``, it may only have skipped work."""

    name: str
    create: Callable[[SparkSession, ScanRequest], DataFrame]
    describe: str = ""
    filters_rows: bool = False
    abi: int = ABI


class Registry:
    def __init__(self) -> None:
        self._held: dict[str, Provider] = {}

    def register(self, provider: Provider) -> None:
        if not re.fullmatch(r"[a-z][a-z0-9_]*", provider.name):
            raise RequestError(f"bad provider name: {provider.name!r}")
        if provider.name in self._held:
            raise RequestError(f"provider {provider.name} is registered already")
        if provider.abi > ABI:
            raise RequestError(f"provider {provider.name} needs version {provider.abi}; this is {ABI}")
        self._held[provider.name] = provider

    def get(self, name: str) -> Provider:
        if name not in self._held:
            raise RequestError(f"unknown provider: {name}")
        return self._held[name]

    def names(self) -> list[str]:
        return sorted(self._held)

    def listing(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p.name, p.describe, p.filters_rows, p.abi) for _, p in sorted(self._held.items())], "name string, description string, filters_rows boolean, abi int")

    def scan(self, spark: SparkSession, mode: str, request: ScanRequest) -> DataFrame:
        """Rows by ``mode``: a provider's name, or ext:<provider>:<path>. The range is always applied here too; where the
        provider has done so, Catalyst merges the two filters."""
        if mode.startswith("ext:"):
            found = re.fullmatch(r"ext:([a-z][a-z0-9_]*):(.+)", mode)
            if not found:
                raise RequestError(f"malformed mode {mode!r}; it is ext:<provider>:<path>")
            mode, request = found[1], ScanRequest(found[2], request.columns, request.key, request.lo, request.hi)
        df = self.get(mode).create(spark, request)
        request.validate(df.schema)
        return request.within(df).select(*request.columns)


def _table(spark: SparkSession, request: ScanRequest) -> DataFrame:
    return request.source if isinstance(request.source, DataFrame) else spark.table(request.source)


def _parquet(spark: SparkSession, request: ScanRequest) -> DataFrame:
    return spark.read.parquet(request.source)


def csv_provider(schema: str) -> Provider:
    """CSV files with a header line, read by a declared schema: types are never guessed from a part of the rows."""
    return Provider("csv", lambda s, r: s.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(r.source), "CSV files with a header, by a declared schema")


def default_registry(zones: ZoneCatalog | None = None) -> Registry:
    out = Registry()
    out.register(Provider("table", _table, "a table, view or DataFrame of the session"))
    out.register(Provider("parquet", _parquet, "Parquet files; projection and range reach the scan"))
    out.register(Provider("columnar", lambda s, r: s.read.format("orc").load(r.source), "ORC files; projection and range reach the scan"))
    if zones:
        out.register(Provider("zone", lambda _, r: zones.scan(r), "a valid zone that contains the range", filters_rows=True))
    return out


def s3a_settings(endpoint: str, access_key: str, secret_key: str, region: str = "us-east-1", attempts: int = 3, timeout_ms: int = 30_000) -> dict[str, str]:
    """Session settings for path-style object storage with bounded retries."""
    if not 1 <= attempts <= 5:
        raise RequestError(f"attempts must be 1 to 5, not {attempts}")
    fs = "spark.hadoop.fs.s3a"
    return {
        f"{fs}.endpoint": endpoint,
        f"{fs}.endpoint.region": region,
        f"{fs}.access.key": access_key,
        f"{fs}.secret.key": secret_key,
        f"{fs}.path.style.access": "true",
        f"{fs}.attempts.maximum": str(attempts),
        f"{fs}.connection.timeout": str(timeout_ms),
        f"{fs}.change.detection.mode": "server",
        f"{fs}.change.detection.source": "etag",
        "spark.sql.files.ignoreCorruptFiles": "false",
        "spark.sql.files.ignoreMissingFiles": "false",
    }
