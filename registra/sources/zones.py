"""Zones: derived snapshots of some columns over one closed key range, kept as Parquet with a manifest.

A zone serves a request only if its range contains the request's, it has all columns, it is marked valid, and its source's
files and schema are still those that it was built from. Its rows are filtered again. A bound that is None is no bound, of a
zone and of a request alike.

Every build writes to a folder of its own name; the manifest names that folder and is swapped in by one atomic rename. So
readers see the zone before or the zone after, whole, and one that has planned on the zone before can still finish: its
folder stays until vacuum().
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import asdict, dataclass
from typing import Any

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from registra.sources.identity import SourceChangedError, fingerprint
from registra.sources.request import ScanRequest, contains

VALID, STALE, MISSING, NOT_FOUND = "VALID", "STALE", "MISSING", "NOT_FOUND"
FORMAT = 2


class ZoneError(RuntimeError):
    """No zone can serve what was asked for by name."""


@dataclass
class Manifest:
    table: str
    key: str
    lo: int | None
    hi: int | None
    columns: list[str]
    rows: int
    source_rows: int
    bytes: int
    state: str
    schema: dict[str, Any]
    files: list[int]  # the source's fingerprint
    built: float
    path: str
    format: int = FORMAT


class ZoneCatalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _place(self, m: Manifest) -> str:
        """The manifest's path: a zone of another key, other columns or another range is another zone."""
        name = json.dumps([m.table, m.key, sorted(m.columns), m.lo, m.hi])
        return f"{self.root}/{hashlib.sha256(name.encode()).hexdigest()[:32]}.json"

    def _write(self, m: Manifest) -> None:
        """Put the manifest in place of the one before, by a rename that overwrites.

        A local file system keeps a checksum in a file beside each, which would be renamed apart from it, and its rename with
        the overwrite option deletes first. So there the manifest is written without one, by the file system underneath, whose
        plain rename overwrites.
        """
        jvm, place = self.spark._jvm, self._place(m)
        fs, at = self._fs(f"{place}.{uuid.uuid4().hex}.tmp")
        to = self._fs(place)[1]
        checked = is_instance_of(self.spark.sparkContext._gateway, fs, "org.apache.hadoop.fs.ChecksumFileSystem")
        raw = fs.getRawFileSystem() if checked else fs
        out = raw.create(at, True)
        out.write(bytearray(json.dumps(asdict(m)).encode()))
        out.close()
        if checked:
            raw.delete(fs.getChecksumFile(to), False)  # of a manifest that was written with one
            if not raw.rename(at, to):
                raise ZoneError(f"{place} could not be replaced")
            return
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(to).toUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(at), fs.makeQualified(to), over)

    def _all(self) -> list[Manifest]:
        fs, at = self._fs(self.root)
        if not fs.exists(at):
            return []
        out = []
        for status in fs.listStatus(at):
            if status.getPath().getName().endswith(".json"):
                stream = fs.open(status.getPath())
                m = json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
                stream.close()
                if m["format"] != FORMAT:
                    raise ZoneError(f"{status.getPath()} has format {m['format']}; this reads {FORMAT}")
                out.append(Manifest(**m))
        return sorted(out, key=lambda m: (m.table, m.lo is not None, m.lo or 0, m.hi is None, m.hi or 0, m.key, m.columns))

    def build(self, table: str, columns: list[str], lo: int | None = None, hi: int | None = None, key: str | None = None) -> Manifest:
        """Materialise ``columns`` of the Parquet table at ``table`` for lo <= key <= hi, in place of the zone of the same table, key, columns and range."""
        files = fingerprint(self.spark, table)
        source = self.spark.read.parquet(table)
        request = ScanRequest(table, tuple(columns), key, lo, hi)
        request.validate(source.schema)
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        # Sorted inside files, so that row groups have narrow bounds for later ranges.
        request.within(source).select(*dict.fromkeys([request.on, *columns])).sortWithinPartitions(request.on).write.parquet(path)
        source_rows = source.count()
        if fingerprint(self.spark, table) != files:
            raise SourceChangedError(f"{table} changed while a zone was built")
        held = self.spark.read.parquet(path)
        size = fingerprint(self.spark, path)[1]
        m = Manifest(table, request.on, lo, hi, held.columns, held.count(), source_rows, size, VALID, held.schema.jsonValue(), list(files), time.time(), path)
        self._write(m)
        return m

    def state(self, m: Manifest) -> str:
        """VALID only while the files are there and the source's files, and with them its schema, are what they were."""
        fs, at = self._fs(m.path)
        if not fs.exists(at):
            return MISSING
        if m.state != VALID:
            return m.state
        try:
            return VALID if list(fingerprint(self.spark, m.table)) == m.files else STALE
        except SourceChangedError:
            return STALE

    def read(self, m: Manifest) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(m.schema)).parquet(m.path)

    def lookup(self, request: ScanRequest) -> Manifest | None:
        """The smallest valid zone that contains the request, if any."""
        fit = [m for m in self._all() if m.table == request.source and m.key == request.on and contains(m.lo, m.hi, request.lo, request.hi) and {*request.columns} <= {*m.columns}]
        # Rows without a key are in a zone only if it has no bounds.
        fit = [m for m in fit if request.ranged or m.lo is None and m.hi is None]
        for m in sorted(fit, key=lambda m: (m.rows, m.built)):
            if self.state(m) == VALID:
                return m
        return None

    def covering(self, table: str, columns: list[str]) -> Manifest | None:
        """A valid zone that holds all rows of ``table``, by the counts taken when it was built; rows whose key is null are in no zone with bounds."""
        for m in self._all():
            if m.table == table and m.rows == m.source_rows and {*columns} <= {*m.columns} and self.state(m) == VALID:
                return m
        return None

    def scan(self, request: ScanRequest) -> DataFrame:
        m = self.lookup(request)
        if m is None:
            raise ZoneError(f"no valid zone holds {request.on} {request.lo}..{request.hi} of {request.source}")
        return request.within(self.read(m)).select(*request.columns)

    def invalidate(self, table: str, lo: int | None, hi: int | None) -> str:
        """Mark the zones of this table and range, of whatever key and columns."""
        found = [m for m in self._all() if (m.table, m.lo, m.hi) == (table, lo, hi)]
        for m in found:
            m.state = STALE
            self._write(m)
        return STALE if found else NOT_FOUND

    def drop(self, table: str, lo: int | None, hi: int | None) -> None:
        """Manifests and files of this table's zones of this range go; a zone that is not there is no error."""
        for m in self._all():
            if (m.table, m.lo, m.hi) == (table, lo, hi):
                for path in (self._place(m), m.path):
                    fs, at = self._fs(path)
                    fs.delete(at, True)

    def vacuum(self, older_than: float = 86_400.0) -> int:
        """Remove folders that no manifest names and that were written this many seconds ago or earlier; how many."""
        fs, at = self._fs(f"{self.root}/data")
        if not fs.exists(at):
            return 0
        named, gone = {m.path.rsplit("/", 1)[1] for m in self._all()}, 0
        for status in fs.listStatus(at):
            if status.getPath().getName() not in named and status.getModificationTime() / 1000 <= time.time() - older_than:
                fs.delete(status.getPath(), True)
                gone += 1
        return gone

    def info(self) -> DataFrame:
        kind = T.StructType([T.StructField(n, t()) for n, t in (("table", T.StringType), ("key", T.StringType), ("lo", T.LongType), ("hi", T.LongType), ("rows", T.LongType), ("bytes", T.LongType), ("state", T.StringType), ("built", T.DoubleType), ("path", T.StringType))])
        rows: list[tuple[Any, ...]] = [(m.table, m.key, m.lo, m.hi, m.rows, m.bytes, self.state(m), m.built, m.path) for m in self._all()]
        return self.spark.createDataFrame(rows, kind)
