"""Inputs that must not change while they are read.

A fingerprint of paths, sizes and modification times is taken when a plan is made and compared before and after its action.
Spark lists and hashes the files, so the driver holds one row however many there are. A replacement that is undone inside one
action is not seen; readers that pin object versions are needed for that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Number of files, their bytes, and the combined hash of (path, size, modification time).
Fingerprint = tuple[int, int, int]


class SourceChangedError(RuntimeError):
    """An input file has changed, come or gone since the plan was made."""


def fingerprint(spark: SparkSession, *paths: str) -> Fingerprint:
    """Of all files at these paths, through the file system that Spark itself would use. Contents are not read."""
    conf = spark._jsc.hadoopConfiguration()
    for path in paths[:1] if len(paths) > 100 else paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(conf).exists(at):
            raise SourceChangedError(f"{path} is missing")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).select("path", "length", "modificationTime")
    row = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("path", "length", "modificationTime")), F.lit(0))).first()
    return tuple(row)


def snapshot(spark: SparkSession, paths: list[str]) -> dict[str, Fingerprint]:
    """The fingerprint of each path."""
    return {path: fingerprint(spark, path) for path in paths}


@contextmanager
def unchanged(df: DataFrame, seen: dict[str, Fingerprint] | None = None) -> Iterator[None]:
    """Raise if an input of ``df`` differs from ``seen`` (from now, if not given) before or after the block."""
    spark = df.sparkSession

    def now() -> dict[str, Fingerprint]:
        return snapshot(spark, list(seen)) if seen else {"its input": fingerprint(spark, *files)}

    files = [] if seen else sorted(df.inputFiles())
    first = seen or now()

    def check() -> None:
        if changed := sorted(p for p, f in now().items() if f != first[p]):
            raise SourceChangedError(f"changed: {', '.join(changed)}")

    check()
    yield
    check()


def guarded(df: DataFrame, action: Callable[[DataFrame], object], seen: dict[str, Fingerprint] | None = None) -> object:
    """The result of an action on ``df``, or SourceChangedError instead of rows that may be mixed."""
    with unchanged(df, seen):
        return action(df)
