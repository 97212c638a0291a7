"""Cell by cell: what a source delivers, and whether a provider keeps its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registra.functions.types import UnsupportedTypeError, check_types
from registra.sources.providers import Registry
from registra.sources.request import RequestError, ScanRequest
from registra.sources.zones import ZoneError


def probe_cells(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """(rownum, col, coltype, is_null, val): one row per cell, with ``row_id`` as the row's number."""
    check_types(df.schema, columns)
    cells = [F.struct(F.lit(i + 1).alias("col"), F.lit(df.schema[c].dataType.simpleString()).alias("coltype"), F.col(c).isNull().alias("is_null"), F.col(c).cast("string").alias("val")) for i, c in enumerate(columns)]
    return df.select(F.col(row_id).cast("long").alias("rownum"), F.explode(F.array(*cells)).alias("c")).select("rownum", "c.*")


def conformance(spark: SparkSession, registry: Registry, mode: str, request: ScanRequest, expected: DataFrame) -> DataFrame:
    """(check, status, detail): each rule of the provider contract as PASS, FAIL or SKIP."""
    out: list[tuple[str, str, str]] = []

    def rule(name: str, test) -> None:
        try:
            said = test()
            out.append((name, "SKIP" if said else "PASS", said or ""))
        except Exception as e:  # noqa: BLE001  a rule that breaks has failed, whatever broke
            out.append((name, "FAIL", f"{type(e).__name__}: {str(e)[:200]}"))

    def scan(**changes) -> DataFrame:
        return registry.scan(spark, mode, ScanRequest(**{"source": request.source, "columns": request.columns, "key": request.key, "lo": request.lo, "hi": request.hi} | changes))

    def same() -> None:
        a, b = scan(), expected.select(*request.columns)
        if a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count():
            raise AssertionError("rows differ")

    def refused(kind, **changes) -> None:
        try:
            scan(**changes)
        except kind:
            return
        except Exception as e:  # noqa: BLE001
            if "UNRESOLVED_COLUMN" in str(e):
                return
            raise
        raise AssertionError("accepted")

    def projected() -> None:
        if scan(columns=request.columns[::-1], key=request.on).columns != list(request.columns[::-1]):
            raise AssertionError("columns are not in the order asked for")

    def empty() -> str | None:
        if not request.ranged:
            return "no range"
        if registry.get(mode.split(":")[1] if mode.startswith("ext:") else mode).name == "zone":
            return "a zone serves only what it contains"
        if scan(lo=request.hi + 1, hi=request.lo - 1).count():
            raise AssertionError("rows outside the range")

    def twice() -> None:
        df = scan()
        if df.count() != df.count():
            raise AssertionError("a second read differs")

    rule("rows", same)
    rule("projection", projected)
    rule("empty_range", empty)
    rule("rescan", twice)
    rule("unknown_column", lambda: refused((RequestError, UnsupportedTypeError, ZoneError), columns=("no_such_column",), key=None))
    rule("repeated_column", lambda: refused(RequestError, columns=(request.columns[0], request.columns[0])))
    return spark.createDataFrame(out, "check string, status string, detail string")
