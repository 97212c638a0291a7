"""Sessions with the settings that the engine's results depend on, and the package on every executor."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: ANSI arithmetic raises on overflow; UTC makes timestamps compare alike everywhere; a broken or missing file is an error, and
#: counts come from footers where a source can take aggregates.
SETTINGS = {"spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.files.ignoreCorruptFiles": "false", "spark.sql.files.ignoreMissingFiles": "false", "spark.sql.parquet.aggregatePushdown": "true"}


def get_session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.config(map=SETTINGS | settings)
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each context, so that they need no installation or search path."""
    context = spark.sparkContext
    if getattr(context, "_registra_shipped", False):
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="registra-")) / "registra.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    context.addPyFile(str(path))
    context._registra_shipped = True
