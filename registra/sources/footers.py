"""What Parquet footers say: columns, sizes, counts, and the row groups that a range can skip. Read through Hadoop, so any store will do."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _groups(spark: SparkSession, path: str) -> Iterator:
    """The row groups of all files, whose footers are read by the JVM's own threads in one call."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at, statuses = jvm.org.apache.hadoop.fs.Path(path), jvm.java.util.ArrayList()
    files = at.getFileSystem(conf).listFiles(at, True)
    while files.hasNext():
        status = files.next()
        if not status.getPath().getName().startswith(("_", ".")):
            statuses.add(status)
    footers = jvm.org.apache.parquet.hadoop.ParquetFileReader.readAllFootersInParallel(conf, statuses, False)
    for footer in sorted(footers, key=lambda f: f.getFile().toString()):
        yield from footer.getParquetMetadata().getBlocks()


def footer_count(spark: SparkSession, path: str) -> DataFrame:
    """One row, n: COUNT(*) from footers alone. The aggregate is pushed into the scan, which only newer sources allow; no column is read."""
    old, spark_conf = spark.conf.get("spark.sql.sources.useV1SourceList"), spark.conf
    spark_conf.set("spark.sql.parquet.aggregatePushdown", "true")
    spark_conf.set("spark.sql.sources.useV1SourceList", ",".join(x for x in old.split(",") if x != "parquet"))
    try:
        df = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))
        df._jdf.queryExecution().executedPlan()  # planned while the settings hold
    finally:
        spark_conf.set("spark.sql.sources.useV1SourceList", old)
    return df


def parquet_columns(spark: SparkSession, path: str) -> DataFrame:
    """(col, name, type, compressed_bytes) of every column chunk, summed over row groups."""
    held: dict[str, list] = {}
    for block in _groups(spark, path):
        for i, chunk in enumerate(block.getColumns()):
            own = held.setdefault(chunk.getPath().toDotString(), [i, chunk.getPrimitiveType().getPrimitiveTypeName().name(), 0])
            own[2] += chunk.getTotalSize()
    return spark.createDataFrame([(i, name, kind, size) for name, (i, kind, size) in held.items()], "col int, name string, type string, compressed_bytes long")


def row_groups(spark: SparkSession, path: str, key: str, lo: int | None = None, hi: int | None = None) -> tuple[int, int]:
    """(total, those a closed range must read), derived from footers: a group without declared bounds is always read."""
    total = read = 0
    for block in _groups(spark, path):
        total += 1
        stats = next((c.getStatistics() for c in block.getColumns() if c.getPath().toDotString() == key), None)
        known = stats is not None and stats.hasNonNullValue()
        nothing = stats is not None and not known and stats.isNumNullsSet() and stats.getNumNulls() == block.getRowCount()
        if known:
            read += not ((hi is not None and stats.genericGetMin() > hi) or (lo is not None and stats.genericGetMax() < lo))
        else:
            read += not (nothing and (lo is not None or hi is not None))
    return total, read


def scan_totals(df: DataFrame, first: str, last: str) -> DataFrame:
    """One row: count, sum, min, max and NULLs of the last column, and the sum of the first where the last is NULL."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col(last).cast("decimal(19,0)")).cast("decimal(38,0)").alias("sum_last"),
        F.min(last).cast("long").alias("min_last"),
        F.max(last).cast("long").alias("max_last"),
        F.count_if(F.col(last).isNull()).alias("nulls_last"),
        F.sum(F.when(F.col(last).isNull(), F.col(first).cast("decimal(19,0)"))).cast("decimal(38,0)").alias("sum_first_null"),
    )
