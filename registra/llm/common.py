"""What the corpus operators share: ASCII case folding, held-out rows, and cutting lineage on shared storage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registra.session import ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Bounds of the batches that Python gets, where the session sets none: rows are whole documents or sets, and some are long.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20)}
#: Tables up to this size are dealt to all cores before they are worked on.
SPREAD_BYTES = 32 << 20
#: Rows that are read at a time in small_batches().
READ_ROWS = "512"
#: Bytes of the source, as the optimizer knows them, that one partition of a table to be written may have.
GATHER = 64 << 20
#: Short rows that a file of an intermediate table may hold; HEAVY says how many of them a row with a whole text or set weighs.
HEAVY = 50
ROWS_A_FILE = 250_000
#: Short rows up to which one key may have all of them without harm.
PLAIN = 200_000
#: The words of a whitespace-cut contract, as a Java regular expression.
WORD = "[^\\x20\\x09-\\x0D]+"
#: A block of bits is for 2 to the power of this rows (Spark's bitmaps have as many bits); bytes of all blocks up to which they are broadcast.
BLOCK = 15
BITS_BYTES = 32 << 20


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the rows that no model may learn from; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    told = spark._jsparkSession.sessionState().conf()
    for key, value in ARROW.items():
        if not told.contains(key):
            spark.conf.set(key, value)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # A small file may be one row group, which one task would read and work on alone.
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where the session has none, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="registra-"))
        path = context._jsc.sc().getCheckpointDir().get()
    return path.rstrip("/")


def cut(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """The same rows, written to the shared folder and read back: a lost executor costs no recomputation.

    ``rows``, where known, decides the number of files: a table for millions of rows does not need one for each partition of
    the stage that made it, and on local file systems each file starts child processes to set its permissions.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/registra/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.repartition(parts_for(rows, ROWS_A_FILE))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._registra_path = path
    if open_scopes():
        open_scopes()[-1].append(out)
    return out


def gathered(df: DataFrame) -> DataFrame:
    """The same rows in fewer partitions, without a shuffle, where the source is dealt over very many: GATHER bytes of it each, but
    enough of them for all cores. Of a table that is written then, each file starts child processes to set its permissions,
    and while one starts it has the executor's whole memory a second time."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = parts_for(size, GATHER, 2 * df.sparkSession.sparkContext.defaultParallelism)
    # The optimizer calls a table of unknown size endless.
    return df.coalesce(parts) if parts < 1 << 20 else df


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Parquet is read in batches of fewer rows in this block, where the session sets none: of whole texts, thousands take arrays
    so large that the collector grows the heap for them."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    told = spark._jsparkSession.sessionState().conf().contains(key)
    if not told:
        spark.conf.set(key, READ_ROWS)
    try:
        yield
    finally:
        if not told:
            spark.conf.unset(key)


_scopes = threading.local()


def open_scopes() -> list[list[DataFrame]]:
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    return _scopes.open


@contextmanager
def temporary() -> Iterator[list[DataFrame]]:
    """Tables that cut() makes in this block are removed when it ends, but for those that are put on the list it gives."""
    kept: list[DataFrame] = []
    open_scopes().append([])
    try:
        yield kept
    finally:
        made = open_scopes().pop()
        stay = {x._registra_path for x in kept}
        for x in made:
            if x._registra_path not in stay:
                discard(x)
            elif open_scopes():
                open_scopes()[-1].append(x)


def discard(df: DataFrame) -> None:
    """Remove a table made by cut() that no later plan reads."""
    path = getattr(df, "_registra_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def frozen(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, those that are missing as nulls, so that clashing extra columns cannot get in the way."""
    return df.select(*[df[n] if n in df.columns else F.lit(None).alias(n) for n in names])


def free(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` with a column (file, at) that tells its rows apart, and that column's name.

    Rows that come straight from files have a place that stays as it is: a hash of the file's path, and the row's number in the
    file. Others, and those of files whose rows have no number, are written by cut() with a number of their own.
    """
    (row,) = free(df, "_row")
    if df._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" and df.inputFiles() and "_metadata" not in df.columns:
        at = df.metadataColumn("_metadata")
        if "row_index" in df.select(at).schema[0].dataType.names:
            return df.select("*", F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("at")).alias(row)), row
    return cut(df.withColumn(row, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))), name), row


def times(df: DataFrame, row: str, marks: DataFrame) -> tuple[DataFrame, str]:
    """``df``, as numbered() gives it, with a column for the ``times`` that ``marks`` (row, times) has for a row, and that column's name.

    ``marks`` is a written table, has a row at most once, and few times of it; rows that it does not have get 0. The times reach
    the rows as bits, as many for each row of a block that has marks as the most times are, and are broadcast; so ``df``, whose
    rows are whole texts, is not shuffled. Where the blocks are too many for that, as of very many rows or files, it is.
    """
    block, bit, bits, told = free(df, "_block", "_bit", "_bits", "_times")
    place = lambda x: (F.struct(x["file"].alias("file"), F.shiftright(x["at"], BLOCK).alias("block")), x["at"].bitwiseAND((1 << BLOCK) - 1).cast("int"))
    of, at = place(marks["row"])
    placed = marks.select(of.alias(block), at.cast("long").alias(bit), "times")
    rows, blocks, most = placed.agg(F.count(F.lit(1)), F.countDistinct(block), F.coalesce(F.max("times"), F.lit(1))).first()
    if blocks * most << BLOCK - 3 > BITS_BYTES:
        marks = marks.select(F.col("row").alias(block), F.col("times").cast("int").alias(bits))
        out = df.join(marks, df[row] == marks[block], "left").withColumn(told, F.coalesce(bits, F.lit(0)))
    else:
        # All rows of a block meet before they become bits, so no part of a bitmap is shuffled.
        placed = placed.repartition(parts_for(rows, ROWS_A_FILE), block).groupBy(block)
        held = placed.agg(*[F.bitmap_construct_agg(F.when(F.col("times") > i, F.col(bit))).alias(f"{bits}{i}") for i in range(most)])
        of, at = place(df[row])
        out = df.join(F.broadcast(held), of == held[block], "left")
        byte = lambda i: F.conv(F.hex(F.substring(held[f"{bits}{i}"], F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
        one = [F.coalesce(F.getbit(byte(i), at.bitwiseAND(7)), F.lit(0)).cast("int") for i in range(most)]
        out = out.withColumn(told, sum(one[1:], one[0]))
    return out.select(*[df[c] for c in df.columns], told), told


def join_hot(df: DataFrame, found: DataFrame, key: str, rows: int, hot: int, how: str = "inner") -> DataFrame:
    """``df`` joined to ``found``, which has one row for each key and in ``_n`` how many of the ``rows`` rows of ``df`` have it.

    Keys that more than one in ``hot`` of all rows have, fewer than ``hot`` keys, are joined by broadcast, so the rows of a hot
    key never meet in one task; the rest are joined by a shuffle. Up to ``PLAIN`` rows are no burden to a task, whatever their
    keys, and are joined as they are. ``how`` is inner or left.
    """
    if rows <= PLAIN:
        return df.join(found.drop("_n"), key, how)
    least = rows // hot
    many, few = F.broadcast(found.where(F.col("_n") > least).drop("_n")), found.where(F.col("_n") <= least).drop("_n")
    return df.join(many, key).unionByName(df.join(many.select(key), key, "left_anti").join(few, key, how))


def join_first(df: DataFrame, key: str, payload: Column, order: Column, hot: int, rows: int | None = None) -> DataFrame:
    """The rows of ``df`` whose key has rows of at least two different ``order``, with ``first``: the smallest payload of the key,
    which must start with the fields of ``order``. Minima are aggregated before they are shuffled. ``rows``, where the caller
    knows how many ``df`` has, keeps the files of the minima few: each kept key has two rows at least."""
    firsts = df.groupBy(key).agg(F.min(payload).alias("first"), F.min(order).alias("_lo"), F.max(order).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    firsts = cut(firsts.where("_lo != _hi").drop("_lo", "_hi"), "firsts", None if rows is None else rows // 2)
    return join_hot(df, firsts, key, df.count() if rows is None else rows, hot)


def parts_for(rows: int, each: int, least: int = 1) -> int:
    """How many partitions keep each near `each` rows."""
    return max(least, -(-rows // each))


def u64(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)
