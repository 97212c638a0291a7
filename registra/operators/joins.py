"""Dimension joins: inner, on one equal column, broadcast when the dimension is known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from registra.sources.request import RequestError

#: A dimension whose estimated size is at most this is broadcast; a larger or unknown one is shuffled, and AQE may still decide otherwise.
BROADCAST_BYTES = 32 << 20


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if estimated_bytes(df) <= BROADCAST_BYTES else df


def asof_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_time: str, right_time: str, payload: list[str]) -> DataFrame:
    """``left`` with the payload of the latest row of ``right`` of the same key that is not later, NULLs where there is none.

    Both sides go through one shuffle by key and one sort, whatever their sizes; nothing is paired. ``right`` has one row for a
    key and time; a row with a NULL key or time matches nothing.
    """
    taken = {c.lower() for c in (*left.columns, *payload)}
    key, time, side, held, own = (next(f"{'_' * i}{n}" for i in range(1, 99) if f"{'_' * i}{n}" not in taken) for n in ("key", "time", "side", "held", "own"))
    open_ended = left[left_key].isNull() | left[left_time].isNull()
    rows = left.where(~open_ended).select(F.col(left_key).alias(key), F.col(left_time).alias(time), F.lit(1).alias(side), F.struct(*left.columns).alias(own), F.lit(None).cast(right.select(F.struct(*payload)).schema[0].dataType).alias(held))
    facts = right.where(F.col(right_key).isNotNull() & F.col(right_time).isNotNull()).select(F.col(right_key).alias(key), F.col(right_time).alias(time), F.lit(0).alias(side), F.lit(None).cast(rows.schema[own].dataType).alias(own), F.struct(*payload).alias(held))
    # On equal times the right side comes first.
    upto = Window.partitionBy(key).orderBy(time, side).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.unionByName(facts).withColumn(held, F.last(held, ignorenulls=True).over(upto)).where(F.col(side) == 1)
    out = found.select(f"{own}.*", *[F.col(f"{held}.{c}").alias(c) for c in payload])
    # Rows without a key or time match nothing and are kept out of the shuffle, where they would meet in one task.
    return out.union(left.where(open_ended).select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in payload]))


def dim_join(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, payload: str, alias: str, policy: str = "all", order_by: str | None = None) -> DataFrame:
    """``fact`` with the payload as ``alias``. NULL keys match nothing, NULL payloads are kept. With duplicate keys every match
    counts, as in SQL; policy "first" takes the payload that is first by ``order_by``."""
    for frame, name in ((fact, fact_key), (dim, dim_key), (dim, payload)):
        if name not in frame.columns:
            raise RequestError(f"unknown column: {name}")
    if policy == "first":
        if not order_by:
            raise RequestError("policy first needs order_by: rows have no order of their own")
        dim = dim.groupBy(dim_key).agg(F.min_by(F.struct(payload), order_by)[payload].alias(payload))
    elif policy != "all":
        raise RequestError(f"unknown policy: {policy}")
    side = dim.select(F.col(dim_key).alias("_key"), F.col(payload).alias(alias)).where("_key is not null")
    return fact.join(small(side), F.col(fact_key) == F.col("_key")).drop("_key")
