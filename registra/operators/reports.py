"""The report family: range, dimension joins, group by, sums. All of it is one declarative plan with one shuffle, that of
partially aggregated groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registra.functions.sums import checked_sum, exact_sum, key_text
from registra.functions.types import MEASURES, check_types
from registra.operators.joins import dim_join
from registra.sources.request import in_range


def group_sum(df: DataFrame, keys: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """GROUP BY keys with SUM(source) AS name for each of ``sums``; ANSI arithmetic raises on overflow."""
    check_types(df.schema, list(sums.values()), MEASURES)
    return df.groupBy(*keys).agg(*[checked_sum(c).alias(n) for n, c in sums.items()])


def join_report(fact: DataFrame, dims: Sequence[tuple], keys: Sequence[str], sums: dict[str, str], range_on: tuple | None = None) -> DataFrame:
    """Range, then one dim_join for each of ``dims`` (dim, fact_key, dim_key, payload, alias), then group_sum."""
    df = in_range(fact, *range_on) if range_on else fact
    for dim, *how in dims:
        df = dim_join(df, dim, *how)
    return group_sum(df, keys, sums)


def register_report(fact: DataFrame, dims: Sequence[tuple], keys: Sequence[str], debit: str, credit: str, range_on: tuple | None = None) -> DataFrame:
    """join_report with two sums and net = debit - credit, in one pass; net overflows with an error, as the sums do."""
    out = join_report(fact, dims, keys, {"debit": debit, "credit": credit}, range_on)
    return out.withColumn("net", F.col("debit") - F.col("credit"))


def typed_report(fact: DataFrame, group_cols: Sequence[str], sum_cols: Sequence[str] = (), dim: tuple | None = None, rendered: bool = False) -> DataFrame:
    """COUNT(*) and exact sums by nullable keys; a dimension's payload, if any, is the first key. NULL is a group of its own,
    SUM skips NULL, and a sum over nothing but NULL is NULL."""
    df, keys = fact, list(group_cols)
    if dim:
        df, keys = dim_join(fact, *dim), [dim[4], *keys]
    check_types(df.schema, list(sum_cols), MEASURES)
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("nrows"), *[exact_sum(c, df.schema[c].dataType).alias(f"sum_{c}") for c in sum_cols])
    return out.select(key_text(keys).alias("gkey"), "nrows", *[f"sum_{c}" for c in sum_cols]) if rendered else out


def rollup_chain(df: DataFrame, keys: Sequence[str], measure: str, keep_zero: bool = True) -> DataFrame:
    """Sums by all keys, then by one key fewer at a time, down to the first. Without ``keep_zero`` totals of 0 are left out."""
    out = group_sum(df, keys, {"total": measure})
    for k in range(len(keys) - 1, 0, -1):
        out = out.groupBy(*keys[:k]).agg(F.sum("total").alias("total"))
    return out if keep_zero else out.where("total != 0")


def calendar_totals(df: DataFrame, key: str, measure: str, lo: int, hi: int) -> DataFrame:
    """The total of every period of the range, 0 where there are no rows."""
    calendar = df.sparkSession.range(lo, hi + 1).select(F.col("id").cast(df.schema[key].dataType).alias(key))
    totals = group_sum(in_range(df, key, lo, hi), [key], {"total": measure})
    return calendar.join(totals, key, "left").select(key, F.coalesce("total", F.lit(0)).cast("long").alias("total"))
