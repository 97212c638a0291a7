"""The registered queries of the register engine over the driver's tables, each with the SQL that another engine answers."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registra.operators import probe, reports
from registra.operators.joins import asof_join, dim_join
from registra.plans import counters, partitions
from registra.session import ship
from registra.sources import footers
from registra.sources.identity import guarded
from registra.sources.providers import Provider, csv_provider, default_registry
from registra.sources.request import ScanRequest
from registra.sources.zones import ZoneCatalog
from registra.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The register's columns on the driver's tables, in SQL that Spark and DuckDB read alike.
FACT = {
    "row_id": "l_orderkey * 8 + l_linenumber",
    "period_key": "CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS INTEGER)",
    "company_key": "CAST(l_suppkey AS INTEGER)",
    "account_key": "CAST(l_partkey AS INTEGER)",
    "account_key8": "4000000000 + l_partkey",
    "amount_dt": "CAST(l_quantity AS INTEGER)",
    "amount_kt": "l_linenumber",
    "debit_cents": "CAST(round(l_extendedprice * 100) AS BIGINT)",
    "credit_cents": "CAST(round(l_discount * 100) AS BIGINT)",
    "debit": "CAST(l_extendedprice AS DECIMAL(18,2))",
    "line_null": "nullif(l_linenumber, 3)",
    "dt_null": "CASE WHEN l_orderkey % 6 = 0 THEN NULL ELSE CAST(l_quantity AS INTEGER) END",
    "supp_null": "CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_suppkey END",
}
F_SQL = "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in FACT.items()) + " FROM lineitem) f"
PERIOD_SQL = "(SELECT CAST(i AS INTEGER) AS period_key, CAST(1995 + (i - 1) // 12 AS INTEGER) AS year FROM range(1, 121) t(i)) p"
#: A dimension with a NULL key, a NULL payload, and keys that some rows miss.
EDGE_ROWS = [(2, None), (4, 17), (None, 61), (6, 17), (7, -8), (11, 4)]
EDGE_SQL = "(VALUES (2, NULL), (4, 17), (NULL, 61), (6, 17), (7, -8), (11, 4)) e(k, payload)"
LO, HI = 25, 36


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month_start(period: int) -> datetime:
    return datetime(1995 + (period - 1) // 12, (period - 1) % 12 + 1, 1)


def fact(spark: SparkSession, sf_dir: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """The register's rows in a range of periods. The range is asked of the stored date, so that it reaches the scan; the key itself
    is an expression, which no file's statistics know. A period is a calendar month, so both say the same."""
    rows = load(spark, sf_dir, "lineitem")
    kind = rows.schema["l_shipdate"].dataType
    if lo is not None:
        rows = rows.where(F.col("l_shipdate") >= F.lit(month_start(lo).isoformat(" ")).cast(kind))
    if hi is not None:
        rows = rows.where(F.col("l_shipdate") < F.lit(month_start(hi + 1).isoformat(" ")).cast(kind))
    return rows.selectExpr(*[f"{e} AS {n}" for n, e in FACT.items()])


def dim_period(spark: SparkSession) -> DataFrame:
    return spark.range(1, 121).selectExpr("CAST(id AS INT) AS period_key", "CAST(1995 + (id - 1) DIV 12 AS INT) AS year")


def dim_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "supplier").selectExpr("CAST(s_suppkey AS INT) AS company_key", "s_nationkey AS company_group")


def dim_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").selectExpr("CAST(p_partkey AS INT) AS account_key", "4000000000 + p_partkey AS account_key8", "p_size AS account_group")


def edge_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGE_ROWS, "k int, payload int")


def scratch(spark: SparkSession) -> str:
    """A fresh folder on storage that executors share: beside the checkpoints, or under the warehouse where there are none."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/registra-{uuid.uuid4().hex}"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def plain(name: str, text: str, *tables: str) -> None:
    """A query that is SQL as it stands, in both engines."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text.format(**{t: "{" + t + "}" for t in tables}, f="{f}"), **({"f": fact(spark, sf_dir)} if "{f}" in text else {}), **{t: load(spark, sf_dir, t) for t in tables})

    QUERIES[name] = run
    SQL[name] = text.format(**{t: t for t in tables}, f=F_SQL)


RANGE = f"WHERE period_key BETWEEN {LO} AND {HI}"
JOIN2 = f"FROM {F_SQL} JOIN {PERIOD_SQL} USING (period_key) JOIN (SELECT CAST(p_partkey AS INTEGER) AS account_key, p_size AS account_group FROM part) a USING (account_key)"


@query(f"SELECT period_key, company_key, CAST(sum(amount_dt) AS BIGINT) AS total_amt FROM {F_SQL} {RANGE} GROUP BY ALL")
def groupby_sum(spark, sf_dir):
    return reports.group_sum(fact(spark, sf_dir, LO, HI), ["period_key", "company_key"], {"total_amt": "amount_dt"})


def by_period(spark):
    return (dim_period(spark), "period_key", "period_key", "year", "year")


def by_account(spark, sf_dir, key="account_key"):
    return (dim_account(spark, sf_dir), key, key, "account_group", "account_group")


@query(f"SELECT year, company_key, CAST(sum(amount_dt) AS BIGINT) AS total_amt FROM {F_SQL} JOIN {PERIOD_SQL} USING (period_key) {RANGE} GROUP BY ALL")
def join1_groupby(spark, sf_dir):
    return reports.join_report(fact(spark, sf_dir, LO, HI), [by_period(spark)], ["year", "company_key"], {"total_amt": "amount_dt"})


JOIN2_SQL = f"SELECT year, account_group, company_key, CAST(sum(amount_dt) AS BIGINT) AS total_amt {JOIN2} {{}} GROUP BY ALL"


def join2(spark, sf_dir, rows, lo=None, hi=None):
    return reports.join_report(rows, [by_period(spark), by_account(spark, sf_dir)], ["year", "account_group", "company_key"], {"total_amt": "amount_dt"}, ("period_key", lo, hi))


@query(JOIN2_SQL.format(RANGE))
def join2_groupby(spark, sf_dir):
    return join2(spark, sf_dir, fact(spark, sf_dir, LO, HI))


REGISTER_SQL = f"SELECT year, account_group, company_key, CAST(sum(amount_dt) AS BIGINT) AS debit, CAST(sum(amount_kt) AS BIGINT) AS credit, CAST(sum(amount_dt) - sum(amount_kt) AS BIGINT) AS net {JOIN2} WHERE period_key BETWEEN {{}} AND {{}} GROUP BY ALL"


def _register(name: str, lo: int, hi: int) -> None:
    def run(spark, sf_dir):
        return reports.register_report(fact(spark, sf_dir, lo, hi), [by_period(spark), by_account(spark, sf_dir)], ["year", "account_group", "company_key"], "amount_dt", "amount_kt")

    QUERIES[name], SQL[name] = run, REGISTER_SQL.format(lo, hi)


for _name, _lo, _hi in (("register_report", LO, HI), ("register_selectivity_narrow", 25, 25), ("register_selectivity_quarter", 25, 27), ("register_selectivity_half", 25, 30), ("register_selectivity_full", 1, 120), ("register_selectivity_empty", 500, 600)):
    _register(_name, _lo, _hi)


@query(f"SELECT company_group, account_group, period_key, CAST(sum(debit_cents) AS BIGINT) AS debit, CAST(sum(credit_cents) AS BIGINT) AS credit, CAST(sum(debit_cents) - sum(credit_cents) AS BIGINT) AS net FROM {F_SQL} JOIN (SELECT CAST(s_suppkey AS INTEGER) AS company_key, s_nationkey AS company_group FROM supplier) c USING (company_key) JOIN (SELECT 4000000000 + p_partkey AS account_key8, p_size AS account_group FROM part) a USING (account_key8) {RANGE} GROUP BY ALL")
def register_report_int8(spark, sf_dir):
    company = (dim_company(spark, sf_dir), "company_key", "company_key", "company_group", "company_group")
    return reports.register_report(fact(spark, sf_dir, LO, HI), [company, by_account(spark, sf_dir, "account_key8")], ["company_group", "account_group", "period_key"], "debit_cents", "credit_cents")


def _typed(name: str, keys: list[str], sums: list[str], kinds: list[str], edge: bool = False, rendered: bool = False) -> None:
    def run(spark, sf_dir):
        dim = (edge_dim(spark), "amount_kt", "k", "payload", "payload") if edge else None
        return reports.typed_report(fact(spark, sf_dir), keys, sums, dim, rendered)

    own = ["payload", *keys] if edge else keys
    shown = [" || '|' || ".join(f"coalesce(CAST({k} AS VARCHAR), '\\N')" for k in own) + " AS gkey"] if rendered else own
    totals = [f"CAST(sum({c}) AS {k}) AS sum_{c}" for c, k in zip(sums, kinds, strict=True)]
    joined = f"{F_SQL} JOIN {EDGE_SQL} ON amount_kt = k" if edge else F_SQL
    QUERIES[name], SQL[name] = run, f"SELECT {', '.join([*shown, 'CAST(count(*) AS BIGINT) AS nrows', *totals])} FROM {joined} GROUP BY {', '.join(own)}"


_typed("typed_two_keys", ["company_key", "amount_kt"], ["amount_dt"], ["BIGINT"])
_typed("typed_null_keys", ["line_null", "supp_null"], ["dt_null"], ["BIGINT"])
_typed("typed_int8_exact", ["company_key"], ["account_key8"], ["DECIMAL(29,0)"])
_typed("typed_numeric", ["line_null"], ["debit"], ["DECIMAL(28,2)"])
_typed("typed_mixed_sums", ["line_null", "company_key"], ["dt_null", "account_key8", "debit"], ["BIGINT", "DECIMAL(29,0)", "DECIMAL(28,2)"])
_typed("typed_no_sums", ["line_null"], [], [])
_typed("typed_join_null", ["line_null"], ["dt_null"], ["BIGINT"], edge=True)
_typed("typed_join_null_payload", [], ["amount_dt"], ["BIGINT"], edge=True)
_typed("typed_rendered", ["line_null", "amount_kt"], ["amount_dt"], ["BIGINT"], rendered=True)

PROBED = ["line_null", "account_key8", "debit", "dt_null"]
_KINDS = ["int", "bigint", "decimal(18,2)", "int"]


@query(" UNION ALL ".join(f"SELECT row_id AS rownum, {i + 1} AS col, '{k}' AS coltype, {c} IS NULL AS is_null, CAST({c} AS VARCHAR) AS val FROM {F_SQL}" for i, (c, k) in enumerate(zip(PROBED, _KINDS, strict=True))))
def probe_cells(spark, sf_dir):
    return probe.probe_cells(fact(spark, sf_dir), PROBED, "row_id")


TOTALS_SQL = "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(sum({1}) AS DECIMAL(38,0)) AS sum_last, CAST(min({1}) AS BIGINT) AS min_last, CAST(max({1}) AS BIGINT) AS max_last, CAST(count(*) - count({1}) AS BIGINT) AS nulls_last, CAST(sum({0}) FILTER (WHERE {1} IS NULL) AS DECIMAL(38,0)) AS sum_first_null FROM {2}"


@query(TOTALS_SQL.format("period_key", "dt_null", f"{F_SQL} {RANGE}"))
def scan_totals(spark, sf_dir):
    return footers.scan_totals(fact(spark, sf_dir, LO, HI), "period_key", "dt_null")


@query(f"SELECT period_key, CAST(sum(t) AS BIGINT) AS total FROM (SELECT period_key, company_key, sum(amount_dt) AS t FROM {F_SQL} GROUP BY ALL) x GROUP BY ALL")
def rollup_3stage(spark, sf_dir):
    return reports.rollup_chain(fact(spark, sf_dir), ["period_key", "company_key", "account_key"], "amount_dt")


@query(f"SELECT company_key, CAST(sum(amount_kt - 4) AS BIGINT) AS total FROM {F_SQL} GROUP BY ALL HAVING sum(amount_kt - 4) <> 0")
def rollup_3stage_nonzero(spark, sf_dir):
    rows = fact(spark, sf_dir).withColumn("balance", F.col("amount_kt") - 4)
    return reports.rollup_chain(rows, ["company_key", "period_key", "account_key"], "balance", keep_zero=False)


@query(f"SELECT CAST(i AS INTEGER) AS period_key, CAST(coalesce(sum(amount_dt), 0) AS BIGINT) AS total FROM range(70, 101) t(i) LEFT JOIN {F_SQL} ON period_key = i GROUP BY ALL")
def period_totals_calendar(spark, sf_dir):
    return reports.calendar_totals(fact(spark, sf_dir), "period_key", "amount_dt", 70, 100)


@query(f"SELECT year, count_all AS n_rows, matched FROM (SELECT year, CAST(count(*) AS BIGINT) AS count_all, CAST(count(k) AS BIGINT) AS matched FROM {F_SQL} JOIN {PERIOD_SQL} USING (period_key) LEFT JOIN {EDGE_SQL} ON amount_kt = k GROUP BY year) x")
def dim_miss_rate(spark, sf_dir):
    rows = fact(spark, sf_dir)
    joined = rows.join(F.broadcast(dim_period(spark)), "period_key").join(F.broadcast(edge_dim(spark)), F.col("amount_kt") == F.col("k"), "left")
    return joined.groupBy("year").agg(F.count(F.lit(1)).alias("n_rows"), F.count("k").alias("matched"))


@query(f"SELECT first_status, CAST(count(*) AS BIGINT) AS nrows, CAST(sum(amount_dt) AS BIGINT) AS total FROM (SELECT l_suppkey, CAST(l_quantity AS INTEGER) AS amount_dt FROM lineitem) f JOIN (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS first_status FROM orders GROUP BY o_custkey) d ON f.l_suppkey = d.o_custkey GROUP BY ALL")
def dim_first_wins(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").selectExpr("l_suppkey", "CAST(l_quantity AS INT) AS amount_dt")
    joined = dim_join(rows, load(spark, sf_dir, "orders"), "l_suppkey", "o_custkey", "o_orderstatus", "first_status", policy="first", order_by="o_orderkey")
    return joined.groupBy("first_status").agg(F.count(F.lit(1)).alias("nrows"), F.sum("amount_dt").alias("total"))


# Plain SQL: what the planner would have to admit, and what it must not get wrong.
for _op, _sym in (("lt", "<"), ("le", "<="), ("eq", "="), ("ge", ">="), ("gt", ">")):
    plain(f"count_pred_{_op}", f"SELECT CAST(count(*) AS BIGINT) AS n FROM {{f}} WHERE period_key {_sym} 30")
plain("count_all", "SELECT CAST(count(*) AS BIGINT) AS n FROM {lineitem}", "lineitem")
plain("sum_pred", "SELECT CAST(sum(amount_dt) AS BIGINT) AS total FROM {f} WHERE account_key8 > 4000000500")
plain("sum_multi_pred", "SELECT CAST(sum(amount_dt) AS BIGINT) AS total FROM {f} WHERE period_key >= 10 AND period_key < 60 AND company_key <= 50 AND 5 < amount_dt AND account_key > 3 AND amount_kt <> 2 AND debit_cents > 1000 AND credit_cents >= 0 AND account_key8 > 4000000001")
plain("sum_residual_text", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS total FROM {lineitem} WHERE l_linenumber >= 2 AND (l_returnflag LIKE 'A%' OR l_linestatus IS NULL)", "lineitem")
plain("sum_empty", "SELECT CAST(sum(amount_dt) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n FROM {f} WHERE period_key > 5000")
plain("null_key_sum", "SELECT line_null, CAST(sum(dt_null) AS BIGINT) AS total FROM {f} GROUP BY line_null")
plain("group_having", "SELECT company_key, CAST(sum(amount_dt) AS BIGINT) AS total FROM {f} GROUP BY company_key HAVING sum(amount_dt) > 10000")
plain("group_count", "SELECT period_key, company_key, CAST(count(*) AS BIGINT) AS n FROM {f} GROUP BY period_key, company_key")
plain("group_single_key", "SELECT account_key, CAST(sum(amount_kt) AS BIGINT) AS total FROM {f} GROUP BY account_key")
plain("group_date_pred", "SELECT l_linenumber, CAST(count(*) AS BIGINT) AS n FROM {lineitem} WHERE CAST(l_shipdate AS DATE) >= DATE '1997-06-01' GROUP BY l_linenumber", "lineitem")
plain("group_timestamp_pred", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM {events} WHERE ts < TIMESTAMP '2024-01-08 00:00:00' GROUP BY event_type", "events")
plain("group_ordered_input", "SELECT CAST(floor(event_id / 100) AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS n, CAST(sum(user_id) AS BIGINT) AS total FROM {events} WHERE event_id <= 5000 GROUP BY CAST(floor(event_id / 100) AS BIGINT)", "events")
plain("group_ordered_whole", "SELECT CAST(floor(event_id / 100) AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS n, CAST(sum(user_id) AS BIGINT) AS total FROM {events} GROUP BY CAST(floor(event_id / 100) AS BIGINT)", "events")
plain("group_card_low", "SELECT period_key, CAST(sum(amount_dt) AS BIGINT) AS total FROM {f} GROUP BY period_key")
plain("group_card_mid", "SELECT account_key, period_key, CAST(sum(amount_dt) AS BIGINT) AS total FROM {f} GROUP BY account_key, period_key")
plain("group_card_high", "SELECT company_key, account_key, period_key, CAST(sum(amount_dt) AS BIGINT) AS total FROM {f} GROUP BY company_key, account_key, period_key")
plain("sum_distinct", "SELECT company_key, CAST(sum(DISTINCT amount_dt) AS BIGINT) AS total, CAST(count(DISTINCT account_key) AS BIGINT) AS accounts FROM {f} GROUP BY company_key")
plain("sum_filter", "SELECT company_key, CAST(sum(amount_dt) FILTER (WHERE amount_kt = 1) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE dt_null IS NULL) AS BIGINT) AS n FROM {f} GROUP BY company_key")
plain("host_grouping_sets", "SELECT company_key, amount_kt, CAST(sum(amount_dt) AS BIGINT) AS total FROM {f} GROUP BY GROUPING SETS ((company_key), (amount_kt), ())")
plain("host_window", "SELECT row_id, CAST(sum(amount_dt) OVER (PARTITION BY company_key ORDER BY row_id, account_key, period_key, amount_dt ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS moving FROM {f}")
plain("host_set_operations", "SELECT company_key FROM {f} WHERE period_key < 30 INTERSECT SELECT company_key FROM {f} WHERE period_key > 50 EXCEPT SELECT company_key FROM {f} WHERE amount_dt = 1 AND amount_kt = 7")
plain("host_semi_anti", "SELECT CAST(count(*) AS BIGINT) AS n FROM {orders} WHERE EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey) AND o_custkey NOT IN (SELECT c_custkey FROM {customer} WHERE c_nationkey = 3)", "orders", "lineitem", "customer")
plain("host_topk", "SELECT account_key, CAST(sum(amount_dt) AS BIGINT) AS total FROM {f} GROUP BY account_key ORDER BY total DESC, account_key LIMIT 20")
plain("host_statistics", "SELECT company_key, min(amount_dt) AS lo, max(amount_dt) AS hi, CAST(sum(amount_dt) AS DOUBLE) / count(*) AS mean FROM {f} GROUP BY company_key")


# Zones, partitions and pruned files: written once for a session and a folder of tables, then read by every call. A zone's
# source is compared with what the zone was built from at each of them.
_PREPARED: dict[tuple, str] = {}


def prepared(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], None]) -> str:
    """The folder that ``build`` has filled."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _PREPARED:
        root = scratch(spark)
        build(root)
        _PREPARED[key] = root
    return _PREPARED[key]


def forget() -> None:
    """Let every prepared folder be built anew."""
    _PREPARED.clear()


ZONE_COLUMNS = ["period_key", "company_key", "account_key", "amount_dt", "amount_kt"]


def store(spark: SparkSession, sf_dir: str, root: str) -> str:
    """The fact as Parquet, sorted by period, in many small row groups."""
    path = f"{root}/fact"
    df = fact(spark, sf_dir).select(*ZONE_COLUMNS, "dt_null").repartitionByRange(4, "period_key").sortWithinPartitions("period_key")
    df.write.option("parquet.block.size", 64 << 10).parquet(path)
    return path


def stored(spark: SparkSession, sf_dir: str) -> str:
    return prepared(spark, sf_dir, "fact", lambda root: store(spark, sf_dir, root)) + "/fact"


def zoned(spark: SparkSession, sf_dir: str, lo: int | None = LO, hi: int | None = HI) -> tuple[str, ZoneCatalog]:
    """The stored fact and a catalog with one zone of it."""
    table = stored(spark, sf_dir)
    root = prepared(spark, sf_dir, f"zone {lo}..{hi}", lambda root: ZoneCatalog(spark, root).build(table, ZONE_COLUMNS, lo, hi))
    return table, ZoneCatalog(spark, root)


def zone_rows(spark: SparkSession, sf_dir: str, lo: int | None, hi: int | None, zone: tuple[int | None, int | None] = (LO, HI)) -> DataFrame:
    table, catalog = zoned(spark, sf_dir, *zone)
    return default_registry(catalog).scan(spark, "zone", ScanRequest(table, tuple(ZONE_COLUMNS), "period_key", lo, hi))


@query(SQL["groupby_sum"])
def zone_groupby(spark, sf_dir):
    return reports.group_sum(zone_rows(spark, sf_dir, LO, HI), ["period_key", "company_key"], {"total_amt": "amount_dt"})


@query(SQL["join2_groupby"])
def zone_join2(spark, sf_dir):
    return join2(spark, sf_dir, zone_rows(spark, sf_dir, LO, HI))


@query(JOIN2_SQL.format("WHERE period_key BETWEEN 28 AND 30"))
def zone_subrange(spark, sf_dir):
    return join2(spark, sf_dir, zone_rows(spark, sf_dir, 28, 30))


@query(JOIN2_SQL.format(f"{RANGE} AND amount_kt < 3"))
def zone_extra_pred(spark, sf_dir):
    return join2(spark, sf_dir, zone_rows(spark, sf_dir, LO, HI).where("amount_kt < 3"))


@query(JOIN2_SQL.format("WHERE period_key >= 28"))
def zone_one_sided(spark, sf_dir):
    """A zone without an upper bound serves a request without one."""
    return join2(spark, sf_dir, zone_rows(spark, sf_dir, 28, None, (LO, None)))


PARTS = [(1, 12), (13, 24), (25, 36), (37, 120)]


def partitioned(spark: SparkSession, sf_dir: str, zone_of: tuple[int, ...]) -> tuple[list[partitions.Partition], ZoneCatalog]:
    """The fact in partitions by period, some of them with a zone that holds all of their rows."""

    def build(root: str) -> None:
        for i, (lo, hi) in enumerate(PARTS):
            fact(spark, sf_dir, lo, hi).select(*ZONE_COLUMNS).write.parquet(f"{root}/child{i}")
            if i in zone_of:
                ZoneCatalog(spark, f"{root}/zones").build(f"{root}/child{i}", ZONE_COLUMNS, lo, hi)

    root = prepared(spark, sf_dir, f"parts {zone_of}", build)
    return [partitions.Partition(f"{root}/child{i}", lo, hi) for i, (lo, hi) in enumerate(PARTS)], ZoneCatalog(spark, f"{root}/zones")


def _partitioned(name: str, zone_of: tuple[int, ...], lo: int | None, hi: int | None, where: str) -> None:
    def run(spark, sf_dir):
        children, catalog = partitioned(spark, sf_dir, zone_of)
        return join2(spark, sf_dir, partitions.union_partitions(spark, children, ScanRequest("", tuple(ZONE_COLUMNS), "period_key", lo, hi), catalog))

    QUERIES[name], SQL[name] = run, JOIN2_SQL.format(f"WHERE {where}")


for _name, _zoned in (("partition_join2_mixed", (1,)), ("partition_join2_cold", (1, 2)), ("partition_join2_hot", ())):
    _partitioned(_name, _zoned, 13, 36, "period_key BETWEEN 13 AND 36")
_partitioned("partition_one_sided", (1,), 20, None, "period_key BETWEEN 20 AND 120")
_partitioned("partition_one_sided_below", (1,), None, 20, "period_key BETWEEN 1 AND 20")


@query(SQL["join2_groupby"])
def partition_pruned(spark, sf_dir):
    """Hive-style partitions: the range reaches the partition filters, so other partitions are not listed as input."""

    def build(root: str) -> None:
        rows = fact(spark, sf_dir).select(*ZONE_COLUMNS).withColumn("y", F.expr("CAST(1995 + (period_key - 1) DIV 12 AS INT)"))
        rows.repartition("y").write.partitionBy("y").parquet(f"{root}/by_year")

    path = prepared(spark, sf_dir, "by year", build) + "/by_year"
    return join2(spark, sf_dir, spark.read.parquet(path).where(f"y BETWEEN {1995 + (LO - 1) // 12} AND {1995 + (HI - 1) // 12}"), LO, HI)


@query(TOTALS_SQL.format("period_key", "amount_dt", f"{F_SQL} WHERE period_key BETWEEN 40 AND 42"))
def parquet_pruned(spark, sf_dir):
    request = ScanRequest(stored(spark, sf_dir), ("period_key", "amount_dt"), None, 40, 42)
    return footers.scan_totals(default_registry().scan(spark, "parquet", request), "period_key", "amount_dt")


@query(f"SELECT company_key, CAST(count(*) AS BIGINT) AS n, CAST(sum(v) AS BIGINT) AS total FROM (SELECT company_key, CASE WHEN company_key % 4 = 0 THEN NULL ELSE amount_dt END AS v FROM {F_SQL}) x GROUP BY ALL")
def parquet_all_null_group(spark, sf_dir):
    path = prepared(spark, sf_dir, "nulls", lambda root: fact(spark, sf_dir).selectExpr("company_key", "CASE WHEN company_key % 4 = 0 THEN NULL ELSE amount_dt END AS v").write.parquet(f"{root}/nulls")) + "/nulls"
    rows = default_registry().scan(spark, f"ext:parquet:{path}", ScanRequest("", ("company_key", "v")))
    return rows.groupBy("company_key").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query(SQL["groupby_sum"])
def columnar_groupby(spark, sf_dir):
    path = prepared(spark, sf_dir, "orc", lambda root: fact(spark, sf_dir).select(*ZONE_COLUMNS).write.orc(f"{root}/orc")) + "/orc"
    rows = default_registry().scan(spark, "columnar", ScanRequest(path, ("period_key", "company_key", "amount_dt"), None, LO, HI))
    return reports.group_sum(rows, ["period_key", "company_key"], {"total_amt": "amount_dt"})


@query(SQL["groupby_sum"])
def csv_groupby(spark, sf_dir):
    path = prepared(spark, sf_dir, "csv", lambda root: fact(spark, sf_dir).select(*ZONE_COLUMNS).write.option("header", True).csv(f"{root}/csv")) + "/csv"
    registry = default_registry()
    registry.register(csv_provider(", ".join(f"{c} int" for c in ZONE_COLUMNS)))
    rows = registry.scan(spark, "csv", ScanRequest(path, ("period_key", "company_key", "amount_dt"), None, LO, HI))
    return reports.group_sum(rows, ["period_key", "company_key"], {"total_amt": "amount_dt"})


@query(SQL["count_all"])
def count_from_footers(spark, sf_dir):
    return footers.footer_count(spark, f"{sf_dir}/lineitem.parquet")


@query(SQL["groupby_sum"])
def guarded_groupby(spark, sf_dir):
    """The groups are taken only if no input has changed meanwhile."""
    rows = groupby_sum(spark, sf_dir)
    return spark.createDataFrame(guarded(rows, lambda d: d.collect()), rows.schema)


@query("SELECT window_start, event_type, n, total FROM (SELECT date_trunc('day', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(user_id) AS BIGINT) AS total FROM events GROUP BY ALL) x")
def event_windows(spark, sf_dir):
    return windows.windowed_sums(load(spark, sf_dir, "events"), "ts", "event_type", "user_id", "1 day")


@query("SELECT event_type, CAST(sum(user_id) AS BIGINT) AS total FROM events GROUP BY ALL")
def stream_totals(spark, sf_dir):
    root, rows = scratch(spark), load(spark, sf_dir, "events").select("event_type", "user_id")
    rows.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    windows.keep_totals(stream, f"{root}/out", f"{root}/state", ["event_type"], "user_id").awaitTermination()
    return windows.read_totals(spark, f"{root}/out", ["event_type"])


@query("SELECT date_trunc('day', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(user_id) AS BIGINT) AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """The same windows from a stream with a watermark, all of them as they stand at its end."""
    root, rows = scratch(spark), load(spark, sf_dir, "events").select("ts", "event_type", "user_id").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(f"{root}/in")
    stream = windows.windowed_sums(spark.readStream.schema(rows.schema).parquet(f"{root}/in"), "ts", "event_type", "user_id", "1 day")
    windows.keep_windows(stream, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# What engines say in their own words: Spark's text, then DuckDB's.
def twin(name: str, mine: str, theirs: str, *tables: str) -> None:
    plain(name, mine, *tables)
    SQL[name] = theirs.format(**{t: t for t in tables}, f=F_SQL)


plain("host_union_distinct", "SELECT company_key, amount_kt FROM {f} WHERE period_key < 30 UNION SELECT amount_dt, amount_kt FROM {f} WHERE period_key > 50")
plain("host_except_all", "SELECT company_key, amount_kt FROM {f} WHERE period_key < 40 EXCEPT ALL SELECT company_key, amount_kt FROM {f} WHERE period_key >= 40")
plain("host_intersect_all", "SELECT amount_dt, amount_kt FROM {f} WHERE period_key < 40 INTERSECT ALL SELECT amount_dt, amount_kt FROM {f} WHERE period_key >= 40")
plain("host_full_join", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM {customer} WHERE c_nationkey < 12) c FULL JOIN (SELECT * FROM {orders} WHERE o_orderstatus <> 'O') o ON o_custkey = c_custkey", "customer", "orders")
plain("host_right_join", "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n FROM {orders} RIGHT JOIN {customer} ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey", "customer", "orders")
plain("host_range_join", "SELECT name, CAST(count(*) AS BIGINT) AS n, CAST(sum(amount_dt) AS BIGINT) AS total FROM {f} JOIN (VALUES ('early', 1, 30), ('middle', 20, 50), ('late', 51, 200)) b(name, a, z) ON period_key BETWEEN a AND z GROUP BY name")
plain("host_rollup", "SELECT company_key, amount_kt, CAST(sum(amount_dt) AS BIGINT) AS total, CAST(grouping(amount_kt) AS INTEGER) AS g FROM {f} GROUP BY ROLLUP (company_key, amount_kt)")
plain("host_cube", "SELECT amount_kt, line_null, CAST(sum(amount_dt) AS BIGINT) AS total, CAST(grouping(amount_kt) + 2 * grouping(line_null) AS INTEGER) AS g FROM {f} GROUP BY CUBE (amount_kt, line_null)")
plain("host_cte", "WITH t AS (SELECT company_key, sum(amount_dt) AS s FROM {f} GROUP BY company_key), m AS (SELECT max(s) AS top FROM t) SELECT company_key, CAST(s AS BIGINT) AS s FROM t WHERE 2 * s > (SELECT top FROM m)")
plain("host_correlated", "SELECT CAST(count(*) AS BIGINT) AS n FROM {orders} o WHERE o_totalprice > (SELECT avg(o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)", "orders")
plain("host_rank_windows", "SELECT company_key, period_key, total, CAST(rank() OVER (PARTITION BY company_key ORDER BY total DESC) AS BIGINT) AS place, lag(total) OVER (PARTITION BY company_key ORDER BY period_key) AS before FROM (SELECT company_key, period_key, CAST(sum(amount_dt) AS BIGINT) AS total FROM {f} GROUP BY company_key, period_key) t")
plain("host_ordered_output", "SELECT period_key, company_key, CAST(sum(amount_dt) AS BIGINT) AS total FROM {f} GROUP BY period_key, company_key ORDER BY period_key, company_key")
plain("residual_text_count", "SELECT CAST(count(*) AS BIGINT) AS n FROM {lineitem} WHERE l_returnflag = 'R'", "lineitem")
plain("residual_other_column", "SELECT CAST(sum(amount_dt) AS BIGINT) AS total FROM {f} WHERE period_key < 30")
plain("residual_beside_pushed", "SELECT l_linenumber, CAST(count(*) AS BIGINT) AS n FROM {lineitem} WHERE l_orderkey <= 5000 AND l_linestatus = 'O' GROUP BY l_linenumber", "lineitem")
_ROUND = "SELECT company_key, round({0}, 6) AS deviation, round({1}, 6) AS variance, {2} AS median, {3} AS p90 FROM {{f}} GROUP BY company_key"
twin("host_deviation_percentile", _ROUND.format("stddev_samp(amount_dt)", "var_pop(amount_dt)", "percentile(amount_dt, 0.5)", "percentile_disc(0.9) WITHIN GROUP (ORDER BY amount_dt)").replace(", percentile_disc", ", CAST(percentile_disc").replace("amount_dt) AS p90", "amount_dt) AS INT) AS p90"), _ROUND.format("stddev_samp(amount_dt)", "var_pop(amount_dt)", "quantile_cont(amount_dt, 0.5)", "quantile_disc(amount_dt, 0.9)"))
plain("host_approximate_distinct", "SELECT company_key, abs(approx_count_distinct(account_key) - count(DISTINCT account_key)) <= 0.25 * count(DISTINCT account_key) + 2 AS near FROM {f} GROUP BY company_key")
plain("host_text_functions", "SELECT c_custkey, upper(substring(c_name, 1, 5)) AS head, length(c_mktsegment) AS n, replace(c_mktsegment, 'A', '_') AS swapped, concat(c_mktsegment, '/', c_name) AS both_names, lpad(CAST(c_nationkey AS VARCHAR(9)), 4, '0') AS padded, trim(concat('  ', c_mktsegment, ' ')) AS trimmed FROM {customer}", "customer")
twin("host_array_functions", "SELECT company_key, array_join(sort_array(collect_set(amount_kt)), ',') AS lines, size(collect_set(amount_kt)) AS n, array_max(collect_set(amount_dt)) AS top FROM {f} GROUP BY company_key", "SELECT company_key, array_to_string(list_sort(list_distinct(list(amount_kt))), ',') AS lines, CAST(len(list_distinct(list(amount_kt))) AS INTEGER) AS n, list_max(list(amount_dt)) AS top FROM {f} GROUP BY company_key")
twin("host_map_functions", "SELECT c_custkey, element_at(m, 'nation') AS nation, map_contains_key(m, 'segment') AS has_segment FROM (SELECT c_custkey, map('nation', c_nationkey, 'key', CAST(c_custkey AS INT)) AS m FROM {customer}) t", "SELECT c_custkey, m['nation'] AS nation, map_contains(m, 'segment') AS has_segment FROM (SELECT c_custkey, map {{'nation': c_nationkey, 'key': CAST(c_custkey AS INTEGER)}} AS m FROM {customer}) t", "customer")
twin("host_json_functions", "SELECT k, CAST(get_json_object(j, '$.n') AS INT) AS n, get_json_object(j, '$.a[1]') AS second FROM (SELECT c_custkey AS k, to_json(named_struct('n', c_nationkey, 'a', array(1L, c_custkey))) AS j FROM {customer}) t", "SELECT k, CAST(json_extract_string(j, '$.n') AS INTEGER) AS n, json_extract_string(j, '$.a[1]') AS second FROM (SELECT c_custkey AS k, json_object('n', c_nationkey, 'a', [1, c_custkey]) AS j FROM {customer}) t", "customer")


@query("SELECT row_id, o_orderkey FROM (SELECT l_orderkey * 8 + l_linenumber AS row_id, l_suppkey, l_shipdate FROM lineitem) f ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderdate) o ON f.l_suppkey = o.o_custkey AND f.l_shipdate >= o.o_orderdate")
def asof_latest_order(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 8 + l_linenumber AS row_id", "l_suppkey", "l_shipdate")
    orders = load(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    return asof_join(rows, orders, "l_suppkey", "o_custkey", "l_shipdate", "o_orderdate", ["o_orderkey"]).select("row_id", "o_orderkey")


# What engines keep to themselves: told by constants and counts.
@query(f"SELECT 'period_key' AS key, CAST(1 AS BIGINT) AS lo, CAST(12 AS BIGINT) AS hi, CAST(count(*) AS BIGINT) AS rows, 'STALE' AS state FROM {F_SQL} WHERE period_key BETWEEN 1 AND 12 UNION ALL SELECT 'period_key', {LO}, {HI}, count(*), 'VALID' FROM {F_SQL} {RANGE}")
def zone_info(spark, sf_dir):
    root = scratch(spark)
    table, catalog = stored(spark, sf_dir), ZoneCatalog(spark, f"{root}/zones")
    for lo, hi in ((1, 12), (LO, HI), (37, 48)):
        catalog.build(table, ZONE_COLUMNS, lo, hi)
    catalog.invalidate(table, 1, 12)
    catalog.drop(table, 37, 48)
    return catalog.info().select("key", "lo", "hi", "rows", "state")


@query("SELECT * FROM (VALUES ('columnar', FALSE, CAST(1 AS INTEGER)), ('parquet', FALSE, 1), ('table', FALSE, 1), ('zone', TRUE, 1)) p(name, filters_rows, abi)")
def providers(spark, sf_dir):
    return default_registry(ZoneCatalog(spark, scratch(spark))).listing(spark).select("name", "filters_rows", "abi")


_RULES = ["rows", "projection", "empty_range", "rescan", "unknown_column", "repeated_column"]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{r}', '{'SKIP' if (p, r) == ('zone', 'empty_range') else 'PASS'}')" for p in ("parquet", "zone", "unfiltered") for r in _RULES) + ") c(provider, \"check\", status)")
def conformance(spark, sf_dir):
    table, catalog = zoned(spark, sf_dir)
    registry = default_registry(catalog)
    registry.register(Provider("unfiltered", lambda s, r: s.read.parquet(r.source), "skips nothing"))
    request = ScanRequest(table, ("period_key", "company_key", "amount_dt"), "period_key", LO, HI)
    expected = spark.read.parquet(table).where(F.col("period_key").between(LO, HI))
    frames = [probe.conformance(spark, registry, m, request, expected).select(F.lit(m).alias("provider"), "check", "status") for m in ("parquet", "zone", "unfiltered")]
    return frames[0].union(frames[1]).union(frames[2])


_COLUMNS = [("l_orderkey", "INT64"), ("l_partkey", "INT64"), ("l_suppkey", "INT64"), ("l_linenumber", "INT32"), ("l_quantity", "DOUBLE"), ("l_extendedprice", "DOUBLE"), ("l_discount", "DOUBLE"), ("l_tax", "DOUBLE"), ("l_returnflag", "BINARY"), ("l_linestatus", "BINARY"), ("l_shipdate", "INT64")]


@query("SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS INTEGER), '{n}', '{k}', TRUE)" for i, (n, k) in enumerate(_COLUMNS)) + ") c(col, name, type, stored)")
def parquet_columns(spark, sf_dir):
    return footers.parquet_columns(spark, f"{sf_dir}/lineitem.parquet").select("col", "name", "type", (F.col("compressed_bytes") > 0).alias("stored"))


@query("SELECT TRUE AS some_skipped, TRUE AS some_read")
def parquet_row_groups(spark, sf_dir):
    total, read = footers.row_groups(spark, stored(spark, sf_dir), "period_key", 40, 42)
    return spark.createDataFrame([(total > read, read > 0)], "some_skipped boolean, some_read boolean")


@query(f"SELECT CAST(count(*) AS BIGINT) AS rows_out, TRUE AS files_read, TRUE AS bytes_read FROM {F_SQL} {RANGE}")
def scan_counters(spark, sf_dir):
    """What the scan of a pruned file has read, told by the plan once it has run."""
    rows = default_registry().scan(spark, "parquet", ScanRequest(stored(spark, sf_dir), ("period_key",), None, LO, HI)).agg(F.count(F.lit(1)).alias("n"))
    n, seen = rows.collect()[0]["n"], counters.scan_metrics(rows)
    return spark.createDataFrame([(n, seen["files"] > 0, seen["bytes"] > 0)], "rows_out long, files_read boolean, bytes_read boolean")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return join2_groupby(spark, sf_dir)
