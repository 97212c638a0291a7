"""NULLs, overflow, refusals, zones that must not serve, and what plans look like."""

import json
import time
from dataclasses import asdict

import pytest
from pyspark.sql import types as T

from registra.functions.types import UnsupportedTypeError, schema_fingerprint
from registra.operators import reports
from registra import queries as engine
from registra.operators.joins import asof_join, dim_join
from registra.plans.counters import RunReport, plan_facts, scan_metrics
from registra.plans.partitions import Partition, route, union_partitions
from registra.plans.predicates import classify_predicates
from registra.sources import footers
from registra.sources.identity import SourceChangedError, fingerprint, guarded, snapshot
from registra.sources.providers import Provider, Registry, csv_provider, default_registry, s3a_settings
from registra.sources.request import RequestError, ScanRequest, contains, meets
from registra.sources.zones import NOT_FOUND, STALE, ZoneCatalog, ZoneError


@pytest.fixture
def groups(spark):
    rows = [(1, 10, 5, 7), (1, 10, None, 8), (None, 10, 3, 9), (None, 10, 4, None), (2, None, None, None), (2, None, None, None)]
    return spark.createDataFrame(rows, "g1 int, g2 long, s1 int, s2 long")


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 4000).selectExpr("CAST(id % 40 AS INT) AS k", "id AS v").repartition(1).sortWithinPartitions("k").write.option("parquet.block.size", 4096).parquet(path)
    return path


def test_null_groups_and_sums(groups):
    rows = {tuple(r) for r in reports.typed_report(groups, ["g1", "g2"], ["s1", "s2"]).collect()}
    assert rows == {(1, 10, 2, 5, 15), (None, 10, 2, 7, 9), (2, None, 2, None, None)}
    assert {r["gkey"] for r in reports.typed_report(groups, ["g1", "g2"], rendered=True).collect()} == {"1|10", "\\N|10", "2|\\N"}


def test_null_join(spark):
    dim = spark.createDataFrame([(None, 31), (8, None), (4, 17), (5, 17)], "k int, payload int")
    fact = spark.createDataFrame([(4, 2), (None, 64), (5, 4), (8, 8), (6, 32), (4, 16), (None, 128)], "jk int, s int")
    rows = {tuple(r) for r in reports.typed_report(fact, [], ["s"], (dim, "jk", "k", "payload", "payload")).collect()}
    assert rows == {(17, 3, 22), (None, 1, 8)}


def test_duplicate_dimension_keys(spark):
    dim = spark.createDataFrame([(1, 5, 2), (1, 6, 1)], "k int, p int, o int")
    fact = spark.createDataFrame([(1,)], "f int")
    assert dim_join(fact, dim, "f", "k", "p", "p").count() == 2
    assert dim_join(fact, dim, "f", "k", "p", "p", "first", "o").collect()[0]["p"] == 6
    with pytest.raises(RequestError, match="order_by"):
        dim_join(fact, dim, "f", "k", "p", "p", "first")


def test_overflow_raises_and_exact_does_not(spark):
    big = spark.createDataFrame([(1, 2**63 - 1), (1, 2**63 - 1)], "g int, v long")
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        reports.group_sum(big, ["g"], {"t": "v"}).collect()
    assert int(reports.typed_report(big, ["g"], ["v"]).collect()[0]["sum_v"]) == 2**64 - 2


def test_refusals(spark, table):
    registry = default_registry()
    scan = lambda mode="parquet", **c: registry.scan(spark, mode, ScanRequest(**{"source": table, "columns": ("k", "v")} | c))
    for bad in ({"columns": ("k", "k")}, {"columns": ("nope",)}, {"lo": 2**40, "hi": 2**41}, {"mode": "ext:parquet"}, {"mode": "none"}):
        with pytest.raises(RequestError):
            scan(**bad)
    with pytest.raises(UnsupportedTypeError, match="column x has unsupported type double"):
        ScanRequest("", ("x",)).validate(T.StructType([T.StructField("x", T.DoubleType())]))
    with pytest.raises(RequestError):
        registry.register(Provider("table", lambda s, r: None))
    with pytest.raises(RequestError):
        Registry().register(Provider("new", lambda s, r: None, abi=9))
    with pytest.raises(RequestError):
        s3a_settings("http://x", "a", "b", attempts=9)


def test_range_reaches_the_scan_and_groups_are_skipped(spark, table):
    df = default_registry().scan(spark, "parquet", ScanRequest(table, ("k",), None, 3, 4))
    facts = plan_facts(df)
    assert any("GreaterThanOrEqual(k,3)" in p for p in facts["pushed"]) and facts["read_schema"][0].startswith("struct<k:int>")
    total, read = footers.row_groups(spark, table, "k", 3, 4)
    assert 0 < read < total and footers.row_groups(spark, table, "k", 900, 901)[1] == 0
    assert df.count() == 200


def test_report_is_broadcast_joins_and_one_shuffle(spark, table):
    dim = spark.range(40).selectExpr("CAST(id AS INT) AS k", "CAST(id % 3 AS INT) AS p")
    df = reports.join_report(spark.read.parquet(table), [(dim, "k", "k", "p", "p")], ["p"], {"t": "v"}, ("k", 1, 30))
    df.collect()
    facts = plan_facts(df)
    assert facts["broadcast_joins"] >= 1 and len(df.collect()) == 3


def test_zone_serves_only_what_it_holds(spark, table, tmp_path):
    zones = ZoneCatalog(spark, str(tmp_path / "z"))
    zones.build(table, ["k", "v"], 5, 9)
    ask = lambda lo, hi, *c: ScanRequest(table, c or ("k", "v"), "k", lo, hi)
    assert zones.scan(ask(6, 7)).count() == 200
    for lo, hi in ((4, 7), (8, 12)):
        with pytest.raises(ZoneError):
            zones.scan(ask(lo, hi))
    assert zones.invalidate(table, 5, 9) == STALE and zones.lookup(ask(6, 7)) is None
    assert zones.invalidate(table, 1, 2) == NOT_FOUND
    zones.build(table, ["k", "v"], 5, 9)
    assert zones.lookup(ask(6, 7))
    time.sleep(1.1)
    spark.range(3).selectExpr("CAST(id AS INT) AS k", "id AS v").write.mode("append").parquet(table)
    assert zones.lookup(ask(6, 7)) is None and zones.info().collect()[0]["state"] == STALE
    zones.drop(table, 5, 9)
    zones.drop(table, 5, 9)
    assert not zones.info().count()


def test_empty_zone_keeps_types(spark, table, tmp_path):
    m = ZoneCatalog(spark, str(tmp_path / "z")).build(table, ["k", "v"], 500, 600)
    assert m.rows == 0 and dict(spark.read.parquet(m.path).dtypes) == {"k": "int", "v": "bigint"}


def test_partitions_take_zones_that_cover_them(spark, table, tmp_path):
    zones = ZoneCatalog(spark, str(tmp_path / "z"))
    zones.build(table, ["k", "v"], 0, 39)
    other = str(tmp_path / "o")
    spark.createDataFrame([(None, 1), (50, 2)], "k int, v long").write.parquet(other)
    zones.build(other, ["k", "v"], 0, 99)  # its NULL key is in no zone, so the zone does not stand for the child
    assert [p == c for c, p in route(spark, [table, other], ["k"], zones)] == [False, True]
    assert union_partitions(spark, [table, other], ScanRequest("", ("k", "v"), "k", 39, 60), zones).count() == 101


def test_changed_source_is_refused(spark, table):
    df = spark.read.parquet(table)
    seen = snapshot(spark, [table])

    def replace(d):
        n = d.count()
        spark.range(1).selectExpr("CAST(id AS INT) AS k", "id AS v").write.mode("overwrite").parquet(table)
        return n

    assert guarded(df, lambda d: d.count()) == 4000
    with pytest.raises(SourceChangedError):
        guarded(df, replace, {**seen})


def test_predicates_and_counters(spark, table):
    df = spark.read.parquet(table)
    found = classify_predicates(["k < 5", "3 >= k", "v LIKE 'x'", "k + 1 = 2"], df.schema)
    assert found.pushed == (("k", "<", "5"), ("k", "<=", "3")) and len(found.residual) == 2
    report = RunReport("r")
    assert report.run(report.at(df.where("k < 2"), "filtered"), lambda d: len(d.collect())) == 200
    assert report.rows() == {"filtered": 200} and report.seconds > 0
    assert schema_fingerprint(df.schema) != schema_fingerprint(df.select("v", "k").schema)


def test_calendar_and_zero_totals(spark):
    df = spark.createDataFrame([(1, 5), (1, -5), (3, 2)], "p int, v int")
    assert {tuple(r) for r in reports.calendar_totals(df, "p", "v", 1, 4).collect()} == {(1, 0), (2, 0), (3, 2), (4, 0)}
    assert [tuple(r) for r in reports.rollup_chain(df, ["p", "v"], "v", keep_zero=False).collect()] == [(3, 2)]


def test_stream_batches_count_once(spark, tmp_path):
    from registra.streaming import windows

    spark.range(100).selectExpr("id % 3 AS g", "id AS v").repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("g long, v long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):
        windows.keep_totals(stream, str(tmp_path / "out"), str(tmp_path / "state"), ["g"], "v").awaitTermination()
    assert {r["g"]: r["total"] for r in windows.read_totals(spark, str(tmp_path / "out"), ["g"]).collect()} == {g: sum(range(g, 100, 3)) for g in range(3)}


def test_one_sided_ranges(spark, table, tmp_path):
    zones = ZoneCatalog(spark, str(tmp_path / "z"))
    zones.build(table, ["k", "v"], 5, 20)
    zones.build(table, ["k", "v"], 30, None)
    ask = lambda lo, hi: ScanRequest(table, ("k", "v"), "k", lo, hi)
    assert zones.scan(ask(33, None)).count() == 700 and zones.scan(ask(30, 31)).count() == 200
    for lo, hi in ((5, None), (None, 20), (29, None), (None, None)):
        with pytest.raises(ZoneError):
            zones.scan(ask(lo, hi))
    zones.build(table, ["k", "v"], None, None)
    assert zones.scan(ask(None, None)).count() == 4000 and zones.scan(ask(None, 4)).count() == 500
    other = str(tmp_path / "o")
    spark.createDataFrame([(None, 1), (50, 2), (60, 3)], "k int, v long").write.parquet(other)
    for lo, hi, n in ((5, None, 3502), (None, 5, 600), (39, 55, 101), (None, None, 4003), (55, None, 1)):
        for parts in ([table, other], [Partition(table, 0, 39), Partition(other, 50, None)]):
            # Only a request without a range keeps rows without a key.
            assert union_partitions(spark, parts, ask(lo, hi), zones).count() == n
            assert default_registry().scan(spark, "table", ScanRequest(spark.read.parquet(table).union(spark.read.parquet(other)), ("k", "v"), "k", lo, hi)).count() == n


def test_ranges_hold_and_meet():
    span = (None, 3, 5)
    inside = lambda x, lo, hi: (lo is None or x >= lo) and (hi is None or x <= hi)
    for a in span:
        for b in span:
            for c in span:
                for d in span:
                    if None not in (a, b) and a > b or None not in (c, d) and c > d:
                        continue
                    own, other = ({x for x in range(-1, 10) if inside(x, *r)} for r in ((a, b), (c, d)))
                    assert contains(a, b, c, d) == (other <= own) and meets(a, b, c, d) == bool(own & other)


def test_partitions_out_of_range_are_not_read(spark, table, tmp_path):
    other = str(tmp_path / "gone")
    spark.range(2).selectExpr("CAST(id + 50 AS INT) AS k", "id AS v").write.parquet(other)
    df = union_partitions(spark, [Partition(table, 0, 39), Partition(other, 50, 60)], ScanRequest("", ("k", "v"), "k", 10, 20))
    assert df.count() == 1100 and all("/gone/" not in f for f in df.inputFiles())
    assert union_partitions(spark, [Partition(table, 0, 39)], ScanRequest("", ("k", "v"), "k", 90, 99)).count() == 0


def test_period_range_reaches_the_scan(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("join2_groupby", "register_report", "register_selectivity_empty", "register_report_int8", "groupby_sum"):
        df = engine.QUERIES[name](spark, sf)
        assert any("GreaterThanOrEqual(l_shipdate" in p and "LessThan(l_shipdate" in p for p in plan_facts(df)["pushed"]), name
    df = engine.QUERIES["register_selectivity_empty"](spark, sf)
    assert df.collect() == [] and scan_metrics(df)["rows"] == 0
    for lo, hi in ((None, 0), (0, None), (12, 13), (None, None), (120, 120)):
        where = " AND ".join(x for x in (f"period_key >= {lo}" * (lo is not None), f"period_key <= {hi}" * (hi is not None)) if x) or "true"
        assert engine.fact(spark, sf, lo, hi).count() == engine.fact(spark, sf).where(where).count()


def test_zones_of_other_columns_and_keys_stand_side_by_side(spark, table, tmp_path):
    zones = ZoneCatalog(spark, str(tmp_path / "z"))
    zones.build(table, ["k"], 5, 9)
    ask = lambda *c, key="k": ScanRequest(table, c, key, 6, 7)
    with pytest.raises(ZoneError):
        zones.scan(ask("k", "v"))
    zones.build(table, ["k", "v"], 5, 9)
    zones.build(table, ["v"], 5, 9, key="v")
    assert zones.scan(ask("k")).count() == zones.scan(ask("k", "v")).count() == 200 and zones.scan(ask("v", key="v")).count() == 2
    assert zones.info().count() == 3
    zones.drop(table, 5, 9)
    assert zones.info().count() == 0


def test_zone_is_swapped_whole_under_readers(spark, table, tmp_path):
    """While a zone is built again and again, readers find one that is whole, and plans made before can still finish."""
    import threading

    zones, seen, stop = ZoneCatalog(spark, str(tmp_path / "z")), [], threading.Event()
    zones.build(table, ["k", "v"], 5, 9)
    before = zones.scan(ScanRequest(table, ("k", "v"), "k", 5, 9))

    def read():
        while not stop.is_set():
            try:
                seen.append(zones.scan(ScanRequest(table, ("k", "v"), "k", 5, 9)).count())
            except Exception as e:  # noqa: BLE001
                seen.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for _ in range(5):
        zones.build(table, ["k", "v"], 5, 9)
    stop.set()
    reader.join()
    assert seen and {*seen} == {500} and before.count() == 500
    assert zones.vacuum() == 0 and zones.vacuum(older_than=-5) == 5 and zones.scan(ScanRequest(table, ("k",), "k", 5, 5)).count() == 100


def test_manifest_is_there_and_whole_while_it_is_replaced(spark, table, tmp_path):
    """Also where a manifest of before has a checksum file beside it, as local file systems write."""
    import threading

    zones, seen, stop = ZoneCatalog(spark, str(tmp_path / "z")), [], threading.Event()
    m = zones.build(table, ["k", "v"], 5, 9)
    fs, at = zones._fs(zones._place(m))
    old = fs.create(at, True)
    old.write(bytearray(json.dumps(asdict(m)).encode()))
    old.close()
    assert fs.exists(fs.getChecksumFile(at))

    def read():
        while not stop.is_set():
            try:
                seen.append(len(zones._all()))
            except Exception as e:  # noqa: BLE001
                seen.append(repr(e))

    readers = [threading.Thread(target=read) for _ in range(3)]
    for r in readers:
        r.start()
    for i in range(300):
        m.rows = i
        zones._write(m)
    stop.set()
    for r in readers:
        r.join()
    assert seen and {*seen} == {1} and zones._all()[0].rows == 299
    assert [p.name for p in (tmp_path / "z").iterdir() if p.is_file()] == [at.getName()]


def test_fingerprint_is_one_row(spark, table, tmp_path):
    first = fingerprint(spark, table)
    assert first[0] >= 1 and first == fingerprint(spark, table) and snapshot(spark, [table]) == {table: first}
    spark.range(1).selectExpr("CAST(id AS INT) AS k", "id AS v").write.mode("append").parquet(table)
    assert fingerprint(spark, table)[0] > first[0]
    with pytest.raises(SourceChangedError):
        fingerprint(spark, str(tmp_path / "none"))


def test_counts_come_from_footers(spark, table):
    df = footers.footer_count(spark, table)
    assert "PushedAggregation: [COUNT(*)]" in df._jdf.queryExecution().executedPlan().toString() and df.collect()[0]["n"] == 4000


def test_csv_is_read_by_its_schema(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.createDataFrame([(1, "a"), (None, "b,c"), (3, None)], "k int, t string").write.option("header", True).csv(path)
    registry = default_registry()
    registry.register(csv_provider("k int, t string"))
    rows = lambda **c: sorted(map(tuple, registry.scan(spark, "csv", ScanRequest(path, ("t", "k"), **c)).collect()), key=str)
    assert rows() == sorted([("a", 1), ("b,c", None), (None, 3)], key=str) and rows(key="k", lo=2) == [(None, 3)]


def test_asof_join_against_brute_force(spark):
    import random

    rng = random.Random(3)
    left = [(i, rng.choice([None, 1, 2, 3]), rng.choice([None, *range(12)])) for i in range(120)]
    right = [(k, t, rng.choice([None, 10 * k + t])) for k in (1, 2, 4) for t in rng.sample(range(12), 5)] + [(None, 3, 7), (1, None, 8)]
    df = asof_join(spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "k int, t int, p int"), "k", "k", "t", "t", ["p"])

    def latest(k, t):
        fit = [(u, p) for j, u, p in right if None not in (k, t, j, u) and j == k and u <= t]
        return max(fit, key=lambda x: x[0])[1] if fit else None

    assert df.columns == ["id", "k", "t", "p"]
    assert {r["id"]: r["p"] for r in df.collect()} == {i: latest(k, t) for i, k, t in left}


def test_late_rows_are_dropped_on_a_stream(spark, tmp_path):
    from registra.streaming import windows

    for i, stamps in enumerate((["2024-01-01 00:10", "2024-01-01 05:00"], ["2024-01-01 00:20", "2024-01-01 05:10"], ["2024-01-01 09:00"], ["2024-01-01 09:01"])):
        rows = spark.createDataFrame([(t, "a", 1) for t in stamps], "ts string, g string, v int").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "g", "v")
        rows.coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    import shutil

    folder = tmp_path / "in"
    folder.mkdir()
    stream = windows.windowed_sums(spark.readStream.schema("ts timestamp, g string, v int").parquet(str(folder)), "ts", "g", "v")
    run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    for i in range(4):
        for f in (tmp_path / f"in{i}").glob("*.parquet"):
            shutil.copy(f, folder / f"{i}.parquet")
        run.trigger(availableNow=True).start().awaitTermination()
    got = {str(r["window_start"])[:16]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # The row of 00:20 came after the watermark had passed 04:50; the last window is still open.
    assert got == {"2024-01-01 00:00": 1, "2024-01-01 05:00": 2}
