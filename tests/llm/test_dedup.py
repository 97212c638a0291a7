import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from registra.llm import common
from registra.llm import exact_dedup as E
from registra.llm import line_dedup as L
from registra.llm.common import LOWER, UPPER

FOLD = str.maketrans(UPPER, LOWER)


def brute(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(FOLD), []).append(i)
    out = []
    for i, t in rows:
        own = groups[(t or "").translate(FOLD)]
        known = [x for x in own if x is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        out.append((i, best, len(own), i == best, hashlib.sha256((t or "").translate(FOLD).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_edges(edge, empty, keep):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert sorted(map(tuple, E.exact_dedup(edge, keep).collect()), key=str) == brute(rows, keep)
    assert E.exact_dedup(empty, keep).collect() == []


def test_many_runs_and_levels(spark):
    rng = random.Random(1)
    rows = [(i, f"text {rng.randrange(300)}" if rng.random() < 0.7 else "Hot") for i in range(2500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    got = E.exact_dedup(df, "smallest", memtable_rows=16, fan_in=3)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, "smallest")


def test_collisions_are_verified(spark):
    rows = [(i, f"text {i % 7}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weak = F.unhex(F.sha2(F.substring("_text", 1, 5).cast("binary"), 256))  # the same digest for all
    assert sorted(map(tuple, E.exact_dedup(df, digest=weak).collect()), key=str) == brute(rows, "smallest")


def test_temporary_tables_go_and_kept_ones_stay(spark):
    there = lambda df: spark._jvm.org.apache.hadoop.fs.Path(df._registra_path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(df._registra_path))
    with common.temporary() as outer:
        with common.temporary() as inner:
            a, b, c = (common.cut(spark.range(3), n) for n in "abc")
            inner += [a, b]
        assert there(a) and there(b) and not there(c)
        outer.append(a)
    assert there(a) and not there(b) and a.count() == 3 and common.open_scopes() == []


def test_filter_never_misses():
    import numpy as np

    rows = np.frombuffer(b"".join(hashlib.sha256(bytes([i])).digest() for i in range(200)), np.uint8).reshape(-1, 32)
    kept = E.Bloom.from_bytes(E.Bloom.of(rows[:100]).to_bytes())
    assert kept.may_hold(rows[:100]).all() and kept.may_hold(rows[100:]).sum() < 10


def brute_lines(rows, chars):
    first, wins = {}, []
    for i, text in rows:
        lines = [x.strip(" \t\r\f\v") for x in (text or "").split("\n") if x.strip(" \t\r\f\v")]
        for s in range(len(lines)):
            for e in range(s, len(lines)):
                held = sum(map(len, lines[s : e + 1]))
                if held >= chars and (held - len(lines[e]) < chars or held - len(lines[s]) < chars):
                    wins.append((i, s, tuple(lines[s : e + 1])))
    for i, at, key in wins:
        first[key] = min(first.get(key, (i, at)), (i, at))
    gone = {(i, at + k) for i, at, key in wins if (i, at) > first[key] for k in range(len(key))}
    out = []
    for i, text in rows:
        if text is None:
            out.append((i, None))
            continue
        kept, at = [], 0
        for x in text.split("\n"):
            if x.strip(" \t\r\f\v"):
                if (i, at) not in gone:
                    kept.append(x)
                at += 1
            else:
                kept.append(x)
        out.append((i, "\n".join(kept)))
    return sorted(out, key=lambda x: x[0])


@pytest.mark.parametrize("chars", [1, 6, 15, 40])
@pytest.mark.parametrize("hot", [1_000, 4])
def test_lines_against_brute_force(spark, monkeypatch, chars, hot):
    monkeypatch.setattr(L, "HOT", hot)
    monkeypatch.setattr(common, "PLAIN", 200_000 if hot == 1_000 else 0)
    rng = random.Random(chars)
    pool = [f"{i} " + "w" * (3 * i % 17) for i in range(12)] + ["", "  ", "a", "b", "a"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(14)))) for i in range(150)] + [(200, None), (201, "")]
    got = L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), chars)
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == brute_lines(rows, chars)


def test_few_lines_are_selected_from_windows_of_several(spark):
    """A fingerprint goes out for fewer lines than there are windows, and a window that the earliest occurrence does not hold is still found."""
    rng = random.Random(5)
    text = "\n".join(f"{rng.randrange(10**4):04d}" for _ in range(2_000))
    docs = spark.createDataFrame([(1, text, 7)], "doc_id long, text string, tid long")
    assert L.fingerprints(docs, 40).count() < 2_000 * 0.3
    rows = [(i, t) for i, t in enumerate(["aaaa\nbbbb", "aaaa\ncccc", "aaaa\ncccc\nz", "cccc\naaaa", "x\ncccc\naaaa", "y\nbbbb\naaaa\ncccc"])]
    got = L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 8)
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == brute_lines(rows, 8)


def test_very_long_document_of_short_lines(spark):
    text = "\n".join(str(i) for i in range(60_000))
    rows = [(1, text), (2, "own\n" + text)]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (60_000, 0), 2: (60_001, 60_000)}


def test_line_edges(edge, empty):
    got = L.line_dedup(edge).collect()
    assert len(got) == edge.count() and L.line_dedup(empty).collect() == []
    by = {r["doc_id"]: r for r in got if r["doc_id"] not in (None, 2)}
    assert by[4]["text"] is None and by[4]["n_lines"] == 0 and by[3]["text"] == "" and by[5]["n_dropped"] == 0
    assert by[7]["n_dropped"] == 1 and by[6]["n_dropped"] == 0


@pytest.mark.parametrize("build", [16 << 20, 0])
def test_hashed_and_sorted_spans_drop_the_same(spark, monkeypatch, build):
    """Texts are sorted for the last join only if the spans might not fit in memory."""
    monkeypatch.setattr(L, "BUILD_BYTES", build)
    rng = random.Random(9)
    pool = [f"{i} " + "w" * (7 * i % 45) for i in range(12)]
    rows = [(i % 90, "\n".join(rng.choice(pool) for _ in range(rng.randrange(9)))) for i in range(90)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert ("ShuffledHashJoin" in plan) == bool(build)
        assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == brute_lines(rows, L.CHARS)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tables_of_many_partitions_are_written_to_few_files(spark, tmp_path):
    """Each file starts child processes, and each of them has the executor's memory a second time while it starts."""
    from registra.llm.queries import QUERIES

    lines = [f"line {i} is a window of its own, for it is long" for i in range(40)]
    rows = [(i, "\n".join(lines[i % 40 : i % 40 + 3] + ["short", f"own {i}"])) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(60).write.parquet(f"{tmp_path}/documents.parquet")
    told = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in told}
    shared, spread = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")) / "registra", common.SPREAD_BYTES
    old = {*shared.glob("*")}
    try:
        for k, v in told.items():
            spark.conf.set(k, v)
        common.SPREAD_BYTES = 0
        QUERIES["op2_line_dedup"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    finally:
        common.SPREAD_BYTES = spread
        for k, v in before.items():
            spark.conf.set(k, v)
    files = {p.name: len([*p.glob("*.parquet")]) for p in [*({*shared.glob("*")} - old), tmp_path / "out"]}
    assert len(files) == 5 and max(files.values()) <= 16, files
    assert spark.read.parquet(f"{tmp_path}/out").count() == 400


def test_rows_that_share_an_id_lose_only_their_own_lines(spark):
    a, b = "this line of ten words or more is a window alone", "another line of ten words or more stands in one text"
    rows = [(None, f"{a}\nfirst"), (None, f"start\n{b}"), (5, f"{b}\nfive"), (5, f"other\n{a}"), (5, f"other\n{a}"), (6, "six\nsix")]
    got = sorted((str(r["doc_id"]), r["text"], r["n_dropped"]) for r in L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("5", "five", 1), ("5", "other", 1), ("5", "other", 1), ("6", "six\nsix", 0), ("None", f"{a}\nfirst", 0), ("None", f"start\n{b}", 0)])


def test_long_passage_leaves_later_documents(spark):
    passage = "\n".join(" ".join(f"w{i}{j}" for j in range(9)) for i in range(7))
    rows = [(i, f"own {i} first words\n{passage}\nown {i} last words") for i in range(50)]
    got = {r["doc_id"]: r["text"] for r in L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"own {i} first words\nown {i} last words" for i in range(1, 50))


def test_single_line_query_leaves_no_repeat(spark, tmp_path):
    from registra.llm.queries import QUERIES

    short = "Licensed under the Apache License, Version 2.0."
    rows = [(i, f"own {i}\n{short}\n\nlast {i}") for i in range(30)] + [(40, "}\nx\n }"), (41, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_dropped"], r["text_sha256"]) for r in QUERIES["op2_line_dedup_single"](spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {0: (0, sha(rows[0][1])), **{i: (1, sha(f"own {i}\n\nlast {i}")) for i in range(1, 30)}, 40: (1, sha("}\nx")), 41: (0, sha(""))}
