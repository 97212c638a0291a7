import json
import math
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from registra.llm import chat_format as C
from registra.llm import queries
from registra.llm import sharding as S

TURNS = "conv_id long, turns array<struct<role:string,text:string>>"
PIECES = ["<|im_start|>", "<|im_end|>\n", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "[\\INST]", "<\\\\/s>", "<", "[", "\n", "é", "😀", "a", "assistant", "\\n", "\r"]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.sampled_from(PIECES), max_size=4).map("".join), st.lists(st.sampled_from(PIECES), max_size=8).map("".join)), max_size=5), min_size=20, max_size=40))
def test_round_trip(spark, convs):
    convs = [*convs, [("assistant", "x</s>"), ("user", ""), ("assistant", "<|im_end|>\n")]]
    df = C.format_turns(spark.createDataFrame(list(enumerate(convs)), TURNS))
    for r in df.select("conv_id", C.read_back(F.col("formatted")).alias("t"), C.loss_text(F.col("formatted"), F.col("loss_mask")).alias("l"), F.length("formatted").alias("n"), "loss_mask").collect():
        assert [tuple(t) for t in r["t"]] == convs[r["conv_id"]]
        assert r["l"] == "".join(x for role, x in convs[r["conv_id"]] if role == "assistant")
        assert sum(sum(m) for m in r["loss_mask"]) == r["n"] and len(r["loss_mask"]) == len(convs[r["conv_id"]])


def test_layouts_meet(spark):
    want = [("user", "hi"), ("assistant", "yo")]
    frames = [
        spark.createDataFrame([(7, "hi", "yo", 3)], "id long, prompt string, response string, extra int"),
        spark.createDataFrame([(7, "hi", "yo")], "id long, instruction string, output string"),
        spark.createDataFrame([(7, [("user", "hi"), ("assistant", "yo")])], "id long, messages array<struct<role:string,content:string>>"),
        spark.createDataFrame([(7, [("human", "hi"), ("gpt", "yo")])], "id long, conversations array<struct<`from`:string,value:string>>"),
    ]
    for df in frames:
        assert [[tuple(t) for t in r["turns"]] for r in C.canonical(df, "id").collect()] == [want]
    with pytest.raises(ValueError, match="no mapping"):
        C.canonical(spark.createDataFrame([(1, 2)], "p int, q int"), "p")


def test_layouts_that_two_mappings_fit_are_refused(spark):
    wide = spark.createDataFrame([(1, "a", "b", "c")], "id long, prompt string, response string, completion string")
    with pytest.raises(ValueError, match="more than one mapping"):
        C.canonical(wide, "id")


def test_time_is_in_proportion_to_turns(spark):
    def seconds(n):
        rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("[INST] turn "), F.col("id").cast("string")).alias("text"))
        done = C.format_turns(C.canonical(rows))
        out = done.select(F.size(C.read_back(F.col("formatted"))).alias("n"), F.length(C.loss_text(F.col("formatted"), F.col("loss_mask"))).alias("l"))
        assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
        began = time.perf_counter()
        r = out.collect()[0]
        assert r["n"] == n and r["l"] == sum(len(f"[INST] turn {i}") for i in range(1, n, 2))
        return time.perf_counter() - began

    seconds(1_000)
    few, many = seconds(10_000), seconds(100_000)
    assert many < 10 * few + 10


def test_json_rows_choose_their_own_mapping(spark):
    rows = [
        {"prompt": "hi", "response": "yo"},
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]},
        {"instruction": "hi", "input": "", "output": "yo"},
        {"instruction": "hi", "input": "there", "output": "yo"},
        {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
        {"other": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)] + [(9, None), (10, "{")], "id long, j string")
    got = {r["id"]: (r["layout"], r["turns"] and [tuple(t) for t in r["turns"]]) for r in C.canonical_json(df, "id", "j").collect()}
    want = [("user", "hi"), ("assistant", "yo")]
    assert got[0] == ("prompt_response", want) and got[1] == ("messages", want) and got[2] == ("instruction", want) and got[4] == ("sharegpt", want)
    assert got[3] == ("instruction", [("user", "hi\nthere"), ("assistant", "yo")]) and got[5] == got[9] == got[10] == (None, None)


def test_turn_edges(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, None, None, 0), (1, None, "user", "first", 0), (None, 0, "user", "x", 0), (1, 1, "assistant", "b", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in C.canonical(df).collect()}
    assert got == {1: [("user", "first"), ("", ""), ("assistant", "b"), ("assistant", "b")], None: [("user", "x")]}
    assert C.canonical(df.limit(0)).collect() == []


def test_control_conversation(spark):
    r = queries.op3_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -1").collect()[0]
    assert r["n_turns"] == 2 and r["loss_chars"] == 21


def place(df, n, base=40):
    return {r["doc_id"]: r["s"] for r in df.select("doc_id", S.descend(F.col("doc_id"), S.build_tree(n, base)).alias("s")).collect()}


def test_tree_moves_rows_only_into_the_new_shard(spark):
    df = spark.range(20000).withColumnRenamed("id", "doc_id")
    for n in (40, 41, 44):
        before, after = place(df, n), place(df, n + 1)
        moved = {k for k in before if before[k] != after[k]}
        assert {after[k] for k in moved} == {n} and 0.5 < len(moved) * (n + 1) / 20000 < 1.6
    counts = [list(before.values()).count(s) for s in range(40)]
    assert min(counts) > 0.7 * 20000 / 44


def test_weight_change_stays_in_its_subtree(spark):
    df = spark.range(20000).withColumnRenamed("id", "doc_id")
    at = lambda w: {r[0]: r[1] for r in df.select("doc_id", S.descend(F.col("doc_id"), S.build_tree(8, 8, 2, 2, w))).collect()}
    before, after = at({}), at({0: 3.0})
    moved = [(before[k], after[k]) for k in before if before[k] != after[k]]
    # Region 0 holds shards 0 to 3: nothing moves between shards outside it.
    assert moved and all(b < 4 for _, b in moved) and sum(v == 0 for v in after.values()) > sum(v == 0 for v in before.values())


def test_sharding_query_against_brute_force(edge, empty, documents):
    for docs in (edge, documents):
        got, rows = S.shard_documents(docs).collect(), docs.collect()
        want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in rows)
        assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
        by = {}
        for r in got:
            assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40) and r["law"] == "key"
            by.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert S.shard_documents(empty).collect() == []


def hash64(i, name):
    """Spark's xxhash64 of a string and a long: each value seeds the next."""
    import xxhash

    h = xxhash.xxh64(name.encode(), 42).intdigest()
    return xxhash.xxh64(int(i).to_bytes(8, "little", signed=True), h).intdigest() if i is not None else h


def plain_descent(i, node):
    while node.children:
        node = min((c for c in node.children if c.weight > 0), key=lambda c: -math.log(((hash64(i, c.name) >> 11) + 1.0) / 2.0**53) / c.weight)
    return node.shard


def test_shard_by_a_plain_descent_of_the_tree(edge, documents):
    for docs in (edge, documents):
        for r in S.shard_documents(docs).collect():
            assert (r["shard"], r["grown_shard"]) == tuple(plain_descent(r["doc_id"], S.build_tree(n)) for n in (40, 41))
    tree = S.build_tree(11, 8, 2, 2, {1: 3.0, 4: 0.0})
    got = documents.select("doc_id", S.descend(F.col("doc_id"), tree).alias("s")).collect()
    assert all(r["s"] == plain_descent(r["doc_id"], tree) for r in got) and 4 not in {r["s"] for r in got}


def test_slots_are_gapless_over_many_buckets(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CAST(id % 3 AS INT) AS shard")
    got = S.slots(df, "shard", ["doc_id"], 3000, bucket_rows=100).collect()
    for s in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(1000))
