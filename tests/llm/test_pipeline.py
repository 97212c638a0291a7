"""Every stage against brute force on what the stage before has kept."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from registra.llm import decontam as D
from registra.llm import langid, mixing
from registra.llm.common import cut
from tests.llm.test_join_and_search import brute, brute_hits

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10_001, "1234 5678 !!", None, "src0", 12), (10_002, None, "en", None, 0), (10_003, "\u4e2d\u6587\u5b57 \u6c49\u5b57 \u5341\u4e09", None, "src0", 9)], docs.schema)
    docs, steps = docs.unionByName(extra), dict(P.STAGES)
    keep = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    known = steps["language_id"](spark, docs, SF)
    told = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.language_id(docs).collect()}
    assert keep(known).keys() == {k for k, (lang, score) in told.items() if lang != "und" and score >= langid.NOISE / langid.DIMENSION**0.5}
    assert not {10_001, 10_002, 10_003} & {*keep(known)} and known.count() > 0.98 * docs.count()

    single = steps["near_duplicates"](spark, known, SF)
    assert {str(k) for k in keep(single)} == {i for i, _, c in brute(list(keep(known).items())) if i == c}

    clean = steps["decontamination"](spark, single, SF)
    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    patterns = D.patterns_of(bench, 10)
    assert keep(clean).keys() == {k for k, t in keep(single).items() if not brute_hits(D.words_of(t), patterns)[0]}

    mixed = steps["mixing"](spark, clean, SF)
    assert mixed.columns == docs.columns and {*keep(mixed)} <= {*keep(clean)}
    copies, times = {r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect()}, {}
    for r in mixed.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert times == {k: n for k, n in copies.items() if n}

    final = steps["sharding"](spark, mixed, SF)
    assert final.count() == mixed.count()
    by = {}
    for r in final.collect():
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_stages_on_edges(spark, edge, empty):
    """Clashing names, repeated and missing ids: a row decides only about itself in stages that judge texts."""
    clash = {c: F.lit(i) for i, c in enumerate(("_id", "_copies", "_copy", "_b", "_r", "_o", "slot", "cls", "component_id", "lang_pred", "contaminated", "_k"))}
    bad = next(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r["text"].split()) > 12)
    more = [(None, bad, "en", "a", 1), (9, bad, "en", "a", 1), (11, "11 11", "en", "a", 5), (11, "eleven is a word too", "en", "a", 20)]
    docs = edge.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True).withColumns(clash)
    steps, texts = dict(P.STAGES), lambda df: sorted(((str(r["doc_id"]), r["text"]) for r in df.collect()), key=str)
    known = steps["language_id"](spark, docs, SF)
    assert known.columns == docs.columns
    model = langid.learned(langid.columns_of(docs), None, langid.DIMENSION)
    guess = langid.guesser(*model)
    assert texts(known) == [x for x in texts(docs) if guess(x[1])[0] != "und" and guess(x[1])[1] >= langid.NOISE / langid.DIMENSION**0.5]
    single = steps["near_duplicates"](spark, known, SF)
    parts = [c for _, _, c in sorted(brute([(i, t) for i, (_, t) in enumerate(texts(known))]), key=lambda x: int(x[0]))]
    assert single.columns == docs.columns and single.count() == len({*parts})
    of = dict(zip((t for _, t in texts(known)), parts, strict=True))
    assert len({of[t] for _, t in texts(single)}) == len({*parts})
    clean = steps["decontamination"](spark, known, SF)
    assert clean.columns == docs.columns and texts(clean) == [x for x in texts(known) if x[1] != bad]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert texts(D.clean_documents(known, bench, group=200)) == texts(clean)
    mixed = steps["mixing"](spark, clean, SF)
    written = spark.read.parquet(cut(clean, "clean")._registra_path)
    assert mixed.columns == docs.columns and 0 < mixed.count() == mixing.mix(clean).agg(F.sum("copies")).first()[0]
    assert texts(steps["mixing"](spark, written, SF)) == texts(mixed)
    assert steps["sharding"](spark, mixed, SF).count() == mixed.count()
    for step in steps.values():
        assert step(spark, empty, SF).collect() == []
    assert langid.known_language(docs.withColumn("lang", F.lit(None).cast("string"))).count() == docs.count()


def test_run_and_shape(spark):
    assert [n for n, _ in P.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"] and P.ORACLE_SQL is None
    assert P.run(spark, SF).count() > 0
