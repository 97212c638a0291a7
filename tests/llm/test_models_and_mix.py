import hashlib
import zlib

import numpy as np
import pytest

from registra.llm import common, langid, mixing, quality, queries, toxicity

SF = "/root/testdata/sf0.1"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars >= 40")
    rows = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    out = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert len(out) > 300 and np.mean(out) > 0.99


def test_language_edges(edge, empty, spark):
    got = {r["doc_id"]: r for r in langid.language_id(edge).collect()}
    assert len(langid.language_id(edge).collect()) == edge.count() and langid.language_id(empty).collect() == []
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (3, 4, 5, 10))
    assert got[6]["lang_pred"] == got[7]["lang_pred"] in ("en", "de", "fr")
    assert langid.prototypes(edge.where("false")) == []
    assert {r["lang_pred"] for r in langid.language_id(edge.withColumn("lang", edge["lang"].substr(9, 0))).collect()} <= {"und", ""}


def test_bundles_are_what_they_are_said_to_be():
    codes, counts = langid.trigrams("The cat, the hat")
    v = langid.trigram_vectors(codes, 2048).astype(float)
    assert set(np.unique(v)) == {-1.0, 1.0} and abs(v[0] @ v[1]) < 200
    assert abs(np.linalg.norm(counts @ v) / np.sqrt(counts @ counts * 2048) - 1) < 0.1
    table = langid.Table(lambda c: langid.trigram_vectors(c, 64).astype(np.float32), 64, known=5)
    for text in ("abc def", "ghi", "abc xyz", "ghi jkl mno"):
        codes, _ = langid.trigrams(text)
        assert (table.of(codes) == langid.trigram_vectors(codes, 64)).all()


def test_language_query_against_brute_force(spark, documents):
    """Bundles of vectors, added up by definition."""
    rows, d = documents.collect(), langid.DIMENSION
    vector = {}

    def bundle(text):
        codes, counts = langid.trigrams(text)
        for code in codes.tolist():
            if code not in vector:
                a, b, c = (langid.letter_vector(code >> s & ((1 << 21) - 1), d).astype(float) for s in (42, 21, 0))
                vector[code] = np.roll(a, 2) * np.roll(b, 1) * c
        return sum((n * vector[c] for c, n in zip(codes.tolist(), counts.tolist(), strict=True)), np.zeros(d)), np.sqrt(float(counts @ counts)) if len(counts) else 0.0

    bundles, protos = [bundle(r["text"]) for r in rows], {}
    for r, (v, n) in zip(rows, bundles, strict=True):
        if n and r["lang"] is not None and not held(r["doc_id"]):
            protos[r["lang"]] = protos.get(r["lang"], np.zeros(d)) + v / n
    names = sorted(protos)
    matrix = np.array([protos[x] / np.linalg.norm(protos[x]) for x in names])
    got = {r["doc_id"]: r for r in queries.op9_language_id(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for r, (v, n) in zip(rows, bundles, strict=True):
        cosines = matrix @ v / (n * np.sqrt(d)) if n else np.zeros(1)
        assert got[r["doc_id"]]["lang_pred"] == (names[int(np.argmax(cosines))] if n else "und")
        assert abs(got[r["doc_id"]]["score"] - min(1.0, max(0.0, cosines.max()))) < 1e-4


def test_known_language_rejects_what_is_in_no_learned_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    junk = [(-1, "\u4e2d\u6587\u5b57 \u6c49\u5b57 \u5341\u4e09", None), (-2, "xqzj wvkq jzxq qqzk vjwx zkqj xwvz", None), (-3, "123 !?", "en"), (-4, None, "en"), (-5, "The theand anion her", "en")]
    both = docs.union(spark.createDataFrame(junk, docs.schema))
    kept = {r["doc_id"] for r in langid.known_language(both).collect()}
    assert kept & {-1, -2, -3, -4, -5} == {-5}
    lost = [r["text"] for r in docs.collect() if r["doc_id"] not in kept]
    assert len(lost) <= 0.002 * docs.count()
    only = langid.known_language(both, languages=frozenset({"de"})).collect()
    assert only and np.mean([r["lang"] == "de" for r in only]) > 0.98


def scores(df, labels, label):
    rows = df.join(labels, "doc_id").collect()
    return [(r["score"], r["predicted"], r[label]) for r in rows if r["held_out"]]


def test_toxicity_held_out(spark):
    out = scores(queries.op8_toxicity(spark, SF), spark.read.parquet(f"{SF}/labels.parquet"), "toxic")
    caught = [p for _, p, y in out if y == 1]
    clean = [p for _, p, y in out if y == 0]
    assert len(caught) > 50 and np.mean(caught) > 0.85 and np.mean(clean) < 0.01


def found(g, text):
    return {toxicity.KINDS[i]: w for i, w in enumerate(g.evidence(text)) if w}


def test_grammar_scores_clauses():
    g = toxicity.Grammar({"idiot": 5.0, "stup*": 4.0})
    find = lambda text: found(g, text)
    assert find("What an IDIOT! Fine.") == {("insult", False, False, False): 5.0}
    assert find("you are stupider") == {("insult", True, False, False): 4.0}
    assert find("you are not an idiot") == {("insult", True, True, False): 5.0}
    assert find("not now, idiot") == {("insult", False, False, False): 5.0}
    for text in ("He said, you are an idiot", "He said: you are an idiot", "You are an idiot, she said.", "\u201cYou are an idiot,\u201d she wrote"):
        assert find(text) == {("insult", True, False, True): 5.0}
    assert find("He said it. You idiot.") == {("insult", True, False, False): 5.0}
    assert find("What an idiot, she said") == {("insult", False, False, True): 5.0}
    assert find("idiot you") == find("idiot, you") == {("insult", True, False, False): 5.0}
    for text in ("I will kill you", "You will be killed", "he kills them", "we are killing you", "they will stab you", "they stabbed him"):
        assert find(text) == {("threat", True, False, False): 2.0}
    assert find("they threaten to attack you") == {("threat", True, False, False): 4.0}
    assert find("She isn\u2019t an idiot") == find("She isn't an idiot") == {("insult", True, True, False): 5.0}
    assert find("YOU!! IDIOT!! ALL!!") == find("you | idiot | all") == {("insult", True, False, False): 5.0}
    # A word alone is no clause.
    assert find("idiot") == find("Idiot!") == find("Idiot!!") == find("kill.") == find("Fine. Idiot. Fine.") == {}
    assert find("skill and unstupid are fine") == find("") == find(None) == {}
    assert found(toxicity.Grammar({}, {"kill": 6.5}), "they kill you") == {("threat", True, False, False): 6.5}


def plain_evidence(lexicon, text):
    """The clause rules said without machines."""
    out, threats = {}, {*toxicity.inflected()}
    for clause in " ".join(toxicity.words_of(text)).split("."):
        words = clause.split()
        says = lambda w: w in toxicity.REPORTED
        for i, w in enumerate(words):
            weight = 2.0 if w in threats else lexicon.get(w)
            if weight is None or all(x == "," for j, x in enumerate(words) if j != i):
                continue
            left, right = words[:i], words[i + 1 :]
            since = max((j for j, x in enumerate(left) if says(x)), default=-1)
            target = any(x in toxicity.TARGET for x in left[since + 1 :]) or any(x in toxicity.TARGET and not (j + 1 < len(right) and says(right[j + 1])) for j, x in enumerate(right))
            near = left[-toxicity.REACH :]
            near = near[len(near) - near[::-1].index(",") :] if "," in near else near
            negated = any(x in toxicity.NEGATION or x.endswith("n't") for x in near)
            told = [j for j, x in enumerate(right) if says(x)]
            reported = any(map(says, left)) or bool(told) and "," in right[: told[-1]]
            kind = ("threat" if w in threats else "insult", target, negated, reported)
            out[kind] = out.get(kind, 0.0) + weight
    return out


def test_grammar_against_plain_rules():
    import random

    rng, lexicon = random.Random(7), {"idiot": 5.0, "scum": 3.0}
    g = toxicity.Grammar(lexicon)
    pool = ["you", "she", "them", "not", "isn't", "never", "said", "wrote", "idiot", "scum", "kills", "attack", ",", ":", "(", ".", "!", "!!", "...", "|", "a", "the", "thing", "is", "said ,", ", she said"]
    for _ in range(4_000):
        text = " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))
        assert found(g, text) == plain_evidence(lexicon, text), text


def test_toxicity_query_against_brute_force(spark):
    """Lexicon, fit and scores again, in memory, with the plain rules."""
    import math

    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["toxic"] is not None and not held(r["doc_id"]) and r["doc_id"] in docs}
    counts = ({}, {})
    for i, y in labels.items():
        for f in {f for w in {*toxicity.words_of(docs[i])} - {".", ","} for f in toxicity.features(w)}:
            counts[y][f] = counts[y].get(f, 0) + 1
    yes, no = sum(labels.values()), len(labels) - sum(labels.values())
    odds = {f: math.log((n + 0.5) / (yes + 1)) - math.log((counts[0].get(f, 0) + 0.5) / (no + 1)) for f, n in counts[1].items() if n >= toxicity.LEAST_DOCS}
    rows = spark.createDataFrame([(docs[i], y) for i, y in labels.items()], "text string, toxic int")
    lexicon, threats = toxicity.learn_lexicon(rows)
    assert lexicon and all(w == round(odds[f], 6) and w >= toxicity.LEAST_WEIGHT for f, w in lexicon.items())
    for f, w in odds.items():  # whatever tells as much is in the lexicon, or a stem of it is
        assert w < toxicity.LEAST_WEIGHT or f in lexicon or f in threats or any(f.startswith(x[:-1]) for x in lexicon if x.endswith("*")) or f in {*toxicity.TARGET, *toxicity.NEGATION, *toxicity.REPORTED, *toxicity.inflected()}
    g = toxicity.Grammar(lexicon, threats)
    plain = {w: x for t in docs.values() for w in toxicity.words_of(t) for s, x in [g.symbol(w)] if s == toxicity.INSULT}
    vector = lambda t: [plain_evidence(plain, t).get(k, 0.0) for k in toxicity.KINDS]
    x, y = toxicity.inputs(np.array([vector(docs[i]) for i in labels])), np.array([*labels.values()], float)
    w, b = toxicity.fit(x, y, *toxicity.priors())
    for r in queries.op8_toxicity(spark, sf).collect():
        p = 1 / (1 + np.exp(-(toxicity.inputs(np.array(vector(docs[r["doc_id"]]))) @ w + b)))
        assert abs(r["score"] - p) < 1e-4 and r["held_out"] == held(r["doc_id"]) and r["predicted"] == (r["score"] >= 0.5)


def test_toxicity_edges(edge, empty, spark):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (None, 1, 1), (77, 1, 1), (8, None, None)], "doc_id long, toxic int, quality int")
    rows = toxicity.toxicity(edge, labels).collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] < 0.5 and r["predicted"] == 0 for r in rows)
    assert toxicity.toxicity(empty, labels).collect() == [] and toxicity.toxicity(edge, labels.limit(0)).count() == edge.count()


def test_quality_held_out_and_edges(spark, edge, empty):
    out = scores(queries.op7_quality(spark, SF), spark.read.parquet(f"{SF}/labels.parquet"), "quality")
    assert np.mean([p == y for _, p, y in out]) > 0.93
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (7, 0, 0), (None, 1, 1)], "doc_id long, toxic int, quality int")
    pages = spark.createDataFrame([(1, "http://a.example/x?y#z", "<p>x</p>"), (1, "http://b.example", None), (None, "u", "h"), (2, None, None)], "page_id long, url string, html string")
    for p in (None, pages):
        rows = quality.quality(edge, labels, p).collect()
        assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.quality(empty, labels, pages).collect() == []
    assert {r["score"] for r in quality.quality(edge, labels.limit(0)).collect()} == {0.5}


def test_quality_query_against_brute_force(spark):
    """Features, rounds and scores again, in memory, from rows in plain lists."""
    import xxhash

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").orderBy("url", ascending=False).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(pages) == spark.read.parquet(f"{sf}/pages.parquet").count()
    order = lambda i: int.from_bytes(xxhash.xxh64(int(i).to_bytes(8, "little"), 42).digest(), "big", signed=True)

    def meta(i):
        r, page, lines = docs[i], pages.get(i), (docs[i]["text"] or "").split("\n")
        html = page and (page["html"] or "")
        return quality.meta_features(r["n_chars"], len(lines), max(map(len, lines)), r["source"], r["lang"], page and page["url"], len(html) if page else None, html.count("<") if page else None)

    feats = {i: (quality.text_features(r["text"]), meta(i)) for i, r in docs.items()}
    known = sorted((i for i, q in labels.items() if q is not None and i in docs and not held(i)), key=order)
    loose = [i for i in docs if i not in labels and not held(i)]

    def extremes(view, w, low, high):
        z = {i: float(quality.logits(feats[i][view == "meta"], w)) for i in loose}
        ends = sorted(loose, key=lambda i: (z[i], order(i))), sorted(loose, key=lambda i: (-z[i], order(i)))
        return [(i, z[i]) for i in ends[0][:low]], [(i, z[i]) for i in ends[1][:high]]

    view = lambda k: np.array([feats[i][k] for i in known], np.float32)
    model = quality.cotrain(view(0), view(1), np.array([labels[i] for i in known], float), extremes, lambda ids: {i: feats[i] for i in ids})
    assert {t for _, _, t, _ in model["handed"]} == {"text", "meta"} or len(model["handed"]) > 0
    got = quality_scores = {r["doc_id"]: r for r in queries.op7_quality(spark, sf).collect()}
    assert len(quality_scores) == len(docs)
    for i, (t, m) in feats.items():
        z = quality.logits(np.array([quality.logits(t, model["text"]), quality.logits(m, model["meta"])]), model["blend"])
        assert abs(got[i]["score"] - 1 / (1 + np.exp(-z))) < 1e-3


def water(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def plain_mix(rows, target, total, large=1_000):
    """One source, document by document: (size, draw) from large to small, until sizes are small; then one expectation for all."""
    offset, left, rest, upto, out = None, target, total, 0.0, []
    for size, offset in rows:
        if size * large <= total:
            break
        e = min(2.0, max(0.0, left / rest))
        n = int(np.floor(upto + e + offset) - np.floor(upto + offset))
        left, rest, upto = left - n * size, rest - size, upto + e
        out.append(n)
    return out, left, rest


@pytest.mark.parametrize("bucket_rows", [2_000_000, 40])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mix_takes_its_targets(spark, sf, bucket_rows):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = mixing.mix(docs, bucket_rows=bucket_rows).join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    sizes = {}
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode().split()) and 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = water(sizes)
    for s, size in sizes.items():
        own = [r for r in rows if r["source"] == s]
        assert abs(own[0]["target"] - want[s]) < 1e-6 * want[s] and own[0]["source_size"] == size
        # Within the tenth smallest document, a thousandth of the source, or, where no document may be taken more often, a hundredth of the target.
        near = max(sorted(r["size"] for r in own)[min(9, len(own) - 1)], size / 1_000, 0.01 * want[s] if want[s] > 1.8 * size else 0)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= near, s
        z = int(hashlib.md5(f"mix-1#{s}".encode()).hexdigest()[:12], 16) / 2**48
        draw = lambda r: int(hashlib.md5(f"mix-1/{r['doc_id']}".encode()).hexdigest()[:12], 16)
        order = sorted(own, key=lambda r: (-r["size"], draw(r), r["doc_id"]))
        copies, _, _ = plain_mix([(r["size"], z) for r in order], own[0]["target"], size)
        assert [r["copies"] for r in order[: len(copies)]] == copies
    again = mixing.mix(docs.repartition(7), bucket_rows=bucket_rows)
    assert sorted((r["doc_id"], r["taken"]) for r in again.collect()) == sorted((r["doc_id"], r["taken"]) for r in rows)


@pytest.mark.parametrize("sources", [100_000, 0])
def test_mix_of_many_small_documents_shares_one_expectation(spark, monkeypatch, sources):
    monkeypatch.setattr(mixing, "SOURCES", sources)
    monkeypatch.setattr(common, "PLAIN", 0)
    docs = spark.range(6_000).selectExpr("id AS doc_id", "repeat('w ', CAST(1 + id % 7 AS INT)) AS text", "IF(id % 3 = 0, 'a', 'b') AS source")
    for bucket_rows in (2_000_000, 100):
        got = mixing.mix(docs, bucket_rows=bucket_rows).groupBy("target").sum("taken", "size").collect()
        assert len(got) == 2 and all(abs(r["sum(taken)"] - r["target"]) <= 7 for r in got)


def test_mix_edges(edge, empty):
    rows = mixing.mix(edge).collect()
    assert len(rows) == edge.count() and mixing.mix(empty).collect() == []
    assert all(r["taken"] <= 2 * r["size"] for r in rows) and all(r["size"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))
    nothing = mixing.mix(edge.where("doc_id in (3, 4, 5)")).collect()
    assert all(r["target"] == 0 and r["taken"] == 0 for r in nothing)


def test_mixed_documents_take_each_row_as_often_as_the_mix_does(spark):
    rows = [(k, f"{s}{i} " + "w " * 9, s) for s, n in (("a", 10), ("b", 200), ("c", 10)) for i in range(n) for k in (None if i % 2 else 7,)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    target, got = water({"a": 100, "b": 2000, "c": 100}), {}
    for r in mixing.mixed_documents(docs).collect():
        got[r["source"]] = got.get(r["source"], 0) + len(r["text"].split())
    assert set(got) == {"a", "b", "c"} and all(abs(got[s] - target[s]) <= 10 for s in got)


def test_mixed_documents_shuffle_no_texts(spark):
    """How often a row is taken is told to the texts where they lie, however many rows there are."""
    told = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = mixing.mixed_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", told)
    assert "SortMergeJoin" not in plan and plan.count("FileScan parquet [doc_id") == 1
