import random

import pytest

from registra.llm import common
from registra.llm import components as K
from registra.llm import decontam as D
from registra.llm import ngram_join as N
from registra.llm.shingles import FOLD, shingles


def sets_of(text, n=5):
    words = (text or "").encode().translate(FOLD).split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, num=75, den=100):
    sets = [sets_of(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return sorted((str(k), len(sets[i]), str(low.get(find(i)) if sets[i] else k)) for i, (k, _) in enumerate(rows))


def result(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


def near_copies(rng, groups=12, size=25, words=60):
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, words, 3 * words]))]
        for _ in range(rng.randrange(1, size)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(30)}"
            if rng.random() < 0.3:
                copy += [f"y{rng.randrange(9)}" for _ in range(rng.randrange(1, 1 + len(base) // 3))]
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_join_against_brute_force(spark, seed):
    rows = near_copies(random.Random(seed))
    assert result(N.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == brute(rows)


def test_join_with_tiny_tasks_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(N, "POSTINGS", 2_000)
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "BROADCAST_IDS", 0)
    monkeypatch.setattr(N, "GROUP_CLASSES", 20)
    monkeypatch.setattr(N, "HOT", 5)
    monkeypatch.setattr(common, "PLAIN", 0)
    rows = near_copies(random.Random(9), groups=6, size=60)
    assert result(N.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


@pytest.mark.parametrize("block", [4, 2_048])
def test_divide_skip_finds_all_links_without_hubs(spark, monkeypatch, block):
    """Every node a component of its own: the search alone must find each link, whichever of the two asks."""
    import numpy as np

    monkeypatch.setattr(N, "BLOCK", block)
    rng, nodes, sets = random.Random(block), [], {}
    for k in range(120):
        base = set(range(40 * (k % 6), 40 * (k % 6) + 40))
        for _ in range(rng.randrange(0, 9)):
            base.symmetric_difference_update({rng.randrange(240)})
        sets[k] = base
    where = {h: sum(h in s for s in sets.values()) for h in range(240)}
    for k, s in sets.items():
        core = sorted(h for h in s if where[h] > 1)
        nodes.append((k, len(s), len(core), bytearray(np.array(core, np.int64).tobytes()), bytearray(np.array([where[h] for h in core], np.int32).tobytes()), k, 1))
    df = spark.createDataFrame(nodes, "cls long, n long, m long, h binary, len binary, comp long, size long").repartition(3)
    got = {tuple(sorted((r["a"], r["b"]))) for r in N.divide_skip(df, len(nodes), sum(x[2] for x in nodes), 75, 100).collect()}
    assert got == {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])} and len(got) > 100


def test_merge_skip_against_counting():
    rng = random.Random(11)
    for _ in range(500):
        lists = [sorted(rng.sample(range(60), rng.randrange(0, 25))) for _ in range(rng.randrange(1, 12))]
        need = rng.randrange(1, 9)
        counts = {v: sum(v in x for x in lists) for v in range(60)}
        assert N.merge_skip(lists, need) == [(v, c) for v, c in sorted(counts.items()) if c >= need]


def test_work_grows_with_input_where_documents_share_passages(spark, monkeypatch):
    """Texts of 2 of 10 shared passages and a word of their own: what is merged and verified does not grow by the square."""
    seen, real_verified, real_skip = {}, N.verified, N.divide_skip

    def verified(pairs, *rest):
        seen["pairs"] = seen.get("pairs", 0) + pairs.count()
        return real_verified(pairs, *rest)

    def divide_skip(nodes, *rest):
        seen["nodes"] = seen.get("nodes", 0) + nodes.count()
        return real_skip(nodes, *rest)

    monkeypatch.setattr(N, "verified", verified)
    monkeypatch.setattr(N, "divide_skip", divide_skip)
    rng, work = random.Random(2), []
    passages = [" ".join(f"p{k}x{i}" for i in range(24)) for k in range(10)]
    for n in (300, 600, 1_200):
        seen.clear()
        rows = [(i, " ".join([*(passages[k] for k in rng.sample(range(10), 2)), f"own{i}"])) for i in range(n)]
        got = result(N.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
        if n == 300:
            assert got == brute(rows)
        work.append((seen.get("pairs", 0), seen.get("nodes", 0)))
        assert len({c for _, _, c in got}) == 45
    assert work[2][0] <= 2 * max(work[0][0], 200) and work[2][1] <= 200


def test_documents_that_share_most_but_not_enough(spark):
    """Nodes of one core that are not linked with its smallest, and links that only some of them have."""
    core = [f"c{i}" for i in range(80)]
    rows = [(i, " ".join([*core, *(f"u{i}x{j}" for j in range(k))])) for i, k in enumerate([0, 1, 5, 12, 20, 24, 25, 25, 24, 18, 3, 26, 26])]
    rows += [(100 + i, " ".join([*core[:70], *(f"v{i}x{j}" for j in range(k))])) for i, k in enumerate([0, 4, 9, 15])]
    random.Random(1).shuffle(rows)
    assert result(N.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


@pytest.mark.parametrize("held", [200, 640, 5_000])
def test_join_where_long_lists_leave_their_buckets(spark, monkeypatch, held):
    monkeypatch.setattr(N, "HELD", held)
    rng = random.Random(held)
    passage = [f"p{i}" for i in range(30)]
    rows = near_copies(rng, groups=5, size=40)
    # A passage that very many different texts share, some of them near one another, and copies of one text over many tasks.
    for i in range(300):
        own = [f"q{i % 150}_{j}" for j in range(rng.choice([4, 8, 60]))]
        rows.append((1_000 + i, " ".join(passage + own)))
    rows += [(2_000 + i, " ".join(passage + ["same", "text"])) for i in range(100)]
    rng.shuffle(rows)
    assert result(N.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))) == brute(rows)


def test_bucket_gives_whole_lists_in_bounded_pieces():
    import numpy as np

    rng = np.random.default_rng(5)
    h = np.concatenate([rng.integers(0, 4_000, 6_000), np.full(5_000, 7), np.full(3_000, 9)]).astype(np.uint64)
    d = rng.permutation(len(h)).astype(np.int64)
    order = rng.permutation(len(h))
    h, d = h[order], d[order]
    bucket, pieces = N.Bucket(1_000), []
    for k in range(0, len(h), 100):
        pieces += bucket.add(h[k : k + 100], d[k : k + 100])
    assert bucket.far_size <= 250 + 100 and {7, 9} <= set(bucket.long.tolist())
    pieces += bucket.finish()
    got = sorted((x, y) for p in pieces for x, y in zip(p[0].tolist(), p[1].tolist(), strict=True))
    sizes = dict(zip(*np.unique(h, return_counts=True), strict=True))
    assert got == sorted((x, y) for x, y in zip(h.tolist(), d.tolist(), strict=True) if sizes[x] > 1)
    lengths = {}
    for p in pieces:
        for x, n in zip(p[0].tolist(), p[2].tolist(), strict=True):
            assert lengths.setdefault(x, n) == n and n in (sizes[x], N.ENDLESS)


def test_chain_of_links_is_one_component(spark):
    words = [f"c{i}" for i in range(200)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 60])) for i in range(30)]
    got = result(N.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows) and {c for _, _, c in got} == {"0"}


def test_join_edges(edge, empty, spark):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert result(N.ngram_join(edge)) == brute(rows)
    assert N.ngram_join(empty).collect() == []
    one = spark.createDataFrame([(5, "only one document is here today")], "doc_id long, text string")
    assert result(N.ngram_join(one)) == [("5", 2, "5")]


def kept_of(spark, rows):
    got = N.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(3, "text"))
    return sorted(((str(r["doc_id"]), r["text"]) for r in got.collect()), key=str)


def test_one_of_each_group_decides_by_row(spark):
    x, y, z = (" ".join(f"{k}{i}" for i in range(40)) for k in "xyz")
    rows = [(5, x), (5, y), (2, y + " more"), (9, x + " more"), (None, z), (None, z + " more"), (None, x + " else"), (4, y), (4, y), (1, "one text"), (1, "one text"), (3, ""), (3, None), (None, "")]
    assert kept_of(spark, rows) in [sorted([("5", x), ("2", y + " more"), ("1", "one text"), ("None", t), ("3", ""), ("3", None), ("None", "")], key=str) for t in (z, z + " more")]


@pytest.mark.parametrize(("seed", "hot"), [(1, 1_000), (2, 20)])
def test_one_of_each_group_against_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(N, "HOT", hot)
    rng = random.Random(seed)
    rows = [(rng.choice([None, i // 4, i // 4, i]), t) for i, t in near_copies(rng)]
    rows += rng.sample(rows, 30) + [rows[0]] * 40 + [(None, rows[1][1])] * 40
    groups = {}
    parts = {int(k): c for k, _, c in brute([(i, t) for i, (_, t) in enumerate(rows)])}
    for i, c in parts.items():
        groups.setdefault(c, []).append(rows[i])
    got = [(r["doc_id"], r["text"]) for r in N.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()]
    where = {t: parts[i] for i, (_, t) in enumerate(rows)}
    assert len(got) == len(groups) == len({where[t] for _, t in got})
    for k, t in got:
        own = groups[where[t]]
        assert (k, t) in own and (k is None, k or 0) == min((j is None, j or 0) for j, _ in own)


def test_one_of_each_group_shuffles_no_texts(spark, tmp_path):
    """What goes is told to the texts where they lie, however many rows go; equal rows of several files are told apart."""
    rows = [(i % 40, f"common words of text {i % 50} that all copies share here") for i in range(400)] + [(None, "nobody"), (None, ""), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "docs"))
    told = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = N.one_of_each_group(spark.read.parquet(str(tmp_path / "docs")))
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = [(r["doc_id"], r["text"]) for r in out.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", told)
    assert "SortMergeJoin" not in plan and plan.count("FileScan parquet [doc_id") == 1
    least = {}
    for i, t in rows[:400]:
        least[t] = min(i, least.get(t, i))
    assert sorted(got, key=str) == sorted([(i, t) for t, i in least.items()] + rows[400:], key=str)


@pytest.mark.parametrize("most_bytes", [1 << 25, 0])
def test_times_of_rows(spark, tmp_path, monkeypatch, most_bytes):
    """Times reach the rows of several files and blocks, by bits and by a shuffled join."""
    monkeypatch.setattr(common, "BITS_BYTES", most_bytes)
    spark.range(0, 150_000, 1, 2).write.parquet(str(tmp_path / "t"))
    for df in (spark.read.parquet(str(tmp_path / "t")), spark.range(0, 150_000, 1, 2).withColumnRenamed("id", "_block")):
        (name,) = df.columns
        tagged, row = common.numbered(df, "t")
        marks = common.cut(tagged.where(f"{name} % 5 > 1 and {name} != 32768").selectExpr(f"{row} as row", f"cast({name} % 5 - 1 as int) as times"), "marks")
        out, told = common.times(tagged, row, marks)
        wrong = out.where(f"{told} != if({name} = 32768, 0, greatest(0, {name} % 5 - 1))")
        assert out.columns == [name, row, told] and (out.count(), out.select(name).distinct().count(), wrong.count()) == (150_000, 150_000, 0)
        out, told = common.times(tagged, row, common.cut(marks.limit(0), "none"))
        assert out.where(f"{told} = 0").count() == 150_000


def test_shingles_of_words():
    for text in ("", " \t", "a", "a b c d", "A b\x0bc  d\ne f", "é é é é é é é", "a b c d e a b c d e a b c d e", "w\x85x y z q r s"):
        assert len(shingles(text)) == len(sets_of(text))
    assert (shingles("A b  c d E f") == shingles("a B c\td e F")).all()


def test_shingles_of_long_texts_and_words(monkeypatch):
    import tracemalloc

    from registra.llm import shingles as M

    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "bb", "ccc", "d" * 300, "é" * 200, "d" * 299 + "x"]) for _ in range(n)) for n in (1, 4, 5, 6, 37, 400)]
    whole = [M.shingles(t).tolist() for t in texts]
    for stretch in (1, 7, 64):
        monkeypatch.setattr(M, "STRETCH", stretch)
        assert [M.shingles(t).tolist() for t in texts] == whole
        assert [len(x) for x in whole] == [len(sets_of(t)) for t in texts]
    monkeypatch.undo()
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(700_000))
    tracemalloc.start()
    assert len(M.shingles(text)) > 690_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(text)


@pytest.mark.parametrize("plain", [200_000, 0])
def test_components(spark, monkeypatch, plain):
    monkeypatch.setattr(common, "PLAIN", plain)
    monkeypatch.setattr(K, "HOT", 30)
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)] + [(500, i) for i in range(2_000, 2_080)]
    got = {r["node"]: r["component"] for r in K.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    assert all(got[x] == find(x) for x in got) and got[1060] == 1000
    assert K.components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_hits(words, patterns):
    hit, items = set(), set()
    for p, item in patterns:
        for i in range(len(words) - len(p) + 1):
            if tuple(words[i : i + len(p)]) == p:
                hit.update(range(i, i + len(p)))
                items.add(item)
    return len(hit), sorted(items)


def test_wu_manber_against_brute_force():
    rng = random.Random(3)
    word = lambda: rng.choice("abcd")
    items = [(f"i{k}", " ".join(word() for _ in range(rng.randrange(0, 9)))) for k in range(40)]
    patterns = D.patterns_of(items, 4)
    machines, names = D.searchers(patterns)
    for _ in range(300):
        words = D.words_of(" ".join(word() for _ in range(rng.randrange(0, 30))))
        spans, found = D.search(words, machines, names)
        assert (sum(spans[1::2]) - sum(spans[::2]), found) == brute_hits(words, patterns)


def test_decontamination_edges(spark, edge, empty):
    bench = spark.createDataFrame([("q2", "Quick brown-fox jumps over the lazy dog, and then the"), ("q1", "ONE two!"), ("q1", "beta gamma"), (None, "12345"), ("q9", None), ("q8", "")], "item_id string, text string")
    rows = D.decontaminate(edge, bench)
    got = {r["doc_id"]: r for r in rows.collect() if r["doc_id"] is not None}
    assert rows.count() == edge.count() and D.decontaminate(empty, bench).collect() == []
    assert got[6]["n_items"] == 1 and got[6]["n_hit"] == 11 * 3999 + 10 and got[8]["n_hit"] == 2 and got[1]["n_hit"] == 2
    assert got[10]["n_items"] == 1 and got[4]["n_words"] == 0 and not got[3]["contaminated"]
    assert not D.decontaminate(edge, bench.limit(0)).where("contaminated").count()
    pick = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"]
    whole = sorted(map(str, rows.select(pick).collect()))
    assert sorted(map(str, D.decontaminate(edge, bench, group=1).select(pick).collect())) == whole


def test_a_large_item_is_dealt_to_several_groups(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(40)}" for _ in range(700)]
    bench = spark.createDataFrame([("big", " ".join(words)), ("b", " ".join(words[100:112])), ("s", "w1 w2")], "item_id string, text string")
    groups = list(D.pattern_groups(bench, 10, 64))
    assert len(groups) > 8 and max(map(len, groups)) == 64
    patterns = D.patterns_of([(r["item_id"], r["text"]) for r in bench.collect()], 10)
    assert {x for g in groups for x in g} == {*patterns}
    rows = [(i, " ".join([*words[k : k + 40], "stop", *(f"w{rng.randrange(40)}" for _ in range(30))])) for i, k in enumerate(range(0, 600, 25))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in D.decontaminate(docs, bench, group=64).collect()}
    assert got == {i: brute_hits(D.words_of(t), patterns) for i, t in rows}
    assert D.clean_documents(docs, bench, group=64).count() == sum(not n for n, _ in got.values())
