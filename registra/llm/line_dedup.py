"""Line deduplication by winnowing over line hashes, in DataFrame functions only.

A document is the sequence of its lines that are not blank, trimmed, each with a 128-bit hash and its length in characters.
A window is a shortest run of consecutive lines that holds ``chars`` characters, whether it is grown forwards from its first
line or backwards from its last; one long line is a window by itself. Out of every forward window the line of the smallest
hash (the rightmost, on ties) is selected as a fingerprint, so any repeated run of ``chars`` characters or more has selected
a fingerprint at the same place in both its occurrences. Only fingerprints leave a document, each with its position and the
few neighbours that a window around it can reach.

1. Fingerprints meet by hash: each later position is joined to the earliest one. The seed is the pair of equal lines; it is
   extended left and right over both neighbourhoods while lines are equal. A match of ``chars`` characters is a repeated run.
2. A window around a seed that this match does not hold may still repeat a text in between. Such windows, and no others,
   are compared by digest with the earliest of their kind.
3. Runs are merged, and the lines of later occurrences, by (doc_id, line), are deleted. The earliest run stays.

So a line goes exactly if it lies in a window that has occurred before. Keys that very many positions share are joined by
broadcast (there are at most ``HOT`` of them), all others by a shuffle.

Defined results
  * null and empty texts have no lines and stay as they are (null stays null);
  * blank lines are neither matched nor deleted, and matching looks past them;
  * a null id comes before all ids; of rows repeated under one id, or without one, each loses only lines of its own: rows with
    the same text are one document, and different texts are put in order by a hash of the text;
  * documents that lose every line stay, with what blank lines they had; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.llm.common import ROWS_A_FILE, cut, frozen, gathered, join_first, parts_for, small_batches

#: Characters that a run must have to count as repeated.
CHARS = 30
#: A key is hot if more than one in ``HOT`` of all rows have it, so there are fewer than ``HOT`` hot keys.
HOT = 1_000
#: What a span takes in memory, and what the spans of one partition may take to be hashed and not sorted.
SPAN_BYTES, BUILD_BYTES = 128, 16 << 20
BLANKS = " \t\r\f\u000b"
LINE = "struct<h:bigint,g:bigint>"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda a, x: a + x)


def reach(size: Column, sizes: Column, chars: int) -> Column:
    """How many neighbours a window around a line can hold on one side; ``sizes`` go outwards. A neighbour counts if the lines
    before it, with or without the line itself, leave a window open."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("held"), F.lit(True).alias("on"))

    def step(a: Column, x: Column) -> Column:
        on = a["on"] & ((a["held"] + x < chars) | (a["held"] + size < chars))
        return F.struct((a["n"] + on.cast("int")).alias("n"), (a["held"] + x).alias("held"), on.alias("on"))

    return F.aggregate(sizes, zero, step, lambda a: a["n"])


def fingerprints(docs: DataFrame, chars: int) -> DataFrame:
    """One row per selected line: doc_id, tid (a hash of the text), at (its place among the lines that are not blank), fp, size, and its neighbours (lefts and rights, lsizes and rsizes), nearest first."""
    seq = F.filter(F.transform(lines_of(F.col("text")), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: F.length(x) > 0)
    line = lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit("second"), x).alias("g"))
    hashed = docs.select("doc_id", "tid", seq.alias("_s")).select("doc_id", "tid", F.transform("_s", line).alias("d"), F.transform("_s", lambda x: F.length(x)).alias("c"))
    n = F.size("c")
    # Lines are at least one character long, so a window has at most ``chars`` of them.
    grown = lambda sizes: F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("held")),
        lambda a, x: F.when(a["held"] >= chars, a).otherwise(F.struct((a["n"] + 1).alias("n"), (a["held"] + x).alias("held"))),
        lambda a: F.when(a["held"] >= chars, a["n"]).otherwise(F.lit(0)),
    )
    length = lambda i: F.when(F.get("c", i) >= chars, F.lit(1)).otherwise(grown(F.slice("c", i + 1, F.lit(chars))))
    windows = F.filter(F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.alias("i"), length(i).alias("m"))), lambda w: w["m"] > 0)

    def lowest(w: Column) -> Column:
        hs = F.reverse(F.slice("d", w["i"] + 1, w["m"]))
        return F.when(w["m"] == 1, w["i"]).otherwise(w["i"] + w["m"] - F.array_position(hs, F.array_min(hs)).cast("int"))

    # All of it inside the document's arrays: only small rows are exploded, so a long document is not copied for each of its lines.
    # No window reaches past a neighbour that is one by itself, and next to most lines of prose there is such a line.
    seen = lambda i: F.when(F.get("c", i) >= chars, F.lit(1)).otherwise(F.lit(chars))
    wide = lambda i: F.struct(
        i.alias("at"),
        F.get("c", i).alias("size"),
        F.reverse(F.slice("c", F.greatest(i - seen(i - 1), F.lit(0)) + 1, F.least(i, seen(i - 1)))).alias("lc"),
        F.slice("c", i + 2, seen(i + 1)).alias("rc"),
    )
    reached = lambda x: F.struct(x["at"].alias("at"), x["size"].alias("size"), x["lc"].alias("lc"), x["rc"].alias("rc"), reach(x["size"], x["lc"], chars).alias("l"), reach(x["size"], x["rc"], chars).alias("r"))
    near = lambda x: F.struct(
        x["at"].alias("at"),
        F.get("d", x["at"]).alias("fp"),
        x["size"].alias("size"),
        F.reverse(F.slice("d", x["at"] - x["l"] + 1, x["l"])).alias("lefts"),
        F.slice("d", x["at"] + 2, x["r"]).alias("rights"),
        F.slice(x["lc"], F.lit(1), x["l"]).alias("lsizes"),
        F.slice(x["rc"], F.lit(1), x["r"]).alias("rsizes"),
    )
    places = F.array_distinct(F.transform(windows, lowest))
    picked = hashed.select("doc_id", "tid", F.transform(F.transform(F.transform(places, wide), reached), near).alias("p"))
    # Not explode: of that Spark infers a filter on the array's size, which it works out from the text for each line anew.
    return picked.select("doc_id", "tid", F.explode_outer("p").alias("p")).where("p is not null").select("doc_id", "tid", "p.*")


def common(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
    return F.when(at == 0, F.least(F.size(a), F.size(b))).otherwise(at - 1)


def open_windows(chars: int) -> Column:
    """The windows around a seed, as (left, right, digest), that reach beyond what has matched (columns l and r)."""
    cut_left, cut_right = (lambda k: F.slice("lsizes", F.lit(1), k)), (lambda k: F.slice("rsizes", F.lit(1), k))
    cells = F.flatten(
        F.transform(F.sequence(F.lit(0), F.size("lefts")), lambda a: F.transform(F.sequence(F.lit(0), F.size("rights")), lambda b: F.struct(a.alias("a"), b.alias("b"), (total(cut_left(a)) + F.col("size") + total(cut_right(b))).alias("held"))))
    )
    edge = lambda sizes, k: F.when(k > 0, F.get(sizes, k - 1)).otherwise(F.col("size"))
    is_window = lambda w: (w["held"] >= chars) & ((w["held"] - edge("lsizes", w["a"]) < chars) | (w["held"] - edge("rsizes", w["b"]) < chars))
    beyond = lambda w: (w["a"] > F.col("l")) | (w["b"] > F.col("r"))
    hs = lambda w: F.concat(F.reverse(F.slice("lefts", F.lit(1), w["a"])), F.array("fp"), F.slice("rights", F.lit(1), w["b"]))
    digest = lambda w: F.struct(F.xxhash64(hs(w)).alias("h"), F.xxhash64(F.lit("second"), hs(w)).alias("g"))
    return F.transform(F.filter(cells, lambda w: is_window(w) & beyond(w)), lambda w: F.struct(w["a"].alias("a"), w["b"].alias("b"), digest(w).alias("key")))


def repeated_runs(docs: DataFrame, chars: int) -> tuple[DataFrame, int]:
    """(doc_id, tid, lo, hi) of later occurrences, and how many rows that can be at most."""
    place = F.struct("doc_id", "tid", "at")
    with small_batches(docs.sparkSession):
        found = cut(gathered(fingerprints(docs, chars)), "fingerprints")
    n_found = found.count()
    met = join_first(found, "fp", F.struct("doc_id", "tid", "at", "lefts", "rights"), place, HOT, n_found)
    l, r = common(F.col("lefts"), F.col("first.lefts")), common(F.col("rights"), F.col("first.rights"))  # noqa: E741
    met = met.withColumn("l", l).withColumn("r", r)
    held = total(F.slice("lsizes", F.lit(1), F.col("l"))) + F.col("size") + total(F.slice("rsizes", F.lit(1), F.col("r")))
    later = place > F.struct("first.doc_id", "first.tid", "first.at")
    runs = met.where(later & (held >= chars)).select("doc_id", "tid", (F.col("at") - F.col("l")).alias("lo"), (F.col("at") + F.col("r")).alias("hi"))
    more = met.where((F.size("lefts") > F.col("l")) | (F.size("rights") > F.col("r"))).select("doc_id", "tid", "at", F.explode_outer(open_windows(chars)).alias("w")).where("w is not null")
    more = more.select("doc_id", "tid", (F.col("at") - F.col("w.a")).alias("at"), (F.col("w.a") + F.col("w.b")).alias("more"), F.col("w.key").alias("key")).distinct()
    more = cut(more.coalesce(parts_for(n_found, ROWS_A_FILE, 2 * more.sparkSession.sparkContext.defaultParallelism)), "open")
    n_more = more.count()
    again = join_first(more, "key", place, place, HOT, n_more).where(place > F.col("first")).select("doc_id", "tid", F.col("at").alias("lo"), (F.col("at") + F.col("more")).alias("hi"))
    return runs.union(again), n_found + n_more


def line_dedup(docs: DataFrame, chars: int = CHARS) -> DataFrame:
    """doc_id, text without the lines of later repeated runs, n_lines (not blank) and n_dropped. Rows are those of ``docs``."""
    base = frozen(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tid", F.xxhash64("text"))
    runs, most = repeated_runs(base, chars)
    spans = runs.groupBy("doc_id", "tid").agg(F.collect_set(F.struct("lo", "hi")).alias("_spans")).withColumnsRenamed({"doc_id": "_id", "tid": "_tid"})
    # If a partition's spans would fit in memory even if every fingerprint had one, they are hashed and no text is sorted; else both sides are sorted and spill.
    if most * SPAN_BYTES <= BUILD_BYTES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        spans = spans.hint("shuffle_hash")
    merged = F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(s["lo"], s["hi"]))))
    out = base.join(spans.select("_id", "_tid", merged.alias("gone")), F.expr("doc_id <=> _id and tid = _tid"), "left")
    out = out.withColumn("_lines", lines_of(F.col("text")))
    places = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: F.length(F.btrim(F.get("_lines", i), F.lit(BLANKS))) > 0)
    out = out.withColumn("_places", F.when(F.col("text").isNotNull(), places))
    drop = F.transform("gone", lambda i: F.get("_places", i))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), drop)
    clean = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n"))
    count = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return out.select("doc_id", clean.alias("text"), count("_places").alias("n_lines"), count("gone").alias("n_dropped"))
