"""Mixing sources to target weights by systematic sampling.

Sources get weights 3, 1, 2, repeating, by code point, null last, and share a budget of words. No target is above ``most``
times its source's size; what a source cannot take is shared by weight among the rest. The level that does this is found in
closed form, from prefix sums over sources by (cap / weight).

Inside a source documents go from large to small. Their expected copies are prefix-summed, one random offset per source is
added, and a document is emitted once for each integer boundary that its step crosses. What is expected of a document is
what is still to be taken for each word that is still to come, 0 to ``most``. The large documents, those with more than one
in ``LARGE`` of their source's words (so there are fewer than ``LARGE`` of them), are folded one by one, each expectation
allowing for what the ones before have taken. All others share one expectation; their order, by size class and then by hash,
is dealt out by (class, hash bucket), whose counts are prefix-summed, so that no task sorts a whole source.

So a source's words come within about one in ``LARGE`` of its size of the target, or, where few documents make up a source,
within what its last and smallest documents can still even out.

Defined results
  * null texts have size 0 and may be drawn like others; a null source is a source, the last; a null id is allowed;
  * a source of size 0 has target 0 and takes nothing;
  * targets are found from one row for each source, in one task; equal rows may swap copies; with one seed, reruns agree; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from registra.llm.common import WORD, cut, free, frozen, join_hot, numbered, parts_for, times

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
SEED = "mix-1"
LARGE = 1_000
#: Rows for one hash bucket; each has some 140 size classes, which are sorted apart.
BUCKET_ROWS = 2_000_000
#: Sources whose table is broadcast; with more of them only those that very many rows have are.
SOURCES = 100_000
HOT = 1_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(name: Column) -> Column:
    """A number in [0, 1) that a string decides: 48 bits of its MD5."""
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """(source, source_size) -> also target. The table has one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * most)
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    # With the k tightest caps taken whole, the rest share what is left by weight; the level is the first that its own cap bears.
    rows = (
        rows.withColumn("total", F.sum("source_size").over(everything) * F.lit(budget))
        .withColumn("before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weights", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("weights"))
    )
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("cap").cast("double")))
    return rows.withColumn("level", level).withColumn("target", target).drop("w", "cap", "total", "before", "weights", "level")


def size_class(size: Column) -> Column:
    """Eight classes to an octave: the place of the top bit, then the three bits below it."""
    top = F.length(F.bin(size)) - 1
    return F.when(size < 8, size).otherwise(top * 8 + F.floor(size / F.pow(F.lit(2.0), top - 3)) - 8)


def expected(left: Column, size: Column, most: int) -> Column:
    return F.least(F.lit(float(most)), F.greatest(F.lit(0.0), left / size))


def crossed(upto: Column, step: Column, offset: Column) -> Column:
    """Integer boundaries that a step from ``upto`` crosses."""
    return (F.floor(upto + step + offset) - F.floor(upto + offset)).cast("long")


def fold_large(large: DataFrame, most: int) -> DataFrame:
    """(_k, rows with their copies, left: words still to take, rest: words still to come, upto: expected copies so far) for each source that has large documents."""
    by = large.groupBy("_k", "source_size", "target", "_z").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("s"), "_d", "doc_id", "_own"))).alias("rows"))

    def step(a: Column, x: Column) -> Column:
        e = expected(a["left"], a["rest"], most)
        copies = crossed(a["upto"], e, F.col("_z"))
        return F.struct((a["left"] + copies * x["s"]).alias("left"), (a["rest"] + x["s"]).alias("rest"), (a["upto"] + e).alias("upto"), F.concat(a["copies"], F.array(copies)).alias("copies"))

    zero = F.struct(F.col("target").alias("left"), F.col("source_size").alias("rest"), F.lit(0.0).alias("upto"), F.array().cast("array<bigint>").alias("copies"))
    return by.withColumn("f", F.aggregate("rows", zero, step)).select("_k", "source_size", "target", "rows", "f.*")


def mix(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST, bucket_rows: int = BUCKET_ROWS, row: str | None = None, large: int = LARGE) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies for every row, and the column ``row`` that tells rows apart, where one is named."""
    own = F.col(row) if row else F.lit(0)
    sized = frozen(docs, "doc_id", "text", "source", *([row] if row else [])).select(own.alias("_own"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    rows = docs.count()
    sized = cut(sized, "sizes", rows)
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    offset = unit(F.concat(F.lit(f"{seed}#"), F.coalesce("source", F.lit("null"))))
    totals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n")), weights, budget, most)
    totals = cut(totals.select(key.alias("_k"), "source_size", "target", offset.alias("_z"), "_n"), "targets", rows)
    few = totals.count() <= SOURCES
    draw = unit(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    keyed = sized.withColumn("_k", key).withColumn("_d", draw).drop("source")
    dealt = keyed.join(F.broadcast(totals.drop("_n")), "_k") if few else join_hot(keyed, totals, "_k", rows, HOT)
    is_large = F.col("size") * large > F.col("source_size")

    folded = fold_large(dealt.where(is_large), most)
    first = folded.select("source_size", "target", F.explode_outer(F.arrays_zip("rows", "copies")).alias("x"))
    first = first.select(F.col("x.rows._own").alias("_own"), F.col("x.rows.doc_id").alias("doc_id"), (-F.col("x.rows.s")).alias("size"), "source_size", "target", F.col("x.copies").alias("copies"))

    # The others: one expectation for each source; hash order inside a class, the bucket being its leading part.
    state = totals.join(folded.select("_k", "left", "rest", "upto"), "_k", "left")
    rest = F.coalesce("rest", "source_size")
    even = F.when(rest > 0, expected(F.coalesce("left", "target"), rest, most)).when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    state = state.select("_k", "source_size", "target", "_z", even.alias("_e"), F.coalesce("upto", F.lit(0.0)).alias("_u"))
    buckets = parts_for(rows, bucket_rows)
    small = dealt.where(~is_large).select("_own", "doc_id", "size", "_k", "_d", (-size_class(F.col("size"))).cast("int").alias("_c"), F.floor(F.col("_d") * buckets).cast("int").alias("_b"))
    before = Window.partitionBy("_k").orderBy("_c", "_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small.groupBy("_k", "_c", "_b").count().withColumn("_o", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count").join(state, "_k")
    place = F.row_number().over(Window.partitionBy("_k", "_c", "_b").orderBy("_d", "doc_id", "size", "_own"))
    ranked = small.withColumn("_r", place).join(offsets, ["_k", "_c", "_b"])
    at = F.col("_o") + F.col("_r")
    upto = lambda k: F.col("_u") + k * F.col("_e") + F.col("_z")
    second = ranked.select("_own", "doc_id", "size", "source_size", "target", (F.floor(upto(at)) - F.floor(upto(at - 1))).cast("long").alias("copies"))

    out = first.unionByName(second)
    return out.select(*([F.col("_own").alias(row)] if row else []), "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. How often is told to the texts where they lie."""
    tagged, row = numbered(docs, "rows")
    copies = mix(tagged, seed, row=row).where("copies > 0").select(F.col(row).alias("row"), F.col("copies").cast("int").alias("times"))
    out, told = times(tagged, row, cut(copies, "copies", tagged.count()))
    (copy,) = free(out, "_copy")
    return out.where(F.col(told) > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(told))).alias(copy)).drop(copy)
