"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A document descends region, rack and shard. At each level every child draws -ln(u) / weight, with u hashed from the document
and the child's name, and the smallest draw wins. So a child whose weight changes gains or loses documents itself and no
document moves between its siblings; movement stays inside subtrees whose weights change. A shard that is added later opens
a region of its own, hence it takes documents only into itself, whatever the tree above looks like.

Slots are gapless places in a shard, by (bucket, doc_id): rows are counted by shard and hash bucket, the counts are
prefix-summed, and only rows of one bucket are ever sorted together, so no task holds a whole shard.

Defined results
  * null text: size is 16 and the checksum is that of the empty text; rows of a null id go to one shard;
  * repeated rows get slots of their own; equal rows may swap slots; an empty table gives no rows;
  * extra columns are ignored; add_shard() keeps them, but for columns named shard or slot, which it replaces. With the ``key`` law equal texts of different ids may part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from registra.llm.common import free, frozen, parts_for

SHARDS = 40
#: Rows of all shards that share a hash bucket.
BUCKET_ROWS = 2_000_000


@dataclass(frozen=True)
class Node:
    """A subtree with its weight; a leaf has a shard."""

    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int = -1


def inner(name: str, children: list[Node]) -> Node:
    return Node(name, sum(c.weight for c in children), tuple(children))


def build_tree(shards: int, base: int = SHARDS, per_rack: int = 4, racks: int = 2, weights: dict[int, float] | None = None) -> Node:
    """Shards below ``base`` fill regions of ``racks`` racks; each later one opens its own region. The count and the weights decide everything."""
    leaf = lambda i: Node(f"s{i}", (weights or {}).get(i, 1.0), shard=i)
    chunk = lambda xs, n: [xs[i : i + n] for i in range(0, len(xs), n)]
    rack_nodes = [inner(f"k{i}", [leaf(s) for s in r]) for i, r in enumerate(chunk(range(min(shards, base)), per_rack))]
    regions = [inner(f"r{i}", ks) for i, ks in enumerate(chunk(rack_nodes, racks))]
    grown = [inner(f"g{i}", [inner(f"gk{i}", [leaf(i)])]) for i in range(base, shards)]
    return inner("root", [*regions, *grown])


def draw(key: Column, child: Column) -> Column:
    """An exponential draw with the child's weight as its rate; u is in (0, 1]."""
    bits = F.shiftrightunsigned(F.xxhash64(child["name"], key), 11)
    return -F.log((bits.cast("double") + 1.0) / float(2**53)) / child["weight"]


def descend(key: Column, root: Node) -> Column:
    """The shard: level by level, the children of the node that has won draw against one another. The tree is a literal."""
    inner_nodes, depth, todo = [root], 0, [(root, 0)]
    rows: list[str] = []
    for node, level in todo:
        depth = max(depth, level + 1)
        cells = []
        for c in node.children:
            if c.weight > 0:
                if c.children:
                    inner_nodes.append(c)
                    todo.append((c, level + 1))
                cells.append(f"struct({len(inner_nodes) - 1 if c.children else -1 - c.shard} AS to, '{c.name}' AS name, {float(c.weight)!r}D AS weight)")
        rows.append(f"array({', '.join(cells)})")
    children = F.expr(f"array({', '.join(rows)})")
    at = F.lit(0)
    for _ in range(depth):
        # A place below 0 is a shard already.
        best = lambda at: F.array_min(F.transform(F.get(children, at), lambda c: F.struct(draw(key, c).alias("d"), c["to"].alias("to"))))["to"]
        at = F.coalesce(best(at), at) if _ else best(at)
    return -1 - at


def slots(df: DataFrame, by: str, order: list[str], rows: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds slot: gapless from 0 in each value of ``by``."""
    buckets = parts_for(rows, bucket_rows)
    b, r, o = free(df, "_b", "_r", "_o")
    dealt = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(by).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(by, b).agg(F.count(F.lit(1)).alias(r))
    offsets = counts.withColumn(o, F.coalesce(F.sum(r).over(before), F.lit(0))).drop(r)
    rank = F.row_number().over(Window.partitionBy(by, b).orderBy(*order))
    return dealt.withColumn(r, rank).join(offsets, [by, b]).withColumn("slot", (F.col(o) + F.col(r) - 1).cast("long")).drop(b, r, o)


def shard_documents(docs: DataFrame, shards: int = SHARDS, base: int = SHARDS, weights: dict[int, float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = frozen(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = F.col("doc_id")
    placed = rows.withColumn("shard", descend(key, build_tree(shards, base, weights=weights)).cast("int")).withColumn("grown_shard", descend(key, build_tree(shards + 1, base, weights=weights)).cast("int"))
    out = slots(placed, "shard", ["doc_id", "text_crc32", "size"], docs.count())
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def add_shard(docs: DataFrame, shards: int = SHARDS, base: int = SHARDS) -> DataFrame:
    """``docs`` as it is, with shard and slot beside its columns."""
    (whole,) = free(docs, "_h")
    # Rows of one id, or of none, are told apart by a hash of the row, so that they share no bucket unless they are equal.
    hashable = [f.name for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    tagged = docs.withColumn(whole, F.xxhash64(*[docs[c] for c in hashable])).withColumn("shard", descend(F.col("doc_id").cast("long"), build_tree(shards, base)).cast(T.IntegerType()))
    return slots(tagged, "shard", ["doc_id", whole], docs.count()).drop(whole)
