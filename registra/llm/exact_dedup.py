"""Exact deduplication through a log-structured merge index.

Every task keeps a memtable of (digest, smallest identifier, count). A full memtable is flushed as one sorted run for each
shard of the digest space, with a Bloom filter beside it. Runs are written to shared storage; compaction merges the runs of
a shard, a bounded number at a time and level by level, and keeps the smallest identifier of each digest. Documents are then
looked up in the compacted index, and every hit is verified byte for byte against the text of the document that stays.

Under ``keep="largest"`` the index orders identifiers the other way round, so that the smallest entry is the largest id.

Defined results
  * null text counts as the empty text; texts are equal when identical after lower-casing A-Z;
  * a null id is later than every id; if a group has only null ids, keep_id is null;
  * rows repeated under one id are members of one group, all of them kept if that id stays;
  * an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.llm.common import ascii_lower, cut, discard, frozen, parts_for

MEMTABLE_ROWS = 32_768
FAN_IN = 16
SHARD_ROWS = 400_000
BROADCAST_HITS = 200_000
SALT_ROWS = 4_096
NO_ID = np.iinfo(np.int64).max

RUN = pa.schema([("shard", pa.int32()), ("seq", pa.int64()), ("n", pa.int64()), ("digests", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary()), ("filter", pa.binary())])
RUN_DDL = "shard int, seq long, n long, digests binary, ids binary, counts binary, filter binary"


class Bloom:
    """A filter with 10 bits and 7 probes an entry; probes are taken from the digest itself."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def probes(digests: np.ndarray, size: int) -> np.ndarray:
        words = digests.view("<u8").reshape(len(digests), -1)
        a, b = words[:, 0], words[:, -1] | np.uint64(1)
        with np.errstate(over="ignore"):
            return (a[:, None] + b[:, None] * np.arange(7, dtype=np.uint64)) % np.uint64(size)

    @classmethod
    def of(cls, digests: np.ndarray) -> Bloom:
        size = max(64, 10 * len(digests))
        flags = np.zeros(size, bool)
        flags[cls.probes(digests, size).ravel()] = True
        return cls(flags)

    def may_hold(self, digests: np.ndarray) -> np.ndarray:
        return self.bits[self.probes(digests, len(self.bits))].all(axis=1)

    def to_bytes(self) -> bytes:
        return len(self.bits).to_bytes(8, "little") + np.packbits(self.bits).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Bloom:
        size = int.from_bytes(data[:8], "little")
        return cls(np.unpackbits(np.frombuffer(data, np.uint8, offset=8))[:size].astype(bool))


class Memtable:
    """Entries by digest until the table is full; flush() gives sorted runs and empties it."""

    def __init__(self, shards: int):
        self.shards, self.entries = shards, {}

    def put(self, digest: bytes, rank: int) -> None:
        old = self.entries.get(digest)
        self.entries[digest] = (rank, 1) if old is None else (min(old[0], rank), old[1] + 1)

    def flush(self, seq: int) -> Iterator[tuple]:
        cuts: dict[int, list[bytes]] = {}
        for digest in sorted(self.entries):
            cuts.setdefault(shard_of(digest, self.shards), []).append(digest)
        for shard, keys in cuts.items():
            found = [self.entries[k] for k in keys]
            yield run_row(shard, seq, keys, [x[0] for x in found], [x[1] for x in found])
        self.entries = {}


def shard_of(digest: bytes, shards: int) -> int:
    return int.from_bytes(digest[:6], "big") * shards >> 48


def run_row(shard: int, seq: int, digests: list[bytes], ranks: list[int], counts: list[int]) -> tuple:
    flat = b"".join(digests)
    return shard, seq, len(digests), flat, np.array(ranks, np.int64).tobytes(), np.array(counts, np.int64).tobytes(), Bloom.of(as_rows(flat)).to_bytes()


def as_rows(flat: bytes) -> np.ndarray:
    return np.frombuffer(flat, np.uint8).reshape(-1, 32)


def flusher(shards: int, memtable_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, flushed = Memtable(shards), 0
        # A run's number comes from its content alone, so a task that runs again writes the same run.
        for batch in batches:
            for digest, rank in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table.put(digest, rank)
                if len(table.entries) >= memtable_rows:
                    yield from write(table)
        if table.entries:
            yield from write(table)

    def write(table: Memtable) -> Iterator[pa.RecordBatch]:
        seq = int.from_bytes(hashlib.blake2b(b"".join(sorted(table.entries)[:64]), digest_size=7).digest(), "big")
        rows = list(table.flush(seq))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RUN, strict=True)], schema=RUN)

    return run


def merged(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray, Bloom]]) -> tuple[list[bytes], list[int], list[int]]:
    """One sorted run from several. Entries that no other run's filter may hold go through as they are; the rest are merged."""
    alone: list[Iterator] = []
    shared: list[Iterator] = []
    for i, (digests, ranks, counts, _) in enumerate(runs):
        hit = np.zeros(len(digests), bool)
        for j, other in enumerate(runs):
            if i != j:
                hit |= other[3].may_hold(digests)
        items = list(zip([d.tobytes() for d in digests], ranks.tolist(), counts.tolist(), strict=True))
        alone.append([x for x, h in zip(items, hit, strict=True) if not h])
        shared.append([x for x, h in zip(items, hit, strict=True) if h])
    folded: list[tuple] = []
    for digest, rank, count in heapq.merge(*shared):
        if folded and folded[-1][0] == digest:
            folded[-1] = (digest, min(folded[-1][1], rank), folded[-1][2] + count)
        else:
            folded.append((digest, rank, count))
    out = list(heapq.merge(folded, *alone))
    return [x[0] for x in out], [x[1] for x in out], [x[2] for x in out]


def compactor(pdf: pd.DataFrame) -> pd.DataFrame:
    runs = [(as_rows(d), np.frombuffer(i, np.int64), np.frombuffer(c, np.int64), Bloom.from_bytes(f)) for d, i, c, f in zip(pdf["digests"], pdf["ids"], pdf["counts"], pdf["filter"], strict=True)]
    row = run_row(int(pdf["shard"].iloc[0]), int(pdf["seq"].min()), *merged(runs))
    return pd.DataFrame([row], columns=RUN.names)


def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d, i, c in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("digests", "ids", "counts")), strict=True):
            keys, ranks, counts = [x.tobytes() for x in as_rows(d)], np.frombuffer(i, np.int64), np.frombuffer(c, np.int64)
            for k in range(0, len(keys), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 8192], pa.binary()), pa.array(ranks[k : k + 8192]), pa.array(counts[k : k + 8192])], names=["digest", "rank", "n"])


def build_index(digests: DataFrame, rows: int, memtable_rows: int = MEMTABLE_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """The compacted index of (digest, rank) rows as (digest, smallest rank, n)."""
    shards = parts_for(rows, SHARD_ROWS)
    runs = cut(digests.mapInArrow(flusher(shards, memtable_rows), RUN_DDL), "lsm-l0", rows)
    level = 0
    while True:
        most = runs.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            break
        groups = parts_for(most, fan_in)
        level += 1
        bounded = runs.withColumn("_g", F.pmod(F.col("seq"), F.lit(groups))) if groups > 1 else runs.withColumn("_g", F.lit(0))
        lower = runs
        runs = cut(bounded.groupBy("shard", "_g").applyInPandas(compactor, RUN_DDL), f"lsm-l{level}", rows)
        discard(lower)
    return runs.mapInArrow(entries, "digest binary, rank long, n long")


def exact_dedup(docs: DataFrame, keep: str = "smallest", memtable_rows: int = MEMTABLE_ROWS, fan_in: int = FAN_IN, digest: Column | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. ``digest`` replaces SHA-256 (32 bytes), for tests of collisions."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep}")
    spark = docs.sparkSession
    texts = frozen(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_text"))
    sha = F.sha2(F.col("_text").cast("binary"), 256)
    digest = F.unhex(sha) if digest is None else digest
    # Under "largest", ~id turns the order round without overflow; no id has the last rank either way.
    rank = F.coalesce(F.col("doc_id") if keep == "smallest" else F.bitwise_not("doc_id"), F.lit(int(NO_ID)))
    rows = docs.count()
    keyed = cut(texts.select("doc_id", sha.alias("text_sha256"), digest.alias("_digest"), rank.alias("_rank")), "digests", rows)
    index = build_index(keyed.select("_digest", "_rank"), rows, memtable_rows, fan_in)
    looked = cut(keyed.join(index.withColumnRenamed("digest", "_digest"), "_digest").drop("_rank"), "looked-up", rows)
    discard(keyed)
    id_of = F.when(F.col("rank") != int(NO_ID), F.col("rank") if keep == "smallest" else F.bitwise_not("rank"))

    # Hits only: texts of documents that are alone are never moved.
    hits = looked.where("n > 1").select("doc_id", "rank", "n", "_digest")
    n_hits = hits.count()
    if n_hits:
        small = lambda df: F.broadcast(df) if n_hits <= BROADCAST_HITS else df
        salts = F.expr(f"greatest(1, cast(ceil(n / {SALT_ROWS}) as int))")
        member = (
            texts.withColumn("_rank", rank)
            .join(small(hits.select(F.coalesce("doc_id", F.lit(None).cast("long")).alias("_id"), "rank", "n", "_digest").distinct()), F.expr("doc_id <=> _id"))
            .where(F.expr("true") if digest is None else digest == F.col("_digest"))
        )
        keeper = member.where("_rank = rank").dropDuplicates(["_digest"]).select(F.col("_digest"), F.col("_text").alias("_kept"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"))
        bad = member.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), salts).cast("int")).join(keeper, ["_digest", "_salt"]).where("_text != _kept").select("_digest").distinct()
        bad = cut(bad, "collisions", n_hits)
        if bad.count():
            return resolved(texts, looked, bad, digest, rank, id_of, spark)
    return looked.select("doc_id", id_of.alias("keep_id"), F.col("n").alias("group_size"), F.expr("doc_id").eqNullSafe(id_of).alias("kept"), "text_sha256")


def resolved(texts: DataFrame, looked: DataFrame, bad: DataFrame, digest: Column, rank: Column, id_of: Column, spark) -> DataFrame:
    """Where verification found unequal texts under one digest, those groups alone are cut again by their whole texts."""
    wrong = texts.withColumn("_digest", digest).withColumn("_rank", rank).join(bad, "_digest")
    own = wrong.groupBy("_digest", "_text").agg(F.min("_rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    redone = wrong.join(own, ["_digest", "_text"]).withColumn("text_sha256", F.sha2(F.col("_text").cast("binary"), 256))
    rest = looked.join(bad, "_digest", "left_anti")
    shape = ["doc_id", "rank", "n", "text_sha256"]
    return rest.select(shape).unionByName(redone.select(shape)).select("doc_id", id_of.alias("keep_id"), F.col("n").alias("group_size"), F.expr("doc_id").eqNullSafe(id_of).alias("kept"), "text_sha256")
