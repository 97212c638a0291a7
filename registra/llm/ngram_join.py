"""N-gram Jaccard self-join by T-occurrence search with DivideSkip, for sets of five-word shingles.

Documents with one shingle set are a class, known by the set's 128-bit digest and numbered when written; one representative
stands for it. Two sets of sizes a and b are linked when their Jaccard similarity is at least t, so they share at least
ceil(t * max(a, b)) shingles (T, the required occurrence count).

1. Thinning. Each class posts its smallest hashes (a share of its set that leaves a slack over the prefix that t needs).
   Postings meet by hash; a class goes on only if enough of what it posted lies in lists of two or more.
2. Index. The remaining classes post their whole sets. A class stays while at least T of its shingles lie in lists of two or
   more. These shingles are its core: whatever it shares with any other class lies there.
3. Nodes. Classes with one core are compared with the smallest of them only: what they share is the core, so a class that is
   linked with any of them is linked with that one. The smallest, and those not linked with it, are nodes that go on.
4. Hubs. In each of a node's shorter lists it is checked against the most central member, the one that most of its shingles
   share with others. Components of these links are formed.
5. DivideSkip, for pairs that are still apart. A query is a node; candidates are nodes of larger components (or equal ones of
   smaller name), so one of two nodes asks. Of a query's lists the L longest, L = T / (MU * log2(longest) + 1), are set aside.
   The others, sorted by candidate, are heap-merged with skips, and candidates that occur T - L times or more are retained;
   the long lists are then probed for each of them by binary search, which gives the exact overlap. Entries whose sizes allow
   no link with the query are left out before the merge.

Nothing is capped or sampled: lists of every length take part, and all sets are whole. Lists are cut into pieces by candidate,
and a long list's pieces are dealt to several tasks of queries. Texts are not shuffled, unless more than ``BROADCAST_IDS``
classes go on after thinning: the texts that are read again are then picked by a shuffled join. Shingles are 64-bit hashes.
Thinning counts under 63 bits of the digest, where two classes that share a name can only make it keep more.

Defined results
  * null texts and texts without words have an empty set, size 0, and are linked with nothing;
  * a text of one to four words is a single shingle; equal sets are linked even when the texts differ;
  * every row is a document: rows repeated under one id with one text share a component, with different texts they are linked
    by their texts only; a class that has null ids only is linked with nothing and has component_id null;
  * very long texts are hashed in stretches; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registra.llm.common import HEAVY, cut, discard, frozen, join_first, join_hot, numbered, parts_for, temporary, times, u64
from registra.llm.components import components
from registra.llm.shingles import set_digest, shingles

WORDS = 5
SIMILARITY = (75, 100)
#: Share of a set that is posted for thinning beyond the prefix; any value gives the same links.
SLACK = 0.15
#: Postings that an index bucket is meant for, and members of a list that are compared in one block.
POSTINGS = 800_000
#: Postings of a bucket that are in memory at once; a list of ``1 / LONG`` of them leaves with the length ENDLESS.
HELD = 3_200_000
LONG = 64
ENDLESS = np.iinfo(np.int32).max
#: Entries of a list that one piece is meant for, and queries that meet them at once; pieces of one list at most.
BLOCK = 2_048
MOST_PIECES = 64
#: DivideSkip's weight of a probe against a merge step.
MU = 0.01
HOT = 1_000
CHUNK_POSTINGS = 400_000
#: Classes whose counts one task adds up.
GROUP_CLASSES = 50_000
#: Ids that are broadcast to pick texts by; more of them are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def required(n, num: int, den: int):
    """T for a set of n: what it must share with any partner."""
    return -(-n * num // den)


def overlap(a, b, num: int, den: int):
    """What two sets of these sizes must share."""
    return -(-num * (a + b) // (num + den))


def thin_name(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big") >> 1


def set_rows(words: int):
    """doc_id, text -> doc_id, n, dig and thin (a class's digest and its name while thinning), in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(s), set_digest(s)) for s in (shingles(x.as_py(), words) for x in batch.column(1))]
            n, dig = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(dig, pa.binary()), pa.array([thin_name(x) for x in dig], pa.int64())], names=["doc_id", "n", "dig", "thin"])

    return run


def by_bucket(hs: list[np.ndarray], ids: list, buckets: int) -> pa.RecordBatch:
    """Postings (hash, class, or a row of numbers that starts with it) packed by bucket of the hash space."""
    h, d = np.concatenate(hs), np.repeat(np.array(ids, np.int64), [len(x) for x in hs], axis=0)
    b = bucket_of(h, buckets)
    order = np.argsort(b, kind="stable")
    h, d, b = h[order], d[order], b[order]
    at = np.concatenate(([0], np.flatnonzero(np.diff(b)) + 1, [len(b)]))
    cutter = lambda x: pa.array([x[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(b[at[:-1]].astype(np.int32)), cutter(h), cutter(d)], names=["bucket", "h", "d"])


PACKED = "bucket int, h binary, d binary"


def post_texts(words: int, buckets: int, share):
    """text -> postings of a share of each set. A class that a task has just posted is not posted again; others are told apart in the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ids, size, seen = [], [], 0, set()
        for batch in batches:
            for text in batch.column(0):
                found = shingles(text.as_py(), words)
                if not len(found) or (cls := thin_name(set_digest(found))) in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(cls)
                hs.append(found[: share(len(found))])
                ids.append(cls)
                size += len(hs[-1])
                if size >= CHUNK_POSTINGS:
                    yield by_bucket(hs, ids, buckets)
                    hs, ids, size = [], [], 0
        if hs:
            yield by_bucket(hs, ids, buckets)

    return run


def post_sets(buckets: int):
    """A packed set and one or more numbers -> postings of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ids, size = [], [], 0
        for batch in batches:
            for s, *own in zip(*(c if i == 0 else c.to_pylist() for i, c in enumerate(batch.columns)), strict=True):
                hs.append(u64(s.as_py()))
                ids.append(own[0] if len(own) == 1 else own)
                size += len(hs[-1])
                if size >= CHUNK_POSTINGS:
                    yield by_bucket(hs, ids, buckets)
                    hs, ids, size = [], [], 0
        if hs:
            yield by_bucket(hs, ids, buckets)

    return run


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """By the middle bits: the smallest hashes of a set are a share of it that the top bits would crowd into few buckets."""
    return ((h & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def distinct(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings by (hash, class), each once, with the lengths of their lists."""
    cls = d if d.ndim == 1 else d[:, 0]
    order = np.lexsort((cls, h))
    h, d, cls = h[order], d[order], cls[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (cls[1:] == cls[:-1])
    h, d = h[~again], d[~again]
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
    length = np.diff(np.concatenate((at, [len(h)])).astype(np.int64))
    return h, d, np.repeat(length, length)


def lists(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings in lists of two or more: hash, class and list length, by (hash, class)."""
    order = np.argsort(h, kind="stable")
    h, d = h[order], d[order]
    # Hashes that stand alone, most of them, go before the classes are sorted too.
    more = np.zeros(len(h), bool)
    same = h[1:] == h[:-1]
    more[1:] |= same
    more[:-1] |= same
    h, d, full = distinct(h[more], d[more])
    return h[full > 1], d[full > 1], full[full > 1]


class Bucket:
    """The postings of one bucket as they stream in. Memory is bounded however long a list is.

    A list that holds ``1 / LONG`` of what the bucket may hold is a long one: its postings leave at once, as do all that still
    come, and its length is said to be ENDLESS for every member. DivideSkip needs one order of hashes for all queries and the
    fact that a list has two members or more, both of which this gives. Rows come in one order, so a task that runs again finds the same
    lists long. A class may be posted twice for a long list of the thinning step; it is then counted twice, which keeps it.
    """

    def __init__(self, held: int):
        self.held = self.limit = held
        self.h, self.d, self.size = [], [], 0
        self.long, self.far, self.far_size = np.empty(0, np.uint64), [], 0

    def add(self, h: np.ndarray, d: np.ndarray) -> Iterator[tuple]:
        if len(self.long):
            far = np.isin(h, self.long)
            yield from self.leave(h[far], d[far])
            h, d = h[~far], d[~far]
        self.h.append(h)
        self.d.append(d)
        self.size += len(h)
        if self.size > self.limit:
            h, d, full = distinct(np.concatenate(self.h), np.concatenate(self.d))
            far = full * LONG >= self.held
            self.long = np.union1d(self.long, h[far])
            yield from self.leave(h[far], d[far])
            self.h, self.d = [h[~far]], [d[~far]]
            self.size = len(self.h[0])
            self.limit = max(self.held, 2 * self.size)

    def leave(self, h: np.ndarray, d: np.ndarray) -> Iterator[tuple]:
        if len(h):
            self.far.append((h, d))
            self.far_size += len(h)
        if self.far_size > self.held // 4:
            yield self.gone()

    def gone(self) -> tuple:
        h, d, _ = distinct(*(np.concatenate(x) for x in zip(*self.far, strict=True)))
        self.far, self.far_size = [], 0
        return h, d, np.full(len(h), ENDLESS)

    def finish(self) -> Iterator[tuple]:
        if self.far_size:
            yield self.gone()
        if self.size:
            yield lists(np.concatenate(self.h), np.concatenate(self.d))


def by_lists(use, held: int, width: int = 1):
    """Packed postings in order of bucket -> what ``use`` makes of each bucket's lists of two or more (hash, class, length)."""

    def used(pieces: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for x in pieces:
            if len(x[0]) and (out := use(*x)) is not None:
                yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bucket = None, Bucket(held)
        for batch in batches:
            for b, h, d in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if b != at:
                    yield from used(bucket.finish())
                    at, bucket = b, Bucket(held)
                d = np.frombuffer(d.as_py(), np.int64)
                yield from used(bucket.add(u64(h.as_py()), d if width == 1 else d.reshape(-1, width)))
        yield from used(bucket.finish())

    return run


def bucketed(packed: DataFrame, buckets: int) -> DataFrame:
    """Postings by bucket, and within a bucket in an order that their content alone decides."""
    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "d", "h")


def runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start and end."""
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return at, np.concatenate((at[1:], [len(x)])).astype(np.int64)


def cut_up(x: np.ndarray, at: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.array([x[s:e].tobytes() for s, e in zip(at, ends, strict=True)], pa.binary())


def shared_counts(groups: int):
    """How many of each class's postings lie in these lists, packed by group of classes."""

    def use(h: np.ndarray, d: np.ndarray, full: np.ndarray) -> pa.RecordBatch:
        ids, counts = np.unique(d, return_counts=True)
        order = np.argsort(ids % groups, kind="stable")
        ids, counts = ids[order], counts[order].astype(np.int32)
        at, ends = runs_of(ids % groups)
        return pa.RecordBatch.from_arrays([pa.array((ids % groups)[at]), cut_up(ids, at, ends), cut_up(counts, at, ends)], names=["g", "d", "c"])

    return use


def add_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, at = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in pdf["d"]]), return_inverse=True)
    return pd.DataFrame({"cls": ids, "c": np.bincount(at, np.concatenate([np.frombuffer(x, np.int32) for x in pdf["c"]])).astype(np.int64)})


def shared_per_class(postings: DataFrame, rows: int) -> DataFrame:
    """(cls, c): counts leave a bucket packed and are added up by group of classes, a row for each class at the end."""
    counts = postings.mapInArrow(by_lists(shared_counts(parts_for(rows, GROUP_CLASSES, 2)), HELD), "g long, d binary, c binary")
    return counts.groupBy("g").applyInPandas(add_counts, "cls long, c long")


def lists_by_class(h: np.ndarray, d: np.ndarray, full: np.ndarray) -> pa.RecordBatch:
    """The index, turned: for each class its hashes in these lists, with the lists' lengths."""
    order = np.argsort(d, kind="stable")
    h, d, full = h[order], d[order], full[order].astype(np.int32)
    at, ends = runs_of(d)
    return pa.RecordBatch.from_arrays([pa.array(d[at]), cut_up(h, at, ends), cut_up(full, at, ends)], names=["cls", "h", "len"])


def set_of_class(words: int):
    """text, cls, dig -> cls, n, s: the whole set as packed sorted hashes, where the text is the class's own and not another of its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x.as_py(), words) for x in batch.column(0)]
            own = [set_digest(x) == d for x, d in zip(found, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["cls", "n", "s"]).filter(pa.array(own, pa.bool_()))

    return run


NODE = "cls long, n long, m long, core binary, h binary, len binary"


def cores(num: int, den: int):
    """A class's pieces of the turned index -> its core, sorted, with list lengths, size m and digest; classes of less than T go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cls, n, hs, lens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                h, length = u64(b"".join(hs.as_py())), np.frombuffer(b"".join(lens.as_py()), np.int32)
                if len(h) >= required(n, num, den):
                    order = np.argsort(h)
                    h, length = h[order], length[order]
                    rows.append((cls, n, len(h), set_digest(h), h.tobytes(), length.tobytes()))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["cls", "n", "m", "core", "h", "len"])

    return run


SHORTER = "h long, cls long, n long, mid double"


def shorter_lists(num: int, den: int):
    """A node -> its lists but for the T - 1 longest, any of which two linked nodes must share; ``mid`` says how central it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for cls, n, hs, lens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                h, length = np.frombuffer(hs.as_py(), np.int64), np.frombuffer(lens.as_py(), np.int32)
                pick = np.lexsort((h, length))[: len(h) - required(n, num, den) + 1]
                for o, v in zip(out, (h[pick], np.full(len(pick), cls), np.full(len(pick), n), np.full(len(pick), np.log(length).sum() / n)), strict=True):
                    o.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["h", "cls", "n", "mid"])

    return run


def shared_by(x: np.ndarray, y: np.ndarray) -> int:
    """How many hashes two sorted arrays share: those of the shorter one are looked up in the longer by binary search."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def probe(num: int, den: int):
    """Pairs (a, b, sizes, cores) -> those that reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for na, nb, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                ok.append(shared_by(u64(x.as_py()), u64(y.as_py())) >= overlap(na, nb, num, den))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def verified(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    left = nodes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("h").alias("ha"))
    right = nodes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("h").alias("hb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "na", "nb", "ha", "hb").mapInArrow(probe(num, den), "a long, b long")


def most(n, m, num: int, den: int):
    """The largest set that one of n shingles, m of them in its core, can be linked with."""
    return (num + den) * m // num - n


def foreign_counts(groups: int):
    """shared_counts() for lists that hold more than one component; the component travels as the second column of ``d``."""
    count = shared_counts(groups)

    def use(h: np.ndarray, d: np.ndarray, full: np.ndarray) -> pa.RecordBatch | None:
        at, ends = runs_of(h)
        mixed = (np.minimum.reduceat(d[:, 1], at) != np.maximum.reduceat(d[:, 1], at)) | (full[at] == ENDLESS)
        pick = np.repeat(mixed, ends - at)
        return count(h[pick], d[pick, 0], full[pick]) if pick.any() else None

    return use


def split_lists(num: int, den: int):
    """A query -> (T, L, its L longest lists, the others)."""

    def divide(n: int, h: np.ndarray, length: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
        t = required(n, num, den)
        skip = min(t - 1, int(t / (MU * math.log2(max(2, int(length.max()))) + 1)))
        order = np.lexsort((h, length))
        return t, skip, h[order[len(order) - skip :]], h[order[: len(order) - skip]]

    return divide


def pieces_of(length: np.ndarray) -> np.ndarray:
    """To how many tasks the queries of a list are dealt; its length, which all its members know, decides."""
    return np.clip(-(-length.astype(np.int64) // BLOCK), 1, MOST_PIECES)


POSTING = "h long, parts int, cls long, n long, top long, comp long, size long"


def post_nodes(num: int, den: int, queries: bool):
    """Nodes (cls, n, m, comp, size, h, len) -> one row for each list, of all lists or of those that a query merges."""
    divide = split_lists(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for cls, n, m, comp, size, hs, lens in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                h, length = u64(hs), np.frombuffer(lens, np.int32)
                if queries:
                    h, keep = np.intersect1d(h, divide(n, h, length)[3], return_indices=True)[:2]
                    length = length[keep]
                row = (h.view(np.int64), pieces_of(length).astype(np.int32), *(np.full(len(h), x, np.int64) for x in (cls, n, most(n, m, num, den), comp, size)))
                for o, v in zip(out, row, strict=True):
                    o.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["h", "parts", "cls", "n", "top", "comp", "size"])

    return run


def candidates_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A query and a piece of one of its lists -> the piece's candidates: of larger components, and of sizes that allow a link."""
    for batch in batches:
        q, rng, n, top, comp, size = (batch.column(i).to_pylist() for i in range(6))
        ids, sizes, tops, comps, lots = (batch.column(i) for i in range(6, 11))
        of, where, found = [], [], []
        for i in range(batch.num_rows):
            d, dn, dtop, dcomp, dsize = (x[i].values.to_numpy() for x in (ids, sizes, tops, comps, lots))
            ok = ((dsize > size[i]) | (dsize == size[i]) & (dcomp < comp[i])) & (dn <= top[i]) & (dtop >= n[i])
            if ok.any():
                of.append(q[i])
                where.append(rng[i])
                found.append(np.sort(d[ok]).tobytes())
        if of:
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(where, pa.int32()), pa.array(found, pa.binary())], names=["q", "rng", "d"])


def merge_skip(lists: list[list[int]], need: int) -> list[tuple[int, int]]:
    """(value, count) of the values that ``need`` of these ascending lists hold. The lists' heads are on a heap; if the smallest
    head is on too few lists, enough heads are popped that no value below the next one can be on ``need`` lists, and the
    popped lists skip to it by binary search."""
    at, out = [0] * len(lists), []
    heap = [(x[0], i) for i, x in enumerate(lists) if x]
    heapify(heap)
    while len(heap) >= need:
        value, popped = heap[0][0], []
        while heap and heap[0][0] == value:
            popped.append(heappop(heap)[1])
        if len(popped) >= need:
            out.append((value, len(popped)))
            for i in popped:
                at[i] += 1
        else:
            while heap and len(popped) < need - 1:
                popped.append(heappop(heap)[1])
            if not heap:
                break
            for i in popped:
                at[i] = bisect_left(lists[i], heap[0][0], at[i])
        for i in popped:
            if at[i] < len(lists[i]):
                heappush(heap, (lists[i][at[i]], i))
    return out


def occurrences(num: int, den: int):
    """Queries (q, n, h, len, lists of candidates) -> (q, d, c) for candidates on T - L short lists or more, c of them."""
    divide = split_lists(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            qs, ds, cs = [], [], []
            for q, n, h, lens, lists in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                t, skip, _, _ = divide(n, u64(h), np.frombuffer(lens, np.int32))
                for d, c in merge_skip([np.frombuffer(x, np.int64).tolist() for x in lists], t - skip):
                    qs.append(q)
                    ds.append(d)
                    cs.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (qs, ds, cs)], names=["a", "b", "c"])

    return run


def probe_long(num: int, den: int):
    """Candidates (a, b, c, sizes, lists of the query, core of the candidate) -> links; the candidate is looked up in each of the L long lists."""
    divide = split_lists(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for c, na, nb, ha, la, hb in zip(*(batch.column(i).to_pylist() for i in range(2, 8)), strict=True):
                long = np.sort(divide(na, u64(ha), np.frombuffer(la, np.int32))[2])
                ok.append(c + shared_by(long, u64(hb)) >= overlap(na, nb, num, den))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def divide_skip(nodes: DataFrame, rows: int, postings: int, num: int, den: int) -> DataFrame:
    """(a, b): all links between nodes (cls, n, m, h, len, comp, size) of different components."""
    # Who has T lists with another component in them; most near copies have met already and are done here.
    buckets = parts_for(postings, POSTINGS, 2)
    posted = bucketed(nodes.select("h", "cls", "comp").mapInArrow(post_sets(buckets), PACKED), buckets)
    counts = posted.mapInArrow(by_lists(foreign_counts(parts_for(rows, GROUP_CLASSES, 2)), HELD, 2), "g long, d binary, c binary")
    apart = counts.groupBy("g").applyInPandas(add_counts, "cls long, c long")
    still = cut(nodes.join(apart, "cls").where(F.col("c") * F.lit(den) >= F.col("n") * F.lit(num)).drop("c"), "apart", HEAVY * rows)

    own = still.select("cls", "n", "m", "comp", "size", "h", "len")
    held = own.mapInArrow(post_nodes(num, den, queries=False), POSTING)
    longest = held.groupBy("h").agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0] or 0
    ranges = parts_for(longest, BLOCK)
    # Lists in pieces by candidate: a query meets a candidate in the same range in all its lists.
    pieces = held.withColumn("rng", F.pmod(F.xxhash64("cls"), F.lit(ranges)).cast("int")).groupBy("h", "parts", "rng")
    pieces = pieces.agg(F.collect_list(F.struct("cls", "n", "top", "comp", "size")).alias("e"), F.min("comp").alias("_l"), F.max("comp").alias("_h"), F.min("n").alias("least"))
    pieces = pieces.select("h", "rng", "least", *[F.col(f"e.{c}").alias(f"d_{c}") for c in ("cls", "n", "top", "comp", "size")], F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    asked = own.mapInArrow(post_nodes(num, den, queries=True), POSTING).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    asked = asked.select("h", "part", F.col("cls").alias("q"), "n", "top", "comp", "size")
    met = asked.join(pieces, ["h", "part"]).where("least <= top").select("q", "rng", "n", "top", "comp", "size", "d_cls", "d_n", "d_top", "d_comp", "d_size")
    lists = met.mapInArrow(candidates_in, "q long, rng int, d binary").groupBy("q", "rng").agg(F.collect_list("d").alias("d"))
    query = still.select(F.col("cls").alias("q"), "n", "h", "len")
    found = lists.join(query, "q").select("q", "n", "h", "len", "d").mapInArrow(occurrences(num, den), "a long, b long, c long")
    left = still.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("h").alias("ha"), F.col("len").alias("la"))
    right = still.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("h").alias("hb"))
    return found.join(right, "b").join(left, "a").select("a", "b", "c", "na", "nb", "ha", "la", "hb").mapInArrow(probe_long(num, den), "a long, b long")


def jaccard_links(base: DataFrame, classes: DataFrame, rows: int, postings: int, num: int, den: int, words: int) -> tuple[DataFrame, DataFrame] | None:
    """(a, b): links between numbered classes that connect exactly the pairs at or above the similarity, and the numbered
    classes (cls, dig, rep) themselves. ``classes`` has dig, thin, n and rep, an id."""
    buckets = parts_for(int(postings * (1 - num / den + SLACK)) + rows, POSTINGS, 2)
    share = lambda n: min(n, n - required(n, num, den) + 1 + int(n * SLACK))
    thin = bucketed(base.select("text").mapInArrow(post_texts(words, buckets, share), PACKED), buckets)
    # A set shares 1 + slack of what it posted, or as much as a partner of the smallest allowed size has posted with slack.
    least = F.expr(f"1 + cast(floor(floor(n * {num}D / {den}D) * {SLACK}D) as long)")
    enough = shared_per_class(thin, rows).withColumnRenamed("cls", "thin")
    going = cut(classes.join(enough, "thin").where(F.col("c") >= least).select("rep", "dig").withColumn("cls", F.monotonically_increasing_id()), "going", rows)
    n_going = going.count()
    if n_going < 2:
        return None
    narrow = F.broadcast(going) if n_going <= BROADCAST_IDS else going
    texts = base.join(narrow, F.col("doc_id") == F.col("rep")).select("text", "cls", "dig")
    sets = cut(texts.mapInArrow(set_of_class(words), "cls long, n long, s binary"), "sets", HEAVY * n_going)
    if sets.agg(F.count(F.lit(1)) != F.countDistinct("cls")).first()[0]:  # rows repeated under one id
        sets = cut(sets.dropDuplicates(["cls"]), "sets", HEAVY * n_going)

    # Whole sets: first who has enough in common with others at all, then exact lists of those that are left.
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = parts_for(total, POSTINGS, 2)
    packed = lambda df: bucketed(df.select("s", "cls").mapInArrow(post_sets(buckets), PACKED), buckets)
    enough = sets.select("cls", "n").join(shared_per_class(packed(sets), n_going), "cls").where(F.col("c") * F.lit(den) >= F.col("n") * F.lit(num)).select("cls")
    left = cut(sets.join(enough, "cls"), "left", HEAVY * n_going)
    discard(sets)
    index = packed(left).mapInArrow(by_lists(lists_by_class, HELD), "cls long, h binary, len binary")
    turned = index.groupBy("cls").agg(F.collect_list("h").alias("h"), F.collect_list("len").alias("len")).join(left.select("cls", "n"), "cls").select("cls", "n", "h", "len")
    turned = cut(turned.mapInArrow(cores(num, den), NODE), "cores", HEAVY * n_going)
    discard(left)

    # Classes of one core: those linked with the smallest need no more search.
    alike = join_first(turned.select("core", "n", "cls", "m"), "core", F.struct("n", "cls"), F.struct("n", "cls"), HOT)
    alike = cut(alike.where(F.col("cls") != F.col("first.cls")).where(F.lit(num) * (F.col("n") + F.col("first.n") - F.col("m")) <= F.lit(den) * F.col("m")).select(F.col("first.cls").alias("a"), F.col("cls").alias("b")), "alike", rows)
    nodes = cut(turned.join(alike.select(F.col("b").alias("cls")), "cls", "left_anti").drop("core"), "nodes", HEAVY * n_going)
    discard(turned)
    n_nodes, n_postings = nodes.agg(F.count(F.lit(1)), F.sum("m")).first()
    if n_nodes < 2:
        return alike, going

    shorter = cut(nodes.select("cls", "n", "h", "len").mapInArrow(shorter_lists(num, den), SHORTER), "shorter", 8 * n_nodes)
    best = F.struct(F.col("mid"), -F.col("cls"))
    hub = shorter.groupBy("h").agg(F.max(best).alias("top"), F.max_by("n", best).alias("na"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("h", (-F.col("top")["col2"]).alias("a"), "na", "_n")
    spokes = join_hot(shorter, cut(hub, "hubs", 8 * n_nodes), "h", shorter.count(), HOT).where("cls != a").where(f"least(n, na) * {den} >= greatest(n, na) * {num}").select("a", F.col("cls").alias("b")).distinct()
    first = cut(verified(spokes, nodes, num, den), "links", n_nodes)
    discard(shorter)
    label = cut(components(first, n_nodes), "labels", n_nodes)
    many = cut(label.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "components", n_nodes)
    label = label.join(many, "component").withColumnRenamed("component", "comp")
    placed = nodes.join(label, nodes["cls"] == label["node"], "left").select("cls", "n", "m", "h", "len", F.coalesce("comp", "cls").alias("comp"), F.coalesce("size", F.lit(1)).cast("long").alias("size"))
    second = cut(divide_skip(cut(placed, "placed", HEAVY * n_nodes), n_nodes, n_postings, num, den), "links", n_nodes)
    return alike.union(first.select("a", "b")).union(second), going


def ngram_join(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach) for every row."""
    num, den = similarity
    base = frozen(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_docs = docs.count()
    with temporary() as kept:
        keyed, label = labelled(base, n_docs, num, den, words)
        kept += [keyed, label]
    out = join_hot(keyed, label, "dig", n_docs, HOT, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def labelled(base: DataFrame, n_docs: int, num: int, den: int, words: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, dig) for every row, and (dig, component_id, _n) for every class, both written."""
    keyed = cut(base.mapInArrow(set_rows(words), "doc_id long, n long, dig binary, thin long"), "sets", n_docs)
    classes = keyed.where("n > 0").groupBy("dig").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("thin").alias("thin"), F.count(F.lit(1)).alias("_n")).where("rep is not null")
    rows, postings = classes.agg(F.count(F.lit(1)), F.sum("n")).first()
    classes = cut(classes, "classes", rows)
    links = jaccard_links(base, classes, rows, postings, num, den, words) if rows > 1 else None
    label = classes.select("dig", F.col("rep").alias("component_id"), "_n")
    if links is not None:
        edges, numbered = links
        found = components(edges, rows).withColumnRenamed("node", "cls")
        own = cut(numbered.join(found, "cls").select("dig", "rep", "component"), "linked", rows)
        lowest = F.struct("rep", "dig")
        moved = join_first(own, "component", lowest, lowest, HOT).select("dig", F.col("first.rep").alias("low"))
        label = label.join(moved, "dig", "left").select("dig", F.coalesce("low", "component_id").alias("component_id"), "_n")
    return keyed, cut(label, "label", rows)


def one_of_each_group(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of linked rows one, that of the smallest id, a missing id coming last. Rows without words stay.

    Rows are joined under a 64-bit hash of their place, so that different rows of one id, or of none, are told apart, and equal
    ones too. What goes is told to the texts where they lie: they are not shuffled.
    """
    tagged, row = numbered(docs, "rows")
    tag, key, text = F.xxhash64(F.col(row)), F.col("doc_id").cast("long"), F.col("text").cast("string")
    n = docs.count()
    with temporary() as kept:
        found = ngram_join(tagged.select(tag.alias("doc_id"), text.alias("text")), words, similarity).where("n_shingles > 0").withColumnRenamed("doc_id", "_t")
        # Of rows of one id, the text decides before the place does.
        own = F.xxhash64(key.isNull(), key, text.isNull(), text)
        rows = tagged.select(tag.alias("_t"), F.struct(key.isNull().alias("none"), key.alias("id"), own.alias("own"), F.col(row).alias("row")).alias("r"))
        members = cut(found.join(rows, "_t").select("_t", F.col("component_id").alias("c"), "r"), "members", n)
        first = members.groupBy("c").agg(F.min(F.struct("r", "_t")).alias("m")).select("m._t")
        gone = cut(members.join(first, "_t", "left_anti").select(F.col("r.row").alias("row"), F.lit(1).alias("times")), "gone", n)
        kept.append(gone)
    out, told = times(tagged, row, gone)
    return out.where(F.col(told) == 0).select(*docs.columns)
