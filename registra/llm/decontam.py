"""Benchmark decontamination with Wu-Manber multi-pattern search over words.

Patterns are windows of ``window`` consecutive words of benchmark items. The search slides over a document's words; the last
two words under it are the block. The shift table says how far the block is from the end of any pattern, so positions where
nothing can end are skipped; where it says 0, the bucket of patterns that end with this block is compared word by word.
Patterns are grouped by length, and are searched in groups of bounded size: only one group's tables are sent to executors at
a time, however large the benchmark is. A large item's windows are dealt to several groups. Each group is one pass over the
documents' words.

Defined results
  * null texts have no words; a null item text is no item; a null item id counts as the empty string; items that share an id
    are one item with the windows of all;
  * an item with fewer words than a window is one window; an item without words has none;
  * document rows are kept as they are, repeated ids too; empty tables give no rows, or no hits; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registra.llm.common import cut, frozen

WINDOW = 10
#: Patterns whose tables executors hold at once, some 30 MB.
GROUP = 100_000
#: Bytes that count as parts of words, A-Z folded; all else cuts.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


class WuManber:
    """Patterns (tuples of words) of one length, each with the items it belongs to."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[int]]):
        self.length, self.block = length, min(2, length)
        self.jump = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                key = words[end - self.block : end] if self.block == 2 else words[end - 1]
                self.shift[key] = min(self.shift.get(key, self.jump), length - end)
            self.buckets.setdefault(key, []).append((words, items))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(place of the first word, items) of every occurrence."""
        shift, jump, length, two = self.shift.get, self.jump, self.length, self.block == 2
        at, n = length, len(words)
        while at <= n:
            key = (words[at - 2], words[at - 1]) if two else words[at - 1]
            step = shift(key, jump)
            if step:
                at += step
                continue
            begin = at - length
            here = tuple(words[begin:at])
            for pattern, items in self.buckets[key]:
                if here == pattern:
                    yield begin, items
            at += 1


Pattern = tuple[tuple[bytes, ...], str]


def windows_of(text: str, window: int, known: dict[bytes, bytes]) -> Iterator[tuple[bytes, ...]]:
    """An item's patterns; equal words are one object, so that overlapping windows share them."""
    words = [known.setdefault(w, w) for w in words_of(text)]
    for i in range(max(1, len(words) - window + 1) if words else 0):
        yield tuple(words[i : i + window])


def patterns_of(items: list[tuple[str, str]], window: int) -> list[Pattern]:
    known: dict[bytes, bytes] = {}
    return sorted({(p, item) for item, text in items for p in windows_of(text, window, known)}, key=lambda x: (len(x[0]), x))


def searchers(patterns: list[tuple[tuple[bytes, ...], str]]) -> tuple[list[WuManber], list[str]]:
    names = sorted({item for _, item in patterns})
    number = {x: i for i, x in enumerate(names)}
    by: dict[int, dict] = {}
    for words, item in patterns:
        by.setdefault(len(words), {}).setdefault(words, []).append(number[item])
    return [WuManber(k, v) for k, v in sorted(by.items())], names


def search(words: list[bytes], machines: list[WuManber], names: list[str]) -> tuple[list[int], list[str]]:
    """Hit spans as a flat list of sorted, disjoint (begin, end) and the items that occur."""
    spans, items = [], set()
    for machine in machines:
        for begin, found in machine.find(words):
            spans.append((begin, begin + machine.length))
            items.update(found)
    return joined(spans), [names[i] for i in sorted(items)]


def joined(spans: list[tuple[int, int]]) -> list[int]:
    flat: list[int] = []
    for begin, end in sorted(spans):
        if flat and begin <= flat[-1]:
            flat[-1] = max(flat[-1], end)
        else:
            flat += [begin, end]
    return flat


def pattern_groups(benchmark: DataFrame, window: int, size: int) -> Iterator[list[Pattern]]:
    """The patterns of all items in groups of at most ``size``; the driver holds one item and one group at a time."""
    group: set[Pattern] = set()
    known: dict[bytes, bytes] = {}
    for item, text in frozen(benchmark, "item_id", "text").where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text").cast("string")).toLocalIterator(prefetchPartitions=False):
        for p in windows_of(text, window, known):
            group.add((p, item))
            if len(group) >= size:
                yield sorted(group, key=lambda x: (len(x[0]), x))
                group, known = set(), {}
    if group:
        yield sorted(group, key=lambda x: (len(x[0]), x))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (flat begin, end word places) and items for every row."""
    base = frozen(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    context = docs.sparkSession.sparkContext
    groups = pattern_groups(benchmark, window, group)
    first = next(groups, [])
    second = next(groups, None)
    columns = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<int>, items array<string>"
    if second is None:
        sent = context.broadcast(searchers(first))
        return base.mapInArrow(scanner(sent, final=True), columns)
    # Several groups: each finds its spans and items; these are merged for each row under a number that the first pass gives.
    numbered = cut(base.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = None
    while first is not None:
        sent = context.broadcast(searchers(first))
        part = cut(numbered.mapInArrow(scanner(sent, final=False), "_row long, n_words long, spans array<int>, items array<string>"), "hits")
        found = part if found is None else found.union(part)
        first, second = second, next(groups, None)
    whole = found.groupBy("_row").agg(F.first("n_words").alias("n_words"), F.collect_list("spans").alias("s"), F.collect_list("items").alias("i"))
    return numbered.select("_row", "doc_id").join(whole, "_row").mapInArrow(merger, columns)


def finished(doc: int | None, n: int, spans: list[int], items: list[str]) -> tuple:
    hit = sum(spans[1::2]) - sum(spans[::2])
    return doc, n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0, spans, items


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
PART = pa.schema([("_row", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def scanner(sent, final: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines, names = sent.value
        schema = OUT if final else PART
        for batch in batches:
            keys = batch.column(0 if final else batch.schema.get_field_index("_row")).to_pylist()
            texts = batch.column(batch.schema.get_field_index("text"))
            rows = []
            for i, key in enumerate(keys):
                words = words_of(texts[i].as_py())
                spans, items = search(words, machines, names)
                rows.append(finished(key, len(words), spans, items) if final else (key, len(words), spans, items))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for _, doc, n, spans, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            flat = joined([(b, e) for s in spans for b, e in zip(s[::2], s[1::2], strict=True)])
            rows.append(finished(doc, n, flat, sorted({x for i in items for x in i})))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), OUT, strict=True)], schema=OUT)


def keep_clean(sent, place: int):
    """Whole rows -> those in whose text, the column at ``place``, no pattern occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines, _ = sent.value
        for batch in batches:
            yield batch.filter(pa.array([not any(any(True for _ in m.find(words)) for m in machines) for words in (words_of(t.as_py()) for t in batch.column(place))], pa.bool_()))

    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs.

    Rows are judged as they pass, one by one, so rows that share an id, or have none, do not decide about each other. If the
    benchmark has several groups of patterns, each searches what the one before has kept.
    """
    context, place, kept = docs.sparkSession.sparkContext, docs.columns.index("text"), docs
    for i, patterns in enumerate(pattern_groups(benchmark, window, group)):
        kept = cut(kept, "clean") if i else kept
        kept = kept.mapInArrow(keep_clean(context.broadcast(searchers(patterns)), place), docs.schema)
    return kept
