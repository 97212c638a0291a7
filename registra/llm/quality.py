"""Quality classification by co-training two views.

The text view sees what the text is made of: hashed byte trigrams, and shares of letters, capitals, digits, blanks and marks.
The metadata view sees what stands around it: size and line layout of the document, its source, and,
where a page of the same id exists, the page's address and tags. Each view has its own logistic classifier. Over some rounds
each classifier scores all rows without labels that may be learned from, and hands the most confident of them, as
pseudo-labels, to the other. At the end each view's logits are calibrated on labelled rows that it was not fitted on, and a
logistic combination scores all documents.

``LABELLED`` bounds the labelled rows that are fitted on: the ones of the smallest hash of their id. The rows without labels
are not bounded: every round scores all of them where they are, and only the ``GIVEN`` rows of each class that a view hands
over come to the driver. Scoring covers every row and whole texts.

Defined results
  * null texts are empty texts; missing pages, sources and languages give empty features; of several pages for one id, the
    smallest address counts;
  * without labelled rows of both kinds every score is 0.5 and the prediction 1;
  * repeated rows are scored each, and of rows that share an id one is learned from; equally confident rows go by a hash of
    their id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.llm.common import HEAVY, cut, discard, frozen, held_out, temporary
from registra.llm.toxicity import bounded_labels

LABELLED = 6_000
ROUNDS = 4
GIVEN = 200  # pseudo-labels that a view hands over in a round, of each class
TEXT_WIDTH = 1_024
META_WIDTH = 256
TEXT_RATIOS, META_NUMBERS = 10, 12

_TRIGRAM_A, _TRIGRAM_B = np.uint64(0x9E3779B1), np.uint64(0x85EBCA77)


def text_features(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams, then ratios."""
    text = text or ""
    out = np.zeros(TEXT_WIDTH + TEXT_RATIOS, np.float32)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return out
    if len(data) >= 3:
        d = data.astype(np.uint64)
        code = (d[:-2] * np.uint64(65_536) + d[1:-1] * np.uint64(256) + d[2:]) * _TRIGRAM_A
        counts = np.bincount(((code ^ (code >> np.uint64(15))) * _TRIGRAM_B >> np.uint64(7) & np.uint64(TEXT_WIDTH - 1)).astype(np.int64), minlength=TEXT_WIDTH)
        out[:TEXT_WIDTH] = np.sqrt(counts / counts.sum())
    n = len(data)
    histogram = np.bincount(data, minlength=256)
    upper, lower, digit, space = histogram[65:91].sum(), histogram[97:123].sum(), histogram[48:58].sum(), histogram[32] + histogram[10]
    high = histogram[128:].sum()
    marks = n - upper - lower - digit - space - high
    words = max(1, int(space) + 1)
    out[TEXT_WIDTH:] = [upper / n, lower / n, digit / n, space / n, high / n, marks / n, min(4.0, marks / words), (histogram[44] + histogram[46]) / words, n / words / 20, histogram[33] / words]
    return out


def meta_features(n_chars: int | None, lines: int, longest: int, source: str | None, lang: str | None, url: str | None, html_size: int | None, tags: int | None) -> np.ndarray:
    out = np.zeros(META_WIDTH + META_NUMBERS, np.float32)
    tokens = [f"s={source}", f"l={lang}", *(f"u={t}" for t in re.split(r"[^a-z]+", (url or "").lower()) if t)]
    for t in tokens:
        out[zlib.crc32(t.encode("utf-8", "surrogatepass")) % META_WIDTH] = 1
    n, size = n_chars or 0, html_size or 0
    out[META_WIDTH:] = [np.log1p(n) / 10, np.log1p(lines) / 5, np.log1p(longest) / 10, np.log1p(n / max(1, lines)) / 10, url is not None, np.log1p(size) / 10, np.log1p(tags or 0) / 5, min(4.0, size / max(1, n)) / 4, len(url or "") / 100, (url or "").count("/") / 10, "?" in (url or ""), "#" in (url or "")]
    return out


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 300, rate: float = 0.5) -> np.ndarray:
    """Logistic regression, both classes of equal weight, by full-batch Adam: the same input gives the same weights."""
    x = x.astype(np.float64)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for k in range(1, steps + 1):
        off = share * (1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))) - y)
        g = np.append(x.T @ off, off.sum()) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8) / np.sqrt(k)
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -15, 15)


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, extremes, fetch, rounds: int = ROUNDS, given: int = GIVEN) -> dict:
    """Weights of both views and of their calibrated combination, and what was handed over. Every fourth labelled row is kept for calibration.

    ``extremes(view, weights, low, high)`` gives the (id, logit) pairs of the rows without labels that score lowest and highest;
    ``fetch(ids)`` their features, as id -> (text, meta).
    """
    part = np.arange(len(y)) % 4 == 3
    if len(np.unique(y[part])) < 2 or len(np.unique(y[~part])) < 2:
        part = np.zeros(len(y), bool)
    own = {k: ([x[~part]], [y[~part]]) for k, x in (("text", text), ("meta", meta))}
    balance, taken, handed = float((y == 1).mean()), set(), []
    low, high = max(1, int(2 * given * (1 - balance))), max(1, int(2 * given * balance))
    for turn in range(rounds + 1):
        w = {k: fit(np.vstack(xs), np.concatenate(ys)) for k, (xs, ys) in own.items()}
        if turn == rounds:
            break
        picked = []
        for giver, taker in (("text", "meta"), ("meta", "text")):
            # Rows that have been taken may be among the most confident ones.
            bottom, top = extremes(giver, w[giver], low + len(taken), high + len(taken))
            for rows, most, label in ((bottom, low, 0.0), (top, high, 1.0)):
                ids = [i for i, z in rows if i not in taken and (z > 2 if label else z < -2)][:most]
                taken |= {*ids}
                picked += [(i, taker, label) for i in ids]
        found = fetch([i for i, _, _ in picked])
        for taker, at in (("text", 0), ("meta", 1)):
            for label in (0.0, 1.0):
                rows = [found[i][at] for i, t, x in picked if t == taker and x == label and i in found]
                if rows:
                    own[taker][0].append(np.array(rows, np.float32))
                    own[taker][1].append(np.full(len(rows), label))
        handed += [(turn, *x) for x in picked]
    fresh = part if part.any() else ~part
    both = np.stack([logits(text[fresh], w["text"]), logits(meta[fresh], w["meta"])], axis=1)
    return {"text": w["text"], "meta": w["meta"], "blend": fit(both, y[fresh], penalty=1e-3), "handed": handed}


DOC = ["doc_id", "text", "held_out", "n_chars", "source", "lang"]
REST = "doc_id long, held_out boolean, n_chars long, source string, lang string, lines int, longest int"
PAGE = ["url", "html_size", "tags"]


def text_view(weights: np.ndarray | None, keep: bool):
    """Documents -> what is needed of their texts: line layout, and the text view's features (``keep``) or its logit. Texts go no further than this."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lines, longest, found = [], [], []
            for x in batch.column(1):
                text = x.as_py() or ""
                cut_up = text.split("\n")
                lines.append(len(cut_up))
                longest.append(max(map(len, cut_up)))
                if keep or weights is not None:
                    found.append(text_features(text))
            if keep:
                last, name = pa.array([x.tobytes() for x in found], pa.binary()), "features"
            else:
                last, name = pa.array(logits(np.array(found), weights) if weights is not None else np.zeros(batch.num_rows)), "z"
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(i) for i in range(2, 6)), pa.array(lines, pa.int32()), pa.array(longest, pa.int32()), last], names=["doc_id", "held_out", "n_chars", "source", "lang", "lines", "longest", name])

    return run


def meta_view(batch: pa.RecordBatch) -> np.ndarray:
    cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("n_chars", "lines", "longest", "source", "lang", *PAGE)]
    return np.array([meta_features(*x) for x in zip(*cols, strict=True)], np.float32).reshape(-1, META_WIDTH + META_NUMBERS)


def text_logit(weights: np.ndarray):
    """doc_id, text -> doc_id, z."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = np.array([text_features(x.as_py()) for x in batch.column(1)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(logits(found, weights).astype(np.float64))], names=["doc_id", "z"])

    return run


def meta_logit(weights: np.ndarray):
    """Rows of the metadata view -> doc_id, z."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(logits(meta_view(batch), weights).astype(np.float64))], names=["doc_id", "z"])

    return run


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = lambda c, b=batch: b.column(b.schema.get_field_index(c))
        yield pa.RecordBatch.from_arrays([own("doc_id"), own("label"), own("features"), pa.array([x.tobytes() for x in meta_view(batch)], pa.binary())], names=["doc_id", "label", "text", "meta"])


def scorer(model: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            zt = np.asarray(own("z"))
            if model is None:
                t = m = p = np.full(len(zt), 0.5)
            else:
                zm = logits(meta_view(batch), model["meta"])
                z = logits(np.stack([zt, zm], axis=1), model["blend"])
                t, m, p = (1 / (1 + np.exp(-x)) for x in (zt, zm, z))
            arrays = [pa.array(np.asarray(x, np.float64)) for x in (p, t, m)]
            yield pa.RecordBatch.from_arrays([own("doc_id"), own("held_out"), arrays[0], pa.array((p >= 0.5).astype(np.int32)), *arrays[1:]], names=["doc_id", "held_out", "score", "predicted", "text_score", "meta_score"])

    return run


def with_pages(rows: DataFrame, pages: DataFrame | None) -> DataFrame:
    """``rows`` (no texts among them) with the address, size and tag count of the page of the same id."""
    if pages is None:
        return rows.withColumns({"url": F.lit(None).cast("string"), "html_size": F.lit(None).cast("long"), "tags": F.lit(None).cast("long")})
    own = frozen(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.length("html").cast("long").alias("html_size"), (F.length("html") - F.length(F.translate("html", "<", ""))).cast("long").alias("tags"))
    one = own.where("page_id is not null").groupBy("page_id").agg(F.min(F.struct(*PAGE)).alias("p"))
    return rows.join(one, F.expr("doc_id = page_id"), "left").select(*rows.columns, *[f"p.{c}" for c in PAGE])


def features_of(base: DataFrame, pages: DataFrame | None, chosen: DataFrame, rows: int) -> list:
    """(doc_id, label, text, meta) for the at most ``rows`` ids of ``chosen`` (doc_id, label), packed features of both views; one row for each id."""
    seen = base.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").select(*DOC).mapInArrow(text_view(None, keep=True), f"{REST}, features binary")
    seen = seen.groupBy("doc_id").agg(F.min(F.struct(*[c for c in seen.columns if c != "doc_id"])).alias("r")).select("doc_id", "r.*")
    seen = with_pages(cut(seen, "seen", HEAVY * rows), pages).join(F.broadcast(chosen), "doc_id")
    return seen.mapInArrow(extract, "doc_id long, label int, text binary, meta binary").orderBy(F.xxhash64("doc_id"), "doc_id").collect()


def unpacked(row, key: str) -> np.ndarray:
    return np.frombuffer(row[key], np.float32)


def train(base: DataFrame, labels: DataFrame, pages: DataFrame | None, labelled: int, learnable: Column, rounds: int = ROUNDS, given: int = GIVEN) -> dict | None:
    spark = base.sparkSession
    picked = bounded_labels(labels, "quality", learnable, labelled).groupBy("doc_id").agg(F.min("quality").alias("label"))
    known = features_of(base, pages, cut(picked, "chosen", labelled), labelled)
    y = np.array([r["label"] for r in known], float)
    if len(np.unique(y)) < 2:
        return None
    marked = cut(frozen(labels, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "marked")
    free = base.where(learnable & F.col("doc_id").isNotNull())
    # What the metadata view needs of all rows without labels; texts are read again in each round, and stay where they are.
    about = free.select(*DOC).mapInArrow(text_view(None, keep=False), f"{REST}, z double").drop("z").join(marked, "doc_id", "left_anti")
    about = cut(with_pages(about, pages), "about")

    def extremes(view: str, weights: np.ndarray, low: int, high: int) -> tuple[list, list]:
        if view == "text":
            scored = free.select("doc_id", "text").mapInArrow(text_logit(weights), "doc_id long, z double").join(marked, "doc_id", "left_anti")
        else:
            scored = about.mapInArrow(meta_logit(weights), "doc_id long, z double")
        scored = cut(scored.groupBy("doc_id").agg(F.min("z").alias("z")), "scored")
        ends = [[(r["doc_id"], r["z"]) for r in scored.orderBy(order, F.xxhash64("doc_id"), "doc_id").limit(n).collect()] for order, n in ((F.asc("z"), low), (F.desc("z"), high))]
        discard(scored)
        return ends[0], ends[1]

    def fetch(ids: list[int]) -> dict:
        if not ids:
            return {}
        rows = features_of(base, pages, spark.createDataFrame([(i, None) for i in ids], "doc_id long, label int"), len(ids))
        return {r["doc_id"]: (unpacked(r, "text"), unpacked(r, "meta")) for r in rows}

    view = lambda k: np.array([unpacked(r, k) for r in known], np.float32)
    return cotrain(view("text"), view("meta"), y, extremes, fetch, rounds, given)


def quality(docs: DataFrame, labels: DataFrame, pages: DataFrame | None = None, labelled: int = LABELLED, learnable: Column | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted (1 is good), text_score and meta_score for every row of ``docs``."""
    base = frozen(docs, *[c for c in DOC if c != "held_out"])
    base = base.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"), F.col("n_chars").cast("long").alias("n_chars"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    with temporary():
        model = train(base, labels, pages, labelled, ~held_out(F.col("doc_id")) if learnable is None else learnable)
    rows = with_pages(base.select(*DOC).mapInArrow(text_view(model and model["text"], keep=False), f"{REST}, z double"), pages)
    return rows.mapInArrow(scorer(model), "doc_id long, held_out boolean, score double, predicted int, text_score double, meta_score double")
