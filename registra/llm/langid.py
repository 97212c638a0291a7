"""Language identification with hyperdimensional profiles.

Each letter has a random vector of -1 and 1, drawn from its code point. A trigram's vector binds its letters: the first
vector rotated twice, the second once, the third as it is, multiplied element by element. A text is the bundle (sum) of its
trigrams' vectors; a language's prototype is the bundle of the texts known to be in it, each scaled to length one. A document
goes to the prototype of the largest cosine. Trigram vectors are independent, so the length of a bundle is taken as its
expectation, sqrt(dimension * sum of squared counts), and only products of trigram vectors with prototypes are needed.

Runs of characters that are not letters count as one gap; case is folded. All rows that may be learned from are used:
trigram weights are summed per language before they are shuffled, and the model is one short vector per language.

Defined results
  * a null text or one without a letter is ``und`` with score 0; no learnable rows make every row ``und``;
  * on equal cosines the first language by code point wins; rows with null lang are not learned from but are predicted;
  * repeated rows are learned from as often as they occur; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.llm.common import frozen, held_out

DIMENSION = 1024
SEED = 20_240_501
KNOWN = 40_000
#: Standard deviations above which a cosine is no noise.
NOISE = 2.5
UND = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams (21 bits for each letter, 0 for a gap) with their counts; none where there is no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(letters()[points], points, 0).astype(np.uint64)
    if not points.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    points = np.concatenate(([0], points, [0])).astype(np.uint64)
    points = points[np.concatenate(([True], (points[1:] != 0) | (points[:-1] != 0)))]
    codes = points[:-2] << np.uint64(42) | points[1:-1] << np.uint64(21) | points[2:]
    return np.unique(codes, return_counts=True)


@lru_cache(maxsize=4096)
def letter_vector(point: int, dimension: int) -> np.ndarray:
    return np.random.default_rng([SEED, point]).integers(0, 2, dimension, np.int8) * np.int8(2) - np.int8(1)


def trigram_vectors(codes: np.ndarray, dimension: int) -> np.ndarray:
    low = np.uint64((1 << 21) - 1)
    out = np.empty((len(codes), dimension), np.int8)
    for i, code in enumerate(codes):
        a, b, c = (letter_vector(int(code >> np.uint64(s) & low), dimension) for s in (42, 21, 0))
        out[i] = np.roll(a, 2) * np.roll(b, 1) * c
    return out


class Table:
    """A row of values for each trigram met so far, looked up by binary search; it starts over when it has grown large."""

    def __init__(self, make, width: int, known: int = KNOWN):
        self.make, self.width, self.known = make, width, known
        self.codes, self.rows = np.empty(0, np.uint64), np.empty((0, width), np.float32)

    def of(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.codes, codes)
        at[at == len(self.codes)] = 0
        missing = codes if not len(self.codes) else codes[self.codes[at] != codes]
        if len(missing):
            if len(self.codes) > self.known:
                self.codes, self.rows = np.empty(0, np.uint64), np.empty((0, self.width), np.float32)
                missing = codes
            both = np.concatenate((self.codes, missing))
            order = np.argsort(both, kind="stable")
            self.codes, self.rows = both[order], np.concatenate((self.rows, self.make(missing)))[order]
            at = np.searchsorted(self.codes, codes)
        return self.rows[at]


def learn(dimension: int):
    """lang, text -> lang, vector: the task's share of every prototype."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        weights: dict[str, dict] = {}

        def fold(lang: str) -> None:
            held = weights.pop(lang)
            codes = np.fromiter(held, np.uint64, len(held))
            values = np.fromiter(held.values(), np.float64, len(held))
            total = sums.setdefault(lang, np.zeros(dimension))
            for k in range(0, len(codes), 2048):
                total += values[k : k + 2048] @ trigram_vectors(codes[k : k + 2048], dimension).astype(np.float64)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes, counts = trigrams(text.as_py())
                if len(codes):
                    held = weights.setdefault(lang, {})
                    unit = counts / np.sqrt(float(counts @ counts))
                    get = held.get
                    for code, x in zip(codes.tolist(), unit.tolist(), strict=True):
                        held[code] = get(code, 0.0) + x
                    if len(held) > KNOWN:
                        fold(lang)
        for lang in [*weights]:
            fold(lang)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([total.tobytes()], pa.binary())], names=["lang", "v"])

    return run


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            v = np.frombuffer(v, np.float64)
            sums[lang] = sums[lang] + v if lang in sums else v.copy()
    for lang, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([total.tobytes()], pa.binary())], names=["lang", "v"])


def prototypes(labelled: DataFrame, dimension: int = DIMENSION) -> list[tuple[str, np.ndarray]]:
    """One vector of length one per language, from rows (lang, text). The driver gets one row per language."""
    parts = labelled.select("lang", "text").mapInArrow(learn(dimension), "lang string, v binary")
    rows = parts.repartition("lang").mapInArrow(add_up, "lang string, v binary").collect()
    found = [(r["lang"], np.frombuffer(r["v"], np.float64)) for r in sorted(rows, key=lambda r: r["lang"])]
    return [(lang, v / np.linalg.norm(v)) for lang, v in found if v.any()]


def guesser(names: list[str], matrix: np.ndarray):
    """text -> (language, cosine), for one task."""
    dimension = matrix.shape[1] if len(names) else 0
    table = Table(lambda codes: trigram_vectors(codes, dimension).astype(np.float32) @ matrix.T.astype(np.float32), len(names))

    def guess(text: str | None) -> tuple[str, float]:
        codes, counts = trigrams(text)
        if not len(codes) or not names:
            return UND, 0.0
        cosines = counts.astype(np.float32) @ table.of(codes) / np.sqrt(float(counts @ counts) * dimension)
        at = int(np.argmax(cosines))
        return names[at], float(min(1.0, max(0.0, cosines[at])))

    return guess


def predict(names: list[str], matrix: np.ndarray):
    """doc_id, text, held_out -> doc_id, held_out, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guess = guesser(names, matrix)
        for batch in batches:
            found = [guess(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def keep_known(names: list[str], matrix: np.ndarray, place: int, least: float, languages: frozenset[str] | None):
    """Whole rows -> those whose text, the column at ``place``, is in a language that may stay, by a cosine of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guess = guesser(names, matrix)

        def stays(text: str | None) -> bool:
            lang, cosine = guess(text)
            return lang != UND and cosine >= least and (languages is None or lang in languages)

        for batch in batches:
            yield batch.filter(pa.array([stays(text.as_py()) for text in batch.column(place)], pa.bool_()))

    return run


def learned(base: DataFrame, learnable: Column | None, dimension: int) -> tuple[list[str], np.ndarray]:
    learnable = ~held_out(F.col("doc_id")) if learnable is None else learnable
    model = prototypes(base.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()), dimension)
    return [x for x, _ in model], np.array([v for _, v in model])


def columns_of(docs: DataFrame) -> DataFrame:
    return frozen(docs, "doc_id", "text", "lang").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def language_id(docs: DataFrame, learnable: Column | None = None, dimension: int = DIMENSION) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row; rows where ``learnable`` holds (all that are not held out, unless told otherwise) are learned from."""
    base = columns_of(docs)
    names, matrix = learned(base, learnable, dimension)
    return base.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(predict(names, matrix), "doc_id long, held_out boolean, lang_pred string, score double")


def known_language(docs: DataFrame, learnable: Column | None = None, dimension: int = DIMENSION, noise: float = NOISE, languages: frozenset[str] | None = None) -> DataFrame:
    """The rows of ``docs`` whose text is told to be in a learned language (one of ``languages``, where these are given).

    The cosine of a text with a prototype that has nothing to do with it is noise of standard deviation 1 / sqrt(dimension). A text
    whose best cosine is below ``noise`` of these deviations is in no language that was learned, and goes, as does one without
    a letter. Rows are judged as they pass, one by one, so rows that share an id, or have none, do not decide about each other.
    Where no language could be learned nothing can be rejected, and all rows stay.
    """
    names, matrix = learned(columns_of(docs), learnable, dimension)
    return docs.mapInArrow(keep_known(names, matrix, docs.columns.index("text"), noise / dimension**0.5, languages), docs.schema) if names else docs
