"""Toxicity by a weighted finite-state grammar over clauses.

A clause is what stands between full stops, exclamation and question marks and line ends; commas, colons, brackets, quotes, bars
and runs of marks ("!!", "...") are breaks inside it. Words become symbols: insult and threat (weighted), target, negation, reported speech, break, other.
Insult words and stems with their weights are learned from labelled rows as log odds. Threats are inflected forms of fixed
verbs; a form weighs its log odds where enough toxic rows hold it, a prior otherwise. The other classes are short fixed lists.

Each of insult, threat, target, negation, reported speech and company is a pair of transducers, one that reads a clause from
the left and one from the right, so that a target or a speaker may stand on either side ("you idiot", "idiot, you", "..., she
said"). Their composition is one pair of machines with a state for each reachable combination and one table of outputs: on an
insult or threat it says which kind of clause has matched, with or without a target, negated or not, reported or not. A word
without company, alone in its clause, matches nothing. A document's evidence is the sum of the weights by kind of match, and a
logistic score over it is fitted on the same labelled rows, drawn towards prior weights that discount negated and reported matches.

Clauses are read only around places where a word of the lexicon or a threat begins, which one automaton finds in each text.

``LABELLED`` bounds the labelled rows that are learned from: the ones of the smallest hash of their id. Scoring covers all
rows and whole texts. Neither labels nor language, source or id is an input of a score.

Defined results
  * null and empty texts score like a text without a match (below 0.5); a null label or a label of an unknown row is not used;
  * a word or stem enters the lexicon only if ``LEAST_DOCS`` toxic rows hold it; with fewer, or without labelled rows of both
    kinds, there is no lexicon: threats alone can match, and weigh their prior;
  * repeated labels and rows that share a labelled id are learned from once, by the smallest text; repeated rows are scored
    each; very long texts are scored whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.llm.common import HEAVY, cut, frozen, held_out

LABELLED = 20_000
LEAST_DOCS = 4
LEAST_WEIGHT = 3.0
#: How much more telling than its stem a word must be to have a weight of its own.
STEM_SLACK = 1.0
STEMS = (4, 5, 6, 7, 8)
#: The grammar's closed word classes (English, German, French, Spanish). Threats are verbs, in stems that take their language's endings.
THREAT = {
    "": "shot struck beaten hung umbringen umgebracht erschossen geschlagen détruire détruit détruits détruite".split(),
    "en": "kill hurt destroy murder shoot stab burn strangle attack beat harm threaten punish hang strike".split(),
    "de": "töt verletz schlag verbrenn bedroh ermord vernicht erwürg".split(),
    "fr": "tu frapp menac bless brûl étrangl assassin poignard".split(),
    "es": "mat golpe amenaz quem asesin apuñal estrangul dispar".split(),
}
ENDINGS = {
    "": [""],
    "en": ["", "s", "es", "d", "ed", "ing"],
    "de": ["en", "e", "est", "st", "et", "t", "ete", "eten"],
    "fr": ["er", "e", "es", "ent", "é", "és", "ée", "ées", "era", "erai", "ant"],
    "es": ["ar", "a", "as", "an", "o", "ó", "ado", "ando", "aré", "ará", "aron"],
}
TARGET = "you your yours yourself they them he him she her people these those du dich dir ihr sie tu toi vous ils elles tú te usted ustedes ellos ellas".split()
NEGATION = "not no never none neither nor nicht kein keine nie ne pas jamais nunca jamás".split()
REPORTED = "said says saying called calls wrote quoted quotes claims claimed according sagte sagt nannte dit disait appelle dijo dice llamó".split()
OTHER, INSULT, THREATS, YOU, NOT, SAYS, BREAK = range(7)
#: How many words after a negation it still reaches.
REACH = 3
#: A threat's weight where labels do not tell.
THREAT_WEIGHT = 2.0
#: Prior weight of a match's log evidence, by what applies to it.
PRIOR = {"base": 1.0, "target": 0.3, "negated": -0.8, "reported": -0.5, "bias": -3.0}
#: Characters that end a clause, and those that are breaks inside it; others that are not letters or apostrophes cut words.
HARD, SOFT = ".!?\n", ",:;()|\"\u201c\u201d\u00ab\u00bb"
_HARD = re.compile(f"[{re.escape(HARD)}]")
_RUNS = re.compile("[.!?]{2,}")
_CUT = {i: " " for i in range(0x80) if not (chr(i).isalpha() or chr(i) == "'")} | {i: " " for i in (0x2018, 0xA0, 0x2026, 0xBF, 0xA1)} | {ord(c): " . " for c in HARD} | {ord(c): " , " for c in SOFT}


def inflected() -> list[str]:
    """All forms of the threats: stems with their language's endings, in English with a final e lost and a final consonant doubled too."""
    out = {stem + e for lang, stems in THREAT.items() for stem in stems for e in ENDINGS[lang]}
    for stem in THREAT["en"]:
        out |= {stem[:-1] + "ing"} if stem.endswith("e") else {stem + stem[-1] + e for e in ("ed", "ing")}
    return sorted(out)


class Transducer:
    """Reads symbols one by one: step(state, symbol) gives the next state; say(state, symbol) what holds for the symbol that comes next in this state."""

    def __init__(self, step, say):
        self.step, self.say = step, say


def from_left() -> list[Transducer]:
    return [
        Transducer(lambda s, x: 0, lambda s, x: {INSULT: "insult", THREATS: "threat"}.get(x)),
        # Who says something is its speaker, no target.
        Transducer(lambda s, x: 1 if x == YOU else 0 if x == SAYS else s, lambda s, x: "target" if s else None),
        Transducer(lambda s, x: REACH if x == NOT else 0 if x == BREAK else max(0, s - 1), lambda s, x: "negated" if s else None),
        Transducer(lambda s, x: 1 if x == SAYS else s, lambda s, x: "reported" if s else None),
        Transducer(lambda s, x: 1 if x != BREAK else s, lambda s, x: "company" if s else None),
    ]


def from_right() -> list[Transducer]:
    return [
        # 0: none, 1: a target; 2, 3: the same, right before a word that reports, where its speaker stands.
        Transducer(lambda s, x: (s & 1) + 2 if x == SAYS else s & 1 if x == YOU and s & 2 else 1 if x == YOU else s & 1, lambda s, x: "target" if s & 1 else None),
        # Speech comes before a break before the word that reports it.
        Transducer(lambda s, x: max(s, 1) if x == SAYS else 2 if x == BREAK and s else s, lambda s, x: "reported" if s == 2 else None),
        Transducer(lambda s, x: 1 if x != BREAK else s, lambda s, x: "company" if s else None),
    ]


#: Kinds of match: (kind, target, negated, reported).
KINDS = [*product(("insult", "threat"), (False, True), (False, True), (False, True))]


def product_of(parts: list[Transducer]) -> tuple[list[list[int]], list[list[frozenset]]]:
    """(table, said) over the reachable product states: table[state][symbol] is the next state, said[state][symbol] what holds; state 0 is the start."""
    number, table, said, todo = {(0,) * len(parts): 0}, [], [], [(0,) * len(parts)]
    for at in todo:
        moves = [tuple(m.step(s, x) for m, s in zip(parts, at, strict=True)) for x in range(7)]
        for to in moves:
            if to not in number:
                number[to] = len(number)
                todo.append(to)
        table.append([number[to] for to in moves])
        said.append([frozenset(m.say(s, x) for m, s in zip(parts, at, strict=True)) for x in range(7)])
    return table, said


def compose(left: list[Transducer], right: list[Transducer]) -> tuple[list[list[int]], list[list[int]], dict[tuple[int, int, int], int]]:
    """Both machines, and the kind of match by (left state, symbol, right state) where there is one."""
    (forth, before), (back, after) = product_of(left), product_of(right)
    kinds = {}
    for x, f, b in product((INSULT, THREATS), range(len(forth)), range(len(back))):
        holds = before[f][x] | after[b][x]
        if "company" in holds:
            kinds[f, x, b] = KINDS.index(("insult" if x == INSULT else "threat", "target" in holds, "negated" in holds, "reported" in holds))
    return forth, back, kinds


def words_of(text: str | None) -> list[str]:
    """Lower-case words, with "." where a clause ends and "," at a break inside it."""
    return with_breaks((text or "").lower().replace("\u2019", "'")).translate(_CUT).split()


def with_breaks(text: str) -> str:
    """Runs of marks as breaks, in their places."""
    return _RUNS.sub(lambda m: "," * len(m[0]), text)


def features(word: str) -> Iterator[str]:
    yield word
    for n in STEMS:
        if len(word) > n:
            yield word[:n] + "*"


def in_word(c: str) -> bool:
    return c.isalpha() if c < "\x80" and c != "'" else c not in _CUT_CHARS


_CUT_CHARS = {chr(i) for i in _CUT}


class Grammar:
    """The composed machines with a lexicon of insult words and stems (ending in *) and of threats, and their weights."""

    def __init__(self, lexicon: dict[str, float], threats: dict[str, float] | None = None):
        self.lexicon, self.seen = lexicon, {}
        self.forth, self.back, self.kinds = compose(from_left(), from_right())
        self.fixed = {w: (s, 0.0) for s, ws in ((YOU, TARGET), (NOT, NEGATION), (SAYS, REPORTED)) for w in ws}
        self.fixed |= {w: (THREATS, THREAT_WEIGHT) for w in inflected()} | {w: (THREATS, x) for w, x in (threats or {}).items()}
        self.fixed |= {",": (BREAK, 0.0)}
        self.starts = ahocorasick.Automaton()
        for w in {*(x.rstrip("*") for x in lexicon), *(w for w, x in self.fixed.items() if x[0] == THREATS)}:
            self.starts.add_word(w, len(w))
        self.starts.make_automaton()

    def symbol(self, word: str) -> tuple[int, float]:
        if word in self.fixed:
            return self.fixed[word]
        if word.endswith("n't"):
            return NOT, 0.0
        found = max((self.lexicon[f] for f in features(word) if f in self.lexicon), default=None)
        return (INSULT, found) if found is not None else (OTHER, 0.0)

    def clauses(self, text: str) -> Iterator[str]:
        """The clauses of a lower-case text in which a word may begin that scores."""
        begins = [end + 1 - n for end, n in self.starts.iter(text)]
        begins = [i for i in begins if not i or not in_word(text[i - 1])]
        if not begins:
            return
        text = with_breaks(text)
        ends = [m.start() for m in _HARD.finditer(text)]
        for k in sorted({bisect_left(ends, i) for i in begins}):
            yield text[ends[k - 1] + 1 if k else 0 : ends[k] if k < len(ends) else len(text)]

    def evidence(self, text: str | None) -> list[float]:
        """The weights of matched clauses, summed by kind."""
        out, seen = [0.0] * len(KINDS), self.seen
        if len(seen) > 300_000:
            seen.clear()
        for clause in self.clauses((text or "").lower().replace("\u2019", "'")):
            got = []
            for word in words_of(clause):
                symbol = seen.get(word)
                if symbol is None:
                    symbol = seen[word] = self.symbol(word)
                got.append(symbol)
            state, after = 0, [0] * len(got)
            for i in range(len(got) - 1, 0, -1):
                state = after[i - 1] = self.back[state][got[i][0]]
            state = 0
            for (symbol, weight), right in zip(got, after, strict=True):
                if symbol == INSULT or symbol == THREATS:
                    kind = self.kinds.get((state, symbol, right))
                    if kind is not None:
                        out[kind] += weight
                state = self.forth[state][symbol]
        return out


def inputs(evidence: np.ndarray) -> np.ndarray:
    return np.log1p(evidence)


def priors() -> tuple[np.ndarray, float]:
    w = [PRIOR["base"] + PRIOR["target"] * t + PRIOR["negated"] * n + PRIOR["reported"] * r for _, t, n, r in KINDS]
    return np.array(w), PRIOR["bias"]


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, b: float, pull: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, drawn towards (w, b)."""
    prior = np.append(w, b)
    at, x1 = prior.copy(), np.hstack([x, np.ones((len(x), 1))])
    keep = np.append(np.full(len(w), pull), 1e-3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ at, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(keep), x1.T @ (p - y) + keep * (at - prior))
        at = at - step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return at[:-1], float(at[-1])


COUNTS = "f string, n long"
_SCHEMA = pa.schema([("f", pa.string()), ("n", pa.int64())])


def count_features(only: frozenset | None):
    """text -> in how many texts each feature occurs; ``only`` these, if given. Counts leave the task before they grow large."""

    def flush(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*held], pa.string()), pa.array([*held.values()], pa.int64())], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                own = {f for w in {*words_of(text.as_py())} if w not in ".," for f in features(w)}
                held.update(own if only is None else own & only)
                if len(held) > 100_000:
                    yield flush(held)
                    held = Counter()
        if held:
            yield flush(held)

    return run


def learn_lexicon(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Insult words and stems, and threats, with their log odds, from rows (text, toxic); the rows are bounded, and so is what comes back."""
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    yes, no = size.get(1, 0), size.get(0, 0)
    if not yes or not no:
        return {}, {}
    tally = lambda df, only: df.select("text").mapInArrow(count_features(only), COUNTS).groupBy("f").agg(F.sum("n").alias("n"))
    in_toxic = {r["f"]: r["n"] for r in tally(rows.where("toxic = 1"), None).where(F.col("n") >= LEAST_DOCS).collect()}
    in_clean = {r["f"]: r["n"] for r in tally(rows.where("toxic = 0"), frozenset(in_toxic)).collect()}
    odds = {f: math.log((n + 0.5) / (yes + 1)) - math.log((in_clean.get(f, 0) + 0.5) / (no + 1)) for f, n in in_toxic.items()}
    closed = {*inflected(), *TARGET, *NEGATION, *REPORTED}
    threats = {f: round(max(0.0, odds[f]), 6) for f in inflected() if f in odds}
    # A stem that is about as telling as its continuations speaks for them.
    picked: dict[str, float] = {}
    for f in sorted(odds, key=lambda f: (len(f), f)):
        if odds[f] >= LEAST_WEIGHT and f not in closed and not any(odds[f] <= picked.get(f[:n] + "*", -1.0) + STEM_SLACK for n in STEMS if n < len(f.rstrip("*")) + (not f.endswith("*"))):
            picked[f] = round(odds[f], 6)
    return picked, threats


def evidence_of(words: tuple[dict[str, float], dict[str, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(*words)
        for batch in batches:
            found = [grammar.evidence(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    return run


def score(words: tuple[dict[str, float], dict[str, float]], w: np.ndarray, b: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(*words)
        for batch in batches:
            x = np.array([grammar.evidence(t.as_py()) for t in batch.column(1)]).reshape(-1, len(KINDS))
            p = 1 / (1 + np.exp(-np.clip(inputs(x) @ w + b, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def bounded_labels(labels: DataFrame, label: str, learnable: Column, bound: int) -> DataFrame:
    """At most ``bound`` labelled rows, those whose ids hash lowest."""
    rows = frozen(labels, "doc_id", label).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias(label))
    return rows.where(learnable & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).orderBy(F.xxhash64("doc_id"), "doc_id", label).limit(bound)


def toxicity(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, learnable: Column | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    base = frozen(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learnable = ~held_out(F.col("doc_id")) if learnable is None else learnable
    picked = bounded_labels(labels, "toxic", learnable, labelled)
    once = base.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = cut(once.select("text", "toxic"), "labelled", HEAVY * labelled)
    words = learn_lexicon(rows)
    w, b = priors()
    if words[0]:
        seen = rows.mapInArrow(evidence_of(words), "x array<double>, toxic int").collect()
        w, b = fit(inputs(np.array([r["x"] for r in seen])), np.array([r["toxic"] for r in seen], float), w, b)
    return base.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(score(words, w, b), "doc_id long, held_out boolean, score double, predicted int")
