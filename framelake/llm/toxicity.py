"""Toxicity of texts whose words may be disguised.

Disguised words (leetspeak, letters apart, letters repeated) are restored by a noisy channel: each character is a lattice of
what may stand behind it, and Viterbi decoding picks the likeliest string under a character language model, whose counts
cover every text of the corpus. Words and word beginnings that mark toxic labels give the restored text its score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontamination import _portions
from .scratch import materialize
from .words import strip_right

#: Labelled rows the classifier is fitted on, at most: those with the smallest hashes of doc_id.
TRAIN_ROWS = 20_000
#: Lengths of word beginnings that are features beside the whole word.
PREFIXES = (4, 5, 6, 7)
#: A feature must stand in so many different contexts of toxic rows, and in at least this share of their number.
LEAST_CONTEXTS, LEAST_SHARE = 3, 0.01
#: Least log odds of a feature.
LEAST_ODDS = 2.0
KEPT_WORDS = 100_000
#: Pairs of feature and context that a task holds before it hands them on.
HELD_PAIRS = 50_000

# Letters of the language model, by number from 1; 0 is a border, 61 any other letter, 62 a digit.
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßàâáãåæçéèêëíìîïñóòôõøœúùûÿý"
SIZE, OTHER, DIGIT = 64, 61, 62
#: What may stand behind a character.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "€": "e"}

_SYMBOLS = "@$!+|€"
_STRIP_LEFT = re.compile(rf"^[^\w{re.escape(_SYMBOLS)}]+|^_+")
_LEET_INSIDE = re.compile(rf"[0-9{re.escape(_SYMBOLS)}]")
_LETTER = re.compile(r"[^\W\d_]")
_RUN = re.compile(r"([^\W\d_])\1\1+")
_APART = re.compile(r"[^\W_][.\-_*~]+[^\W_]")
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")


def _letter_table() -> np.ndarray:
    table = np.zeros(0x250, np.int64)
    for cp in range(0x250):
        c = chr(cp)
        table[cp] = LETTERS.index(c) + 1 if c in LETTERS else DIGIT if c.isdigit() else OTHER if c.isalpha() else 0
    return table


TABLE = _letter_table()
NUMBER = {c: k + 1 for k, c in enumerate(LETTERS)}


def number(c: str) -> int:
    return NUMBER.get(c) or (DIGIT if c.isdigit() else OTHER if c.isalpha() else 0)


def count_trigrams(texts: list[str | None], counts: np.ndarray) -> None:
    line = "  ".join(t or "" for t in texts).lower() + "  "
    cps = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    ids = np.where(cps < 0x250, TABLE[np.minimum(cps, 0x24F)], OTHER)
    counts += np.bincount((ids[:-2] * SIZE + ids[1:-1]) * SIZE + ids[2:], minlength=SIZE**3)


def gather_trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of all letter trigrams of every text. At most SIZE^3 numbers leave a task, and reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SIZE**3, np.int64)
        for b in batches:
            for _, part in _portions(b, 0, 1 << 17):
                count_trigrams(part, counts)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["gram", "n"])

    rows = docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SIZE**3, np.int64)
    for r in rows:
        counts[r["gram"]] = r["n"]
    return counts


def language_model(counts: np.ndarray) -> np.ndarray:
    """Negative log probabilities of a letter after two others, trigrams backed by bigrams and these by letters."""
    tri = counts.reshape(SIZE, SIZE, SIZE).astype(float)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + SIZE)
    p2 = (bi + 20 * p1) / (bi.sum(1, keepdims=True) + 20)
    p3 = (tri + 20 * p2) / (tri.sum(2, keepdims=True) + 20)
    return -np.log(p3).astype(np.float32)


#: What it costs to take a character for another one, to take a separator for a border, to change repetitions.
SWAP_COST, BORDER_COST, REPEAT_COST = 2.0, 2.0, 1.0
#: Steps of the decoding after which what is settled is laid aside.
SETTLE = 64


def lattice(span: str) -> Iterator[list[tuple[str, float]]]:
    """For each character, or run of one, what may stand behind it and at what cost."""
    for m in re.finditer(r"(.)\1*", span, re.S):
        c, n = m[1], len(m[0])
        if _LETTER.match(c):
            ways = [(c, REPEAT_COST if n > 1 else 0.0)] + ([(c * 2, 0.0 if n == 2 else REPEAT_COST)] if n > 1 else [])
        elif c in LEET:
            keep = c if c.isdigit() else " "
            ways = [(keep, 0.0)] + [(x, SWAP_COST) for x in LEET[c]] + ([(x * 2, SWAP_COST) for x in LEET[c]] if n == 2 else [])
        else:
            ways = [(" ", BORDER_COST), ("", 0.0)] if not c.isdigit() else [(c, 0.0)]
        yield ways


def restore(span: str, model: np.ndarray) -> str:
    """The likeliest string behind span: Viterbi over pairs of letters. Ties go to the string that comes first.

    What all states begin with is settled and laid aside now and then, so their strings stay short in long spans.
    """
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    settled: list[str] = []
    for step, ways in enumerate(chain(lattice(span), [[(" ", 0.0)]])):
        if step % SETTLE == SETTLE - 1:
            known = commonprefix([text for _, text in states.values()])
            settled.append(known)
            states = {at: (cost, text[len(known) :]) for at, (cost, text) in states.items()}
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, text) in states.items():
            for put, extra in ways:
                x, y, c = a, b, cost + extra
                for ch in put:
                    z = number(ch)
                    if not z and not y and x == 0:
                        continue  # borders in a row are one
                    c += float(model[x, y, z])
                    x, y = y, z
                best = (c, text + put)
                if (x, y) not in new or best < new[x, y]:
                    new[x, y] = best
        states = new
    return " ".join(("".join(settled) + min(states.values())[1]).split())


def disguised(core: str) -> bool:
    if not _LETTER.search(core):
        return False
    return bool(_LEET_INSIDE.search(core) or _RUN.search(core) or _APART.search(core))


@dataclass
class Restorer:
    """Words of a text as they are and as restored."""

    model: np.ndarray
    kept: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def of_token(self, raw: str) -> tuple[str, ...]:
        got = self.kept.get(raw)
        if got is None:
            left = strip_right(_STRIP_LEFT.sub("", raw))
            core = left.lstrip(_SYMBOLS)
            forms = [core] if core else []
            if disguised(left):
                forms += [w for w in restore(left, self.model).split() if w not in forms]
            if len(self.kept) >= KEPT_WORDS:
                self.kept.clear()
            got = self.kept[raw] = tuple(forms)
        return got

    def of_spaced(self, text: str) -> list[str]:
        """Words behind single characters that stand apart."""
        out: list[str] = []
        for m in _SPACED.finditer(text):
            if _LETTER.search(m[0]):
                out += [w for w in restore(" ".join(m[0].split()), self.model).split() if len(w) > 2]
        return out

    def words(self, text: str) -> list[str]:
        low = text.lower()
        return [w for raw in low.split() for w in self.of_token(raw)] + self.of_spaced(low)


def features(word: str) -> list[str]:
    return ["=" + word] + [word[:n] for n in PREFIXES if len(word) > n]


@dataclass
class Scorer:
    """Scores of texts: log odds of their words' strongest features, put together by a logistic curve."""

    model: np.ndarray
    odds: dict[str, float]
    curve: np.ndarray
    kept: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.restorer = Restorer(self.model)

    def of_word(self, word: str) -> float:
        return max((self.odds.get(f, 0.0) for f in features(word)), default=0.0)

    def of_token(self, raw: str) -> float:
        got = self.kept.get(raw)
        if got is None:
            if len(self.kept) >= KEPT_WORDS:
                self.kept.clear()
            forms = self.restorer.of_token(raw)
            self.restorer.kept.clear()
            got = self.kept[raw] = max(map(self.of_word, forms), default=0.0)
        return got

    def evidence(self, text: str | None) -> tuple[float, float, float]:
        """The two strongest words and the number of marked ones, up to 5."""
        low = (text or "").lower()
        tokens = low.split()
        try:
            found = list(map(self.kept.__getitem__, tokens))
        except KeyError:
            found = list(map(self.of_token, tokens))
        marked = [x for x in found if x] + [x for x in map(self.of_word, self.restorer.of_spaced(low)) if x]
        marked.sort(reverse=True)
        return (marked[0] if marked else 0.0, marked[1] if len(marked) > 1 else 0.0, float(min(5, len(marked))))

    def score(self, text: str | None) -> float:
        z = float(self.curve[0] + self.curve[1:] @ np.array(self.evidence(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


#: Weights of the evidence before labels are seen: the strongest word's odds in full, as naive Bayes has it, the next by half.
BEFORE = (1.0, 0.5, 0.0)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 5.0) -> np.ndarray:
    """Logistic regression by Newton's method, drawn to the smoothed share of toxic rows and BEFORE, which few rows leave as they are."""
    share = (y.sum() + 0.5) / (len(y) + 2)
    w = before = np.r_[np.log(share / (1 - share)), BEFORE]
    if len(y) == 0 or y.min() == y.max():
        return w
    a, penalty = np.c_[np.ones(len(x)), x], ridge * np.eye(len(w))

    def loss(v: np.ndarray) -> float:
        z = a @ v
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * ridge * ((v - before) ** 2).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + penalty @ (w - before)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, grad)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 5; 0 is held out. A null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of at most TRAIN_ROWS labelled documents that are not held out, equal texts once."""
    known = labels.where((fold(F.col("doc_id")) != 0) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    picked = known.groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("__id"), "__id").limit(TRAIN_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("__id"))
    return rows.groupBy("text").agg(F.max("toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    """The language model from all of docs, and the classifier from labelled rows that are not held out."""
    spark = docs.sparkSession
    model = language_model(gather_trigrams(docs))
    rows = materialize(training_rows(docs, labels), "toxicity-training")
    shared = spark.sparkContext.broadcast(model)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, seen = Restorer(shared.value), set()

        def laid_out() -> pa.RecordBatch:
            f, c = zip(*seen) if seen else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(c, pa.int32())], ["feature", "context"])

        for b in batches:
            for t in b.column(0):
                words = restorer.words(t.as_py() or "")
                for before, w in zip(["", *words], words):
                    seen.update((f, hash_of(before)) for f in features(w))
                    if len(seen) > HELD_PAIRS:
                        yield laid_out()
                        seen.clear()
        yield laid_out()

    # A word that only copies of one document share has one context, however many there are.
    bad = rows.where("toxic = 1").select("text").repartition(8).mapInArrow(contexts, "feature string, context int").distinct()
    n_bad = rows.where("toxic = 1").count()
    least = max(LEAST_CONTEXTS, int(LEAST_SHARE * n_bad))
    often = {r[0]: r[1] for r in bad.groupBy("feature").count().where(F.col("count") >= least).collect()}
    wanted = spark.sparkContext.broadcast(set(often))

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, n = Restorer(shared.value), dict.fromkeys(wanted.value, 0)
        for b in batches:
            for t in b.column(0):
                for f in {f for w in set(restorer.words(t.as_py() or "")) for f in features(w)} & wanted.value:
                    n[f] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["feature", "n"])

    clean = rows.where("toxic = 0").select("text").repartition(8)
    fine = {r[0]: r[1] for r in clean.mapInArrow(presence, "feature string, n long").groupBy("feature").agg(F.sum("n")).collect()}
    n_fine = rows.where("toxic = 0").count()
    odds = {f: float(np.log((n + 0.5) / (n_bad + 1)) - np.log((fine.get(f, 0) + 0.5) / (n_fine + 1))) for f, n in often.items()}
    odds = {f: o for f, o in odds.items() if o >= LEAST_ODDS}
    draft = spark.sparkContext.broadcast((model, odds))

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(*draft.value, np.zeros(4))
        for b in batches:
            got = np.array([s.evidence(t.as_py()) for t in b.column(0)], np.float64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*map(pa.array, got.T.copy()), b.column(1)], ["a", "b", "c", "toxic"])

    seen = rows.select("text", F.col("toxic").cast("int")).repartition(8).mapInArrow(evidence, "a double, b double, c double, toxic int").collect()
    seen.sort()
    xy = np.array([tuple(r) for r in seen], float).reshape(-1, 4)
    return Scorer(model, odds, fit_curve(xy[:, :3], xy[:, 3]))


def hash_of(word: str) -> int:
    h = 0
    for c in word:
        h = (h * 131 + ord(c)) & 0x7FFFFFFF
    return h


def score_documents(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, held_out, score, predicted of every row's whole text; a null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast((scorer.model, scorer.odds, scorer.curve))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(*shared.value)
        for b in batches:
            scores = np.array([s.score(t.as_py()) for t in b.column(2)], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """The rows of docs, all columns, that the scorer finds clean."""
    shared, column = docs.sparkSession.sparkContext.broadcast((scorer.model, scorer.odds, scorer.curve)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(*shared.value)
        for b in batches:
            yield b.filter(pa.array([s.score(t.as_py()) < 0.5 for t in b.column(column)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
