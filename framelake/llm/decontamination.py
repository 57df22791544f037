"""Benchmark decontamination by spaced-seed hashing.

Texts become sequences of words (cut at ASCII white space, lower-cased, stripped of marks at both ends). A mask is laid at
every position; the words under its ones are hashed, those under its zeros may be anything. Hashes of benchmark and
training windows are joined, and round each hit the benchmark item is laid along the text and compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .words import strip_marks

#: A leak is a stretch of this many words of an item (or the whole item, if shorter), of which this share stands in the text.
WINDOW, SIMILARITY = 13, 0.8
#: Fixed masks. Any stretch of 13 words with up to 2 others holds a window of one of them without a difference.
MASKS = ("11101011", "110100111")
#: Words of the benchmark that go to the executors at once; a larger benchmark is taken in several passes.
BLOCK_WORDS = 500_000
KEPT_WORDS = 500_000
#: Rows of a repeated item that are laid out from one row.
COPIES = 4096
#: Hits of a text beyond which they are no longer listed one by one; words that are compared at once.
MOST_HITS, COMPARED = 1 << 19, 1 << 21
_GAP = 16


def normal_word(raw: str) -> str:
    return raw.lower() if raw.isalnum() else strip_marks(raw.lower())


class _Ids(dict):
    """Raw word to its number: 0 for one that no benchmark item has, -1 for marks alone. Words are kept as they are met."""

    def __init__(self, known: dict[str, int]) -> None:
        super().__init__()
        self.known = known

    def __missing__(self, raw: str) -> int:
        w = normal_word(raw)
        if len(self) >= KEPT_WORDS:
            self.clear()
        n = self[raw] = self.known.get(w, 0) if w else -1
        return n


def split_words(text: str | None) -> list[str]:
    """Cut at ASCII white space; other white space stays inside words. Empty words mean nothing."""
    text = text or ""
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return text.split(" ")


class SeedIndex:
    """The seeds of one block of benchmark items."""

    def __init__(self, texts: list[str]) -> None:
        self.known: dict[str, int] = {}
        words = [[w for w in map(normal_word, split_words(t)) if w] for t in texts]
        self.items = [np.array([self.known.setdefault(w, len(self.known) + 1) for w in ws], np.int32) for ws in words]
        short = sorted({len(x) for x in self.items if 0 < len(x) < WINDOW})
        self.masks = [np.flatnonzero([c == "1" for c in m]) for m in MASKS] + [np.arange(n) for n in short]
        self.exact = [0] * len(MASKS) + short  # such a mask is for items of this length
        rng = np.random.default_rng(11)
        self.factors = rng.integers(1, 1 << 63, (len(self.masks), WINDOW), dtype=np.uint64) | np.uint64(1)
        self.tables, self.begins = [], []
        for k in range(len(self.masks)):
            rows, begins = [], np.zeros(len(self.known) + 1, bool)
            for i, x in enumerate(self.items):
                if (self.exact[k] == len(x)) if self.exact[k] else (len(x) >= WINDOW):
                    at = np.arange(max(0, len(x) - self.masks[k][-1]))
                    rows.append((self._hash(k, x, at), np.full(len(at), i), at))
                    begins[x[at]] = True
            h, item, at = (np.concatenate([r[j] for r in rows]) if rows else np.zeros(0, np.uint64 if not j else np.int64) for j in range(3))
            order = np.argsort(h, kind="stable")
            bits = max(12, int(len(h)).bit_length() + 5)
            seen = np.zeros(1 << bits, bool)
            seen[h >> np.uint64(64 - bits)] = True
            self.tables.append((h[order], item[order], at[order], seen, np.uint64(64 - bits)))
            self.begins.append(begins)  # words with which a seed begins
        self.lookup = _Ids(self.known)

    def _hash(self, k: int, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for f, off in zip(self.factors[k], self.masks[k]):
            h += x[at + off].astype(np.uint64) * f
            h ^= h >> np.uint64(29)
        return h * np.uint64(0x9E3779B97F4A7C15)

    def leaks(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, int, int, int]]:
        """(row, item, overlap, matched words, words of the item, first word in the text): the best place of each item."""
        get, parts, firsts, size = self.lookup.__getitem__, [], [], 0
        for t in texts:
            words = split_words(t)
            x = np.fromiter(map(get, words), np.int32, len(words))
            x = x[x >= 0]
            firsts.append(size)
            parts += [x, np.zeros(_GAP, np.int32)]
            size += len(x) + _GAP
        if not texts or not self.items:
            return
        line, starts = np.concatenate(parts), np.array(firsts)
        ends = np.append(starts[1:], size) - _GAP
        spots = [self._spots(k, line) for k in range(len(self.masks))]
        # Hits are too many to list only in texts that repeat words of an item over and over.
        hits = np.zeros(len(texts), np.int64)
        for pos, lo, hi in spots:
            np.add.at(hits, np.searchsorted(starts, pos, "right") - 1, hi - lo)
        found = []
        for k, (pos, lo, hi) in enumerate(spots):
            few = hits[np.searchsorted(starts, pos, "right") - 1] <= MOST_HITS
            pos, lo, n = pos[few], lo[few], (hi - lo)[few]
            for a, b in _cuts(n, MOST_HITS):
                found.append(self._diagonals(k, pos[a:b], lo[a:b], n[a:b], starts))
        places = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
        for a, b in _groups(places[:, :2]):
            r, i, _ = places[a].tolist()
            yield from self._best(r, i, places[a:b, 2], line[starts[r] : ends[r]])
        for r in np.flatnonzero(hits > MOST_HITS).tolist():
            yield from self._repetitive(r, line[starts[r] : ends[r]], [(pos[m] - starts[r], lo[m], hi[m]) for pos, lo, hi in spots for m in [(pos >= starts[r]) & (pos < ends[r])]])

    def _spots(self, k: int, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of the line whose seed some item has, and where its rows stand in the table."""
        h, _, _, seen, shift = self.tables[k]
        mask = self.masks[k]
        pos = np.flatnonzero(self.begins[k][line[: max(0, len(line) - int(mask[-1]))]])
        for off in mask[1:]:
            pos = pos[line[pos + off] > 0]
        g = self._hash(k, line, pos)
        maybe = seen[g >> shift]
        pos, g = pos[maybe], g[maybe]
        lo, hi = np.searchsorted(h, g, "left"), np.searchsorted(h, g, "right")
        return pos[hi > lo], lo[hi > lo], hi[hi > lo]

    def _diagonals(self, k: int, pos: np.ndarray, lo: np.ndarray, n: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The distinct (row, item, place of the item's first word in the row) of these hits."""
        _, item, at, _, _ = self.tables[k]
        which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        p = np.repeat(pos, n)
        row = np.searchsorted(starts, p, "right") - 1
        return np.unique(np.stack([row, item[which], p - at[which] - starts[row]], 1), axis=0)

    def _repetitive(self, r: int, text: np.ndarray, spots: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int, float, int, int, int]]:
        """The same for a text with very many hits, item by item: its diagonals if there are fewer of its hits than places
        where it could lie, else all of these. Either way the words decide."""
        meant = np.zeros(len(self.items))
        for k, (_, lo, hi) in enumerate(spots):
            one, n = np.unique(np.stack([lo, hi], 1), axis=0, return_counts=True)
            for (a, b), times in zip(one.tolist(), n.tolist()):
                meant += times * np.bincount(self.tables[k][1][a:b], minlength=len(meant))
        for i in np.flatnonzero(meant).tolist():
            x = self.items[i]
            if meant[i] > len(text) + len(x):
                yield from self._best(r, i, np.arange(1 - len(x), len(text)), text)
                continue
            found = []
            for k, (pos, lo, hi) in enumerate(spots):
                h, item, at, _, _ = self.tables[k]
                mine = np.flatnonzero(item == i)
                a, b = np.searchsorted(mine, lo), np.searchsorted(mine, hi)
                n = b - a
                which = mine[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                found.append(np.repeat(pos, n) - at[which])
            yield from self._best(r, i, np.unique(np.concatenate(found)), text)

    def _best(self, r: int, i: int, places: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int, float, int, int, int]]:
        """Of the places where item i is laid along the text, compared word by word, the best one, if it is a leak."""
        x = self.items[i]
        w = min(WINDOW, len(x))
        need = w if len(x) < WINDOW else -(-int(SIMILARITY * 1000) * w // 1000)
        padded = np.concatenate([np.zeros(len(x), np.int32), text, np.zeros(len(x), np.int32)])
        windows, best = np.lib.stride_tricks.sliding_window_view(padded, len(x)), None
        step = max(1, COMPARED // len(x))
        for k in range(0, len(places), step):
            at = places[k : k + step]
            same = windows[at + len(x)] == x
            sums = np.zeros((len(at), len(x) + 1), np.int32)
            np.cumsum(same, 1, out=sums[:, 1:])
            most = (sums[:, w:] - sums[:, :-w]).max(1)
            good = np.flatnonzero(most >= need)
            if len(good):
                first = np.maximum(0, at[good])
                top = np.lexsort((first, sums[good, -1], most[good]))[-1]
                score = (float(most[good[top]]) / w, int(sums[good[top], -1]), len(x), int(first[top]))
                best = max(best, score) if best else score
        if best:
            yield r, i, *best


def _cuts(n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of n that sum up to about `most` each."""
    piece = np.cumsum(n) // most
    edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(n)]
    yield from ((a, b) for a, b in zip(edges, edges[1:]) if b > a)


def _groups(rows: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of equal rows."""
    if len(rows):
        edges = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(1), True]).tolist()
        yield from zip(edges, edges[1:])


def _blocks(benchmark: DataFrame) -> Iterator[tuple[pa.Array, list[str], pa.Array]]:
    """The benchmark's items, equal rows once: ids, texts and numbers of rows, in blocks of about BLOCK_WORDS words."""
    sized = benchmark.where("text is not null").groupBy("item_id", "text").agg(F.count("*").alias("copies"))
    sized = materialize(sized, "benchmark-items")
    n = sized.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    blocks = max(1, -(-int(n) // BLOCK_WORDS))
    for k in range(blocks):
        t = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow().combine_chunks()
        ids, copies = (t.column(c).chunk(0) if t.num_rows else pa.array([], t.schema.field(c).type) for c in (0, 2))
        yield ids, t.column(1).to_pylist(), copies


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and each benchmark item that leaks into it: doc_id, item_id, overlap (the best stretch's share
    of equal words), matched_words, item_words, start (the item's first word in the text, from 0).

    An item of fewer than 13 words leaks only word for word; items and texts without words never do. Null texts have no
    words. Ids may be of any type and null. Repeated rows give a row each; a repeated item is looked for once, and its hits
    are laid out by its number of rows. Only the benchmark goes to the executors; a
    larger one in blocks of bounded size, for each of which the documents are read once. Documents are not shuffled.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, overlap double, matched_words int, item_words int, start long, copies long"
    out = None
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, schema=schema) -> Iterator[pa.RecordBatch]:
            (names, texts, copies), columns = shared.value, [c.split()[0] for c in schema.split(", ")]
            index = SeedIndex(texts)
            for b in batches:
                for at, part in _portions(b, 1):
                    got = list(index.leaks(part))
                    if got:
                        rows, items, *cols = zip(*got)
                        ids, times = (b.column(0).take(pa.array([at + r for r in rows])), names.take(pa.array(items))), copies.take(pa.array(items))
                        yield pa.RecordBatch.from_arrays([*ids, *[pa.array(c, k) for c, k in zip(cols, (pa.float64(), pa.int32(), pa.int32(), pa.int64()))], times], columns)

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))
    out = out.withColumn("block", block).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES), F.col("copies") - F.col("block") * COPIES))))
    return out.drop("copies", "block", "copy")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, into which no benchmark item leaks. Rows left by one block of a large benchmark are
    written to the shared folder before the next one, so that a task never holds more than one block's index."""
    spark, column, first = docs.sparkSession, docs.columns.index("text"), True
    for _, texts, _ in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(texts)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = SeedIndex(shared.value)
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for at, part in _portions(b, column):
                    clean[[at + r for r, *_ in index.leaks(part)]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema) if first else materialize(docs, "decontaminated").mapInArrow(run, docs.schema)
        first = False
    return docs


def _portions(b: pa.RecordBatch, column: int, chars: int = 1 << 23) -> Iterator[tuple[int, list[str | None]]]:
    """The column's texts, so many at a time that they hold about `chars` characters."""
    part: list[str | None] = []
    first = held = 0
    for i, t in enumerate(b.column(column)):
        part.append(t.as_py())
        held += len(part[-1] or "")
        if held >= chars:
            yield first, part
            part, first, held = [], i + 1, 0
    if part:
        yield first, part
