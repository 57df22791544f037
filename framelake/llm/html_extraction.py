"""Main text of pages: a linear-chain conditional random field over DOM leaf blocks, decoded by Viterbi."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .html_blocks import blocks, features
from .html_training import labelled_pages

TRAIN_PAGES = 600


def labelled_blocks(parts: list[tuple[str, bool]]) -> tuple[list[list[str]], list[int]]:
    """Features and labels of a page made of labelled parts; a block's label is that of the part its text came from."""
    found = blocks("".join(p for p, _ in parts))
    want = [b.text for p, good in parts if good for b in blocks(p)]
    labels, at = [], 0
    for b in found:
        good = at < len(want) and b.text == want[at]
        labels.append(int(good))
        at += good
    return features(found), labels


@dataclass
class ChainModel:
    """weights: of each feature for being main text; turn: of a label (row) before another one (column); begin: of the first."""

    weights: dict[str, float]
    turn: np.ndarray
    begin: np.ndarray

    def __post_init__(self) -> None:
        #: Marks that have a weight; others change nothing.
        self.known = frozenset(f.removeprefix("mark=") for f in self.weights if f.startswith("mark="))

    def decode(self, page: list[list[str]]) -> list[int]:
        """The likeliest labels; ties go to 0."""
        if not page:
            return []
        score, back = [float(x) for x in self.begin], []
        turn, get = self.turn.tolist(), self.weights.get
        for k, fs in enumerate(page):
            here = sum(get(f, 0.0) for f in fs)
            if k:
                way = [int(score[1] + turn[1][y] > score[0] + turn[0][y]) for y in (0, 1)]
                score = [score[way[y]] + turn[way[y]][y] for y in (0, 1)]
                back.append(way)
            score[1] += here
        y = int(score[1] > score[0])
        labels = [y]
        for way in reversed(back):
            y = way[y]
            labels.append(y)
        return labels[::-1]


def train_chain(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 300, ridge: float = 0.0005, rate: float = 0.3) -> ChainModel:
    """Weights of highest penalised likelihood, by adaptive gradient steps with forward-backward sums.

    Pages are rows of an array as long as the longest; steps beyond a page's end change nothing.
    """
    pages = [(x, y) for x, y in pages if x]
    names = {f: k for k, f in enumerate(sorted({f for x, _ in pages for fs in x for f in fs}))}
    n, longest = len(pages), max(len(x) for x, _ in pages)
    there = np.array([np.arange(longest) < len(x) for x, _ in pages])
    y = np.zeros((n, longest), np.int64)
    y[there] = [v for _, ys in pages for v in ys]
    ids = np.array([names[f] for x, _ in pages for fs in x for f in fs])
    sizes = np.array([len(fs) for x, _ in pages for fs in x])
    starts = np.cumsum(sizes) - sizes
    w = np.zeros(len(names) + 6)
    seen = np.full(len(w), 1e-6)
    rows = np.arange(n)
    for _ in range(rounds):
        turn, begin = w[-6:-2].reshape(2, 2), w[-2:]
        emit = np.zeros((n, longest, 2))
        emit[there, 1] = np.add.reduceat(w[ids], starts)
        fore, aft = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        fore[:, 0] = begin + emit[:, 0]
        for k in range(1, longest):
            on = np.logaddexp(fore[:, k - 1, :1] + turn[0], fore[:, k - 1, 1:] + turn[1]) + emit[:, k]
            fore[:, k] = np.where(there[:, k, None], on, fore[:, k - 1])
        for k in range(longest - 2, -1, -1):
            after = emit[:, k + 1] + aft[:, k + 1]
            on = np.logaddexp(turn[:, 0] + after[:, :1], turn[:, 1] + after[:, 1:])
            aft[:, k] = np.where(there[:, k + 1, None], on, 0)
        total = np.logaddexp(fore[:, -1, 0], fore[:, -1, 1])
        p = np.exp(fore + aft - total[:, None, None])
        grad = ridge * w
        grad[: len(names)] += np.bincount(ids, np.repeat((p[:, :, 1] - y)[there], sizes), len(names)) / n
        pair = np.exp(fore[:, :-1, :, None] + turn + (emit + aft)[:, 1:, None, :] - total[:, None, None, None])
        pair[rows[:, None], np.arange(longest - 1), y[:, :-1], y[:, 1:]] -= 1
        grad[-6:-2] += pair[there[:, 1:]].sum(0).ravel() / n
        p[rows, 0, y[:, 0]] -= 1
        grad[-2:] += p[:, 0].sum(0) / n
        seen += grad**2
        w -= rate * grad / np.sqrt(seen)
    return ChainModel({f: float(w[k]) for f, k in names.items()}, w[-6:-2].reshape(2, 2), w[-2:])


@lru_cache(1)
def trained_model() -> ChainModel:
    """Trained on TRAIN_PAGES labelled pages; the same ones each time."""
    return train_chain([labelled_blocks(p) for p in labelled_pages(TRAIN_PAGES)])


def main_text(page: str | None, model: ChainModel) -> str:
    found = blocks(page, model.known)
    return "\n\n".join(b.text for b, y in zip(found, model.decode(features(found))) if y)


def extract(pages: DataFrame, model: ChainModel | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page: its main blocks in order, joined by empty lines.

    Null and empty pages give an empty text, as do pages without main blocks.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = [main_text(h.as_py(), m) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
