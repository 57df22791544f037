"""Token counts of whole texts; huge ones in overlapping chunks that are spliced where both provably agree."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

#: Characters of a chunk, and of the overlap with the chunk before.
CHUNK, OVERLAP = 1 << 16, 1 << 9
#: Words whose token counts a worker keeps.
KEPT_WORDS = 400_000
#: Text on which the pattern below and the library cut alike; other text is cut by the library.
PLAIN = regex.compile(r"[\x09-\x0D\x20-\x7E\xA1-ɏ]*")


class Counter:
    """Counts tokens of a byte-level BPE file as its library does: the words it is cut into are encoded one by one.

    Merges never cross the borders of these words, so a text's count is the sum over its words.
    """

    def __init__(self, file: str) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file if os.path.exists(file) else public_tokenizers.path(file))
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        #: What stands this far from a chunk's border is cut as in the whole text.
        self.guard = max([0, *map(len, special)]) + 2
        self.kept: dict[str, int] = {}
        order = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(order)]
        #: The printable character that stands for each byte in such files.
        self.letters = {b: b for b in order} | {b: 256 + k for k, b in enumerate(others)}

    def of_word(self, word: str) -> int:
        n = self.kept.get(word)
        if n is None:
            if len(self.kept) >= KEPT_WORDS:
                self.kept.clear()
            n = self.kept[word] = len(self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.letters)))
        return n

    def _parts(self, text: str) -> Iterator[tuple[int, str, bool]]:
        """The text between special strings, and these."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield at, text[at : m.start()], False
            yield m.start(), m[0], True
            at = m.end()
        yield at, text[at:], False

    def words(self, text: str) -> list[tuple[int, int]]:
        """(start, number of tokens) of each word."""
        out: list[tuple[int, int]] = []
        for at, part, special in self._parts(text):
            if special:
                out.append((at, 1))
            elif PLAIN.fullmatch(part):
                out += [(at + m.start(), self.of_word(m[0])) for m in self.pattern.finditer(part)]
            elif part:
                # The library's own cut; it writes words in its letters for bytes.
                model = self.tokenizer.model
                out += [(at + a, len(model.tokenize(w))) for w, (a, _) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def whole(self, text: str) -> int:
        if PLAIN.fullmatch(text) and not (self.special and self.special.search(text)):
            found = self.pattern.findall(text)
            kept = self.kept
            try:
                return sum(map(kept.__getitem__, found))
            except KeyError:
                return sum(map(self.of_word, found))
        return sum(n for _, n in self.words(text))

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """The count of any text, at most a few chunks of which are held encoded at a time.

        A border of words p is proven stable if the chunk before and the chunk after both have it, each with `guard`
        characters beyond it. Up to p the chunk before saw all that decides its cuts; a cut depends on nothing before it,
        so from p on the chunk after goes on as the whole text would. If the overlap has no such border it is doubled,
        and where it reaches the last splice the chunk itself is.
        """
        if len(text) <= chunk:
            return self.whole(text)
        total, spliced, end = 0, 0, chunk
        left = self.words(text[:end])
        while end < len(text):
            cut, width = None, overlap
            while cut is None and end - width > spliced:
                start = end - width
                right = [(start + a, n) for a, n in self.words(text[start : start + chunk + width])]
                mine = {a for a, _ in left}
                cut = max((a for a, _ in right if start + self.guard <= a <= end - self.guard and a > spliced and a in mine), default=None)
                width *= 2
            if cut is None:
                size = 2 * (end - spliced)
                end = min(len(text), spliced + size)
                left = [(spliced + a, n) for a, n in self.words(text[spliced:end])]
                continue
            total += sum(n for a, n in left if spliced <= a < cut)
            spliced, end, left = cut, min(len(text), start + chunk + width // 2), right
        return total + sum(n for a, n in left if a >= spliced)


@lru_cache(2)
def counter(file: str) -> Counter:
    return Counter(file)


def count_tokens(docs: DataFrame, file: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens) of every row's whole text.

    Counts are those of the tokenizer file's library without added tokens; special strings inside texts are one token, as
    is its default. Null and empty texts have none. `file` is a path on every machine, or a name of a public tokenizer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(file)
        for b in batches:
            n = pa.array([c.count(t.as_py() or "") for t in b.column(1)], pa.int64())
            size = pc.fill_null(pc.cast(pc.binary_length(b.column(1)), pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
