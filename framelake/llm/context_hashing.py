"""Fingerprints by context-triggered piecewise hashing, and their likeness."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

#: A text is cut where a hash of the last WINDOW bytes ends in `level` zero bits; the level is the least from LEAST_LEVEL on
#: at which there are no more than PIECES pieces. Above TOP_LEVEL nothing is cut. SIGNATURES levels are kept, from this one on.
WINDOW, LEAST_LEVEL, TOP_LEVEL, PIECES, SIGNATURES = 7, 2, 32, 128, 3
#: Bytes hashed at once, and cuts held before the level goes up.
STEP, HELD = 1 << 16, 4096
BASE, MIX = 0x01000193, 0x2C1B3C6D
_POWERS = [pow(BASE, j + 1, 1 << 32) for j in range(WINDOW)]
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def _rolled(block: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The hash at every byte of block: a polynomial in the last WINDOW bytes, mixed so that its low bits depend on all."""
    n = len(block)
    buf = np.zeros(n + WINDOW - 1, np.uint32)
    buf[WINDOW - 1 :] = block
    buf[WINDOW - 1 - len(before) : WINDOW - 1] = before
    h = np.zeros(n, np.uint32)
    for j, p in enumerate(_POWERS):
        h += buf[WINDOW - 1 - j : WINDOW - 1 - j + n] * np.uint32(p)
    h ^= h >> np.uint32(16)
    h *= np.uint32(MIX)
    return h ^ (h >> np.uint32(13))


def _mask(level: int) -> np.uint64:
    return np.uint64((1 << level) - 1)


def _scan(data: np.ndarray, level: int, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Ends and hashes of the pieces at `level`, or at the first higher level that leaves at most `most` at any time."""
    at, value = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for lo in range(0, len(data), STEP):
        h = _rolled(data[lo : lo + STEP], data[max(0, lo - WINDOW + 1) : lo]).astype(np.uint64)
        hit = np.flatnonzero((h & _mask(level)) == 0)
        at, value = np.concatenate([at, hit + (lo + 1)]), np.concatenate([value, h[hit]])
        while len(at) > most:
            level += 1
            at, value = _raised(at, value, level)
        if level > TOP_LEVEL:
            break
    return at, value, level


def _raised(at: np.ndarray, value: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    keep = (value & _mask(level)) == 0 if level <= TOP_LEVEL else np.zeros(len(at), bool)
    return at[keep], value[keep]


def _pieces(at: np.ndarray, n: int) -> int:
    return len(at) + (not len(at) or at[-1] != n)


def _signature(data: bytes, at: np.ndarray) -> str:
    ends = at.tolist()
    if not ends or ends[-1] != len(data):
        ends.append(len(data))
    out, lo, view = [], 0, memoryview(data)
    for hi in ends:
        c = zlib.crc32(view[lo:hi]) & 4095
        out.append(DIGITS[c >> 6] + DIGITS[c & 63])
        lo = hi
    return "".join(out)


def fingerprint(text: str) -> str:
    """The level, and the signatures of it and the next ones, with colons between; two characters for each piece. That of an
    empty text is `0:::`.

    All bytes of the text are hashed, in blocks; at most HELD cuts are held at any length, whatever the text repeats.
    """
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    if not n:
        return ":".join(["0"] + [""] * SIGNATURES)
    bytes_ = np.frombuffer(data, np.uint8)
    at, value, level = _scan(bytes_, max(LEAST_LEVEL, (n // PIECES).bit_length() - 3), HELD)
    if _pieces(at, n) > PIECES:
        while _pieces(at, n) > PIECES:
            level += 1
            at, value = _raised(at, value, level)
    else:  # Perhaps a lower level has few enough pieces too; one that reaches more than PIECES + 1 cuts hasn't.
        while level > LEAST_LEVEL:
            lower, low_value, reached = _scan(bytes_, level - 1, PIECES + 1)
            if reached > level - 1 or _pieces(lower, n) > PIECES:
                break
            at, value, level = lower, low_value, level - 1
    out = [str(level)]
    for k in range(SIGNATURES):
        out.append(_signature(data, at))
        at, value = _raised(at, value, level + k + 1)
    return ":".join(out)


def _edits(a: list[str], b: list[str]) -> int:
    """Edit distance, one column of the table in the bits of two numbers."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for y in b:
        eq = where.get(y, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right, left = down | ~(diagonal | up) & full, up & diagonal
        distance += 1 if right & last else -1 if left & last else 0
        right = (right << 1 | 1) & full
        up, down = (left << 1 | ~(diagonal | right)) & full, right & diagonal
    return distance


def likeness(a: str, b: str) -> float:
    """1 less the edit distance of both signatures of the lowest level that both have, as a share of the longer one; 1 for equal
    fingerprints, 0 if the levels are so far apart that there is none, or if one text alone is empty."""
    if a == b:
        return 1.0
    (la, *sa), (lb, *sb) = a.split(":"), b.split(":")
    shift = int(la) - int(lb)
    if abs(shift) >= SIGNATURES or not sa[0] or not sb[0]:
        return 0.0
    x, y = sa[max(0, -shift)], sb[max(0, shift)]
    x, y = [x[i : i + 2] for i in range(0, len(x), 2)], [y[i : i + 2] for i in range(0, len(y), 2)]
    return 1.0 - _edits(x, y) / max(len(x), len(y))


def edited(text: str, after: str) -> str:
    """text with its last half replaced by as many first code points of the next text, or all if it has fewer."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


RESULT = "doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
SEAM = "part int, seam string, text string"


def _judged(doc_id: object, text: str, fp: str, after: str, after_fp: str) -> tuple:
    new = edited(text, after)
    new_fp = fingerprint(new)
    return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), fp, new_fp, likeness(fp, new_fp), likeness(fp, after_fp)


def _along(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a range in order, each judged once its successor is there. The range's first text comes out as a `head`, for
    the range before it, and its last row as an unfinished `tail`."""
    part = TaskContext.get().partitionId()
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "seam", "text"]
    open_row = lambda row, seam: (row[0], len(row[1]), None, row[2], None, None, None, part, seam, row[1])
    last = None
    for b in batches:
        out = []
        for doc_id, text in zip(b["doc_id"].tolist(), b["text"].tolist()):
            row = (doc_id, text, last[2] if last and last[1] == text else fingerprint(text))
            out.append((*_judged(*last, *row[1:]), part, "", None) if last else open_row(row, "head"))
            last = row
        yield pd.DataFrame(out, columns=columns, dtype=object)
    if last:
        yield pd.DataFrame([open_row(last, "tail")], columns=columns, dtype=object)


def _across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = [_judged(*r) for r in b[["doc_id", "text", "fingerprint", "after", "after_fp"]].astype(object).itertuples(index=False, name=None)]
        yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"], dtype=object)


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint beside that of its text edited with the next row's, and beside the next row's.

    Result: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The next row is the one
    with the next larger doc_id, null ids first, and the first row's follows the last; rows of one doc_id follow each other by a hash of their
    text, equal rows in any order. A single row is its own successor. Null texts count as empty; an empty table gives an
    empty result. Texts are shuffled once, dealt by ranges of doc_id, hash and (for equal rows) place, so a doc_id on many
    rows is several ranges. A task holds a batch and one more text. Where ranges meet, one text of each goes to the range
    before it.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"__order": F.xxhash64("text"), "__place": F.monotonically_increasing_id()})
    kind = docs.schema["doc_id"].dataType
    order = ["doc_id", "__order", "__place"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("doc_id").cast("string"), "text")
    found = materialize(dealt.mapInPandas(_along, RESULT.format(id="string") + ", " + SEAM), "context-hashes", codec="zstd")
    heads = found.where("seam = 'head'").select("part", F.col("text").alias("after"), F.col("fingerprint").alias("after_fp"))
    tails = found.where("seam = 'tail'").select("part", "doc_id", "text", "fingerprint")
    # One number for each range.
    parts = heads.select(F.col("part").alias("before"))
    following = parts.withColumn("part", F.lead("before").over(Window.orderBy("before")))
    following = following.withColumn("part", F.coalesce("part", F.min("before").over(Window.partitionBy(F.lit(1)))))
    ends = tails.withColumnRenamed("part", "before").join(following, "before").join(heads, "part").select("doc_id", "text", "fingerprint", "after", "after_fp")
    out = found.where("seam = ''").drop("part", "seam", "text").unionByName(ends.mapInPandas(_across, RESULT.format(id="string")))
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
