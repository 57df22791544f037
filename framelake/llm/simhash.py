"""SimHash near-duplicates: 64-bit fingerprints, linked at few differing bits, found by pigeonring filtering.

A fingerprint is a ring of 8 segments of 8 bits. If two fingerprints differ in at most 3 bits, some segment starts a chain
round the ring whose first l segments differ in at most 3l/8 bits, for every l from 1 to 8. So, from the start, two segments
are equal, and of the three after them at most one differs: the equal ones are 32 bits, the key under which candidates meet
(8 starts x 3 segments that may differ). Rows of a key are then held to the budgets of the longer chain, and only what is
left to the whole Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import CROWDED, connected_components, join_crowded
from .scratch import materialize

MAX_DIFF = 3
SEGMENTS = 8
#: Fingerprints of one key compared with each other; keys with more go through flip_links.
MAX_RUN = 1024
#: Fingerprints among which keys with many are looked for beforehand, about. Those that it misses are found as they are read.
SCOUTS = 1_000_000


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """A bit is 1 if set in over half the XXH64 values of the shingles, repeats included."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)))[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)
    return _majority(h)


#: A-Z to a-z on UTF-8 bytes.
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LANES = np.uint64(0x0101010101010101)


def _majority(h: np.ndarray) -> int:
    """Bits set in over half of h. Byte lanes count one bit of each byte at a time, up to 255 values before they would overflow."""
    n = len(h)
    steps = np.arange(0, n, 255)
    out = 0
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, steps)
        counts = lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)  # lowest byte first
        for byte in np.flatnonzero(2 * counts > n):
            out |= 1 << (8 * int(byte) + k)
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _keys(fps: DataFrame) -> DataFrame:
    """(key, turned): each fingerprint under its 24 keys, turned so that the chain's start is at the top."""
    rows = []
    for start in range(SEGMENTS):
        bits = 8 * start
        fp = F.col("fp")
        turned = fp if not bits else F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, 64 - bits))
        for skip in range(3):
            mask = sum(0xFF << (56 - 8 * s) for s in range(5) if s != 2 + skip)
            shared = F.shiftrightunsigned(turned, 24).bitwiseAND(F.lit(mask >> 24))  # 40 bits, 8 of them cleared
            rows.append(F.struct(shared.bitwiseOR(F.lit((3 * start + skip) << 40)).alias("key"), turned.alias("turned")))
    return fps.select(F.explode(F.array(*rows)).alias("r")).select("r.key", "r.turned")


_FIRST5, _FIRST6, _FIRST7 = (np.uint64((1 << 64) - (1 << (64 - 8 * k))) for k in (5, 6, 7))


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs keep to the budgets of every chain from the top, the last being the whole distance."""
    d = a ^ b
    at = np.arange(len(d))
    for mask, budget in ((_FIRST5, 1), (_FIRST6, 2), (_FIRST7, 2), (np.uint64((1 << 64) - 1), MAX_DIFF)):
        at = at[np.bitwise_count(d[at] & mask) <= budget]
    return at


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index each of n rows is linked to."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _original(key: np.ndarray, turned: np.ndarray) -> np.ndarray:
    bits = np.uint64(8) * ((key.astype(np.uint64) >> np.uint64(40)) // np.uint64(3))
    return (turned >> bits) | (turned << ((np.uint64(64) - bits) & np.uint64(63)))


def _in_keys(batches: Iterator[pa.RecordBatch], max_run: int) -> Iterator[pa.RecordBatch]:
    """Links among rows sorted by key. A key of over max_run rows comes out as rows with a key instead, as they are read."""

    def out(kind: int, key: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(key), pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["kind", "key", "a", "b"])

    def links(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        left, right, at = [], [], np.arange(len(key))
        for step in range(1, max_run):
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]
            if not len(at):
                break
            near = at[_near(fp[at], fp[at + step])]
            left.append(near)
            right.append(near + step)
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            root = _forest(len(key), a, b)
            mine = np.flatnonzero(root != np.arange(len(key)))
            if len(mine):
                # A root lies in the same key, so both are turned alike.
                yield out(0, key[mine], _original(key[mine], fp[mine]), _original(key[mine], fp[root[mine]]))

    def closed(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(key):
            sizes = np.diff(np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]))
            big = np.repeat(sizes > max_run, sizes)
            if big.any():
                yield out(1, key[big], fp[big], fp[big])
            yield from links(key[~big], fp[~big])

    key, fp, over = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
    for b in batches:
        key = np.concatenate([key, b.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([fp, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if over is not None:
            n = int(np.searchsorted(key, over, "right"))
            if n:
                yield out(1, key[:n], fp[:n], fp[:n])
            key, fp = key[n:], fp[n:]
            over = over if not len(key) else None
        # Rows of the last key wait for the next batch, unless there are too many already.
        if len(key) > max_run:
            last = int(np.searchsorted(key, key[-1]))
            yield from closed(key[:last], fp[:last])
            key, fp = key[last:], fp[last:]
            if len(key) > max_run:
                over = key[-1]
                yield out(1, key, fp, fp)
                key, fp = key[:0], fp[:0]
    yield from closed(key, fp)


def flip_links(crowded: DataFrame) -> DataFrame:
    """Links among the rows (key, turned) of crowded keys, without comparing pairs.

    Rows of a key can differ in its cleared segment and in the last three: 32 bits. Two rows at 3 bits or fewer meet at a
    value one flip from one of them and two from the other. So each row goes to all values within two flips; at a value
    where some row is within one flip, every row is within 3 bits of that one, and is linked to the least such row.
    """
    low24 = [F.lit(1 << i) for i in range(24)]
    skip = ((F.shiftright("key", 40)) % 3).cast("int")
    cleared = [F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(24 + i) + 8 * (F.lit(2) - skip)).cast("int")) for i in range(8)]
    bit = F.array(*[b.cast("long") for b in low24], *cleared)
    df = crowded.withColumn("bits", bit)
    one = F.transform("bits", lambda x: F.struct(F.col("turned").bitwiseXOR(x).alias("at"), F.lit(1).alias("flips")))
    two = F.flatten(F.transform("bits", lambda x, i: F.transform(F.slice("bits", i + 2, F.lit(32)), lambda y: F.struct(F.col("turned").bitwiseXOR(x).bitwiseXOR(y).alias("at"), F.lit(2).alias("flips")))))
    none = F.array(F.struct(F.col("turned").alias("at"), F.lit(0).alias("flips")))
    spots = df.select("key", "turned", F.explode(F.concat(none, one, two)).alias("s")).select("key", "turned", "s.at", "s.flips")
    hub = spots.where("flips <= 1").groupBy("key", "at").agg(F.min("turned").alias("hub"))
    return spots.join(hub, ["key", "at"]).where("turned <> hub").select("key", F.col("turned").alias("a"), F.col("hub").alias("b")).distinct()


def _turned_back(df: DataFrame) -> DataFrame:
    def back(c: str):
        cases = F.col(c)
        start = F.floor(F.shiftright("key", 40) / 3).cast("int")
        for s in range(1, SEGMENTS):
            x = F.shiftrightunsigned(c, 8 * s).bitwiseOR(F.shiftleft(c, 64 - 8 * s))
            cases = F.when(start == s, x).otherwise(cases)
        return cases.alias(c)

    return df.select(back("a"), back("b"))


def fingerprint_links(fps: DataFrame, max_run: int = MAX_RUN) -> DataFrame:
    """Enough links (a, b) among distinct fingerprints fp to hold every linked group together."""
    keys = _keys(fps)
    # Keys that hold much of the table never meet in one task; they go where keys of over max_run rows go in any case.
    n = fps.count()
    scouts = _keys(fps.where(F.pmod(F.xxhash64("fp"), F.lit(max(1, n // SCOUTS))) == 0)).groupBy("key").count()
    full = F.greatest(F.lit(max_run), F.lit(24 * min(n, SCOUTS) // CROWDED))
    full = materialize(scouts.where(F.col("count") > full).select("key"), "simhash-crowded")
    spread = keys.join(F.broadcast(full), "key", "left_anti").repartition("key").sortWithinPartitions("key")
    found = materialize(spread.mapInArrow(lambda batches: _in_keys(batches, max_run), "kind int, key long, a long, b long"), "simhash-links")
    crowded = found.where("kind = 1").select("key", F.col("a").alias("turned"))
    if full.take(1):
        crowded = crowded.union(keys.join(F.broadcast(full), "key").select("key", "turned"))
    return found.where("kind = 0").select("a", "b").union(_turned_back(flip_links(crowded)))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_run: int = MAX_RUN) -> DataFrame:
    """Every row's doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id it is linked to, in steps.

    Texts are lower-cased A-Z and cut into words at ASCII white space; null and empty texts have fingerprint zero. Rows
    with one fingerprint are linked; a null doc_id counts only where no other one is in the component. An empty table gives
    an empty result. Links are looked for among distinct fingerprints, so copies cost one row however many there are.
    """
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "fingerprints-distinct")
    parts = connected_components(fingerprint_links(distinct.select("fp"), max_run))
    # One row for each fingerprint that has links.
    linked = materialize(parts.join(distinct, parts["node"] == distinct["fp"]).select("fp", "component", "least"), "fingerprints-linked")
    ids = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    told = join_crowded(linked.select("fp", "component"), ids, "component", "n", linked.count()).select("fp", "component_id")
    named = distinct.join(materialize(told, "fingerprints-told"), "fp", "left")
    named = materialize(named.select("fp", "rows", F.coalesce("component_id", "least").alias("component_id")), "fingerprint-components")
    # Copies of one text may be much of the table.
    out = join_crowded(prints, named, "fp", "rows", named.agg(F.sum("rows")).first()[0] or 0)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
