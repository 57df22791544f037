"""Connected components of a table of links, and joins in which one key may hold much of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize

#: A key with one in so many of all rows, and no fewer than FEW, is crowded; there can be no more crowded ones than CROWDED.
CROWDED, FEW = 1000, 200


def is_crowded(weight: str, total: int) -> Column:
    return F.col(weight) >= F.lit(max(FEW, -(-total // CROWDED)))


def join_crowded(rows: DataFrame, known: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows joined with known, one row for each key; weight: how many of the `total` rows the key has.

    Crowded keys are broadcast, so that their rows stay where they are; the others meet by key.
    """
    if total < FEW:
        return rows.join(known.drop(weight), key)
    crowded = F.broadcast(known.where(is_crowded(weight, total)).drop(weight))
    rest = rows.join(crowded.select(key), key, "left_anti").join(known.where(~is_crowded(weight, total)).drop(weight), key)
    return rows.join(crowded, key).unionByName(rest)


def _state(links: DataFrame) -> tuple[int, int]:
    r = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], int(r[1] or 0)


def _towards_least(pairs: DataFrame, total: int | None, keep_all: bool) -> DataFrame:
    """Link the neighbours of each node to the least of them and itself: the larger ones (large star), or all smaller ones
    and the node itself (small star, where pairs run from the larger node to the smaller one). total: the number of pairs,
    if some node may be crowded."""
    least = pairs.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
    joined = join_crowded(pairs, least, "a", "n", total) if total else pairs.join(least.drop("n"), "a")
    if keep_all:
        out = joined.select(F.col("b"), F.col("m")).union(least.select(F.col("a").alias("b"), F.col("m")))
        return out.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b), component being its least node.

    Large stars and small stars take turns until the links no longer change; every node then hangs on its least one. Each
    round is written to the shared folder; the driver sees a count and a checksum. Null ends are ignored, loops are not
    nodes. Nodes with many links are crowded keys of the joins.
    """
    now = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(now)
    while state[0]:
        both, total = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), 2 * state[0]
        # A node gets no more smaller neighbours by a large star than it had neighbours.
        hot = total >= FEW and bool(both.groupBy("a").agg(F.count("*").alias("n")).where(is_crowded("n", total)).take(1))
        large = _towards_least(both, total if hot else None, keep_all=False)
        large = materialize(large, "links") if hot else large
        small = materialize(_towards_least(large, total if hot else None, keep_all=True), "links")
        new = _state(small)
        discard(now)
        if hot:
            discard(large)
        now = small
        if new == state:
            break
        state = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
