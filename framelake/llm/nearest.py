"""Approximate nearest neighbours by an inverted multi-index.

Vectors, scaled to length one, are cut into halves, and each half is quantised on its own: a cell is a pair of centroids. A
query visits cells in the order of its halves' summed distances, found with a heap, until they hold enough entries; these
are reranked by their cosine.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, materialize

#: Vectors the centroids are fitted on, at most: those with the smallest hashes of vec_id.
SAMPLE = 20_000
#: Entries that a cell should hold on average, centroids of a half at most.
PER_CELL, MOST_CENTROIDS = 24, 1024
#: Entries in the cells that a query visits, at least; the share of all entries is set so that of the sample's own nearest
#: neighbours this share is found.
LEAST_ENTRIES, WANTED_RECALL, TRIAL_QUERIES = 3_000, 0.95, 256
#: Entries that stand in one row at least, queries that meet them at once.
BLOCK, QUERY_CHUNK = 4096, 1024
#: Rows that entries are dealt to, until each has GROUP_NUMBERS components: a query goes once to each that it visits.
GROUPS, GROUP_NUMBERS = 32, 1 << 21
#: Distances or cosines that are held at once, about.
HELD = 1 << 22
#: Sums of distances that differ by no more are one: they are added up again where the entries are.
SLACK = 1e-12


def usable(vectors: DataFrame) -> DataFrame:
    """(code, vec_id, embedding, copies) of vectors that have a direction; equal rows once, with their number.

    code tells rows of different id or vector apart.
    """
    v = F.col("embedding")
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    return rows.groupBy("vec_id", "embedding").agg(F.count("*").alias("copies")).withColumn("code", F.xxhash64("vec_id", "embedding"))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def sized(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near 1: exact, and squares neither over- nor underflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])


def scaled(x: np.ndarray) -> np.ndarray:
    x = sized(x)
    return x / np.sqrt((x * x).sum(1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a and b, pair by pair: the same for the same pair wherever it stands."""
    a, b = sized(a), sized(b)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)[None, :]


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    step = max(1, HELD // max(1, len(centroids)))
    return np.concatenate([distances(x[at : at + step], centroids).argmin(1) for at in range(0, len(x), step)] or [np.zeros(0, np.int64)])


def fit_centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest_centroid(x, c)
        sums, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


@dataclass
class MultiIndex:
    """Centroids of both halves, and the number of entries in each cell."""

    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray | None = None

    def cells(self, x: np.ndarray) -> np.ndarray:
        u, half = scaled(x), x.shape[1] // 2
        return nearest_centroid(u[:, :half], self.left) * len(self.right) + nearest_centroid(u[:, half:], self.right)

    def visit(self, x: np.ndarray, enough: int) -> Iterator[tuple[float, set[int]]]:
        """For each row's query, the summed distances up to which it visits cells, and the left centroids of those with entries."""
        u, half, n = scaled(x), x.shape[1] // 2, len(self.right)
        dl, dr = distances(u[:, :half], self.left), distances(u[:, half:], self.right)
        ol, orr = dl.argsort(1, kind="stable").tolist(), dr.argsort(1, kind="stable").tolist()
        counts = self.counts.tolist()
        for r in range(len(x)):
            a, b, i, j = dl[r].tolist(), dr[r].tolist(), ol[r], orr[r]
            heap, got, reach = [(a[i[0]] + b[j[0]], 0, 0)], 0, -np.inf
            lefts: set[int] = set()
            while heap and got < enough:
                reach, p, q = heapq.heappop(heap)
                here = counts[i[p] * n + j[q]]
                if here:
                    got += here
                    lefts.add(i[p])
                # Each pair is reached once: from its left neighbour in the first row, else from the one above it.
                if q + 1 < len(j):
                    heapq.heappush(heap, (a[i[p]] + b[j[q + 1]], p, q + 1))
                if q == 0 and p + 1 < len(i):
                    heapq.heappush(heap, (a[i[p + 1]] + b[j[0]], p + 1, 0))
            yield reach + SLACK, lefts

    def reached(self, x: np.ndarray, reach: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Whether each row's query visits each of the cells."""
        u, half, n = scaled(x), x.shape[1] // 2, len(self.right)
        sums = distances(u[:, :half], self.left)[:, cells // n] + distances(u[:, half:], self.right)[:, cells % n]
        return sums <= reach[:, None]

    def share_for(self, x: np.ndarray, k: int) -> float:
        """The share of entries to visit so that WANTED_RECALL of the k nearest of some rows of x, among x, are found."""
        u, half, cell = scaled(x), x.shape[1] // 2, self.cells(x)
        k, step, ahead = min(k, len(u) - 1), max(1, HELD // max(1, len(u)) // 8), []
        if k < 1:
            return 1.0
        for at in range(0, min(len(u), TRIAL_QUERIES), step):
            q = u[at : min(at + step, TRIAL_QUERIES)]
            row = np.arange(len(q))
            near = q @ u.T
            near[row, at + row] = -np.inf
            top = np.argsort(-near, 1)[:, :k]
            far = distances(q[:, :half], self.left)[:, cell // len(self.right)] + distances(q[:, half:], self.right)[:, cell % len(self.right)]
            ahead.append(np.stack([(far <= far[row, t][:, None]).mean(1) for t in top.T]))
        return float(np.quantile(np.concatenate(ahead, 1), WANTED_RECALL))


def deal(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """For each left centroid, the first of the rows that its entries are dealt to and the number of these. A row has at most
    `most` entries, about: small centroids share one, large ones have several."""
    out, last, room = [], -1, 0
    for n in sizes:
        parts = -(-n // most)
        if parts > 1:
            out.append((last + 1, parts))
            last, room = last + parts, 0
            continue
        if n > room or last < 0:
            last, room = last + 1, most
        out.append((last, 1))
        room -= n
    return out


def search(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The k nearest of each query: query_id, rank (from 1), vec_id, score (cosine in double precision).

    Queries are the rows whose vec_id is divisible by `every`, candidates all rows but the query's own; ties go to the
    smaller vec_id. Rows that share a vec_id, with equal vectors or others, are queries and candidates each. Vectors that
    are null, zero, or hold null or non-finite components take no part; vectors of one length are searched among
    themselves, since there is no angle between others. An empty table gives an empty result.
    """
    kind = dict(vectors.dtypes)["vec_id"]
    rows = materialize(usable(vectors).withColumn("length", F.size("embedding")), "nearest-rows")
    out = vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    lengths = [r["length"] for r in rows.groupBy("length").count().orderBy("length").collect()]
    parts = [_entries_and_queries(rows.where(F.col("length") == n).drop("length"), k, every) for n in lengths]
    discard(rows)
    for entries, queries in parts:
        out = out.union(_search(entries, queries, k))
    return out


def _entries_and_queries(rows: DataFrame, k: int, every: int) -> tuple[DataFrame, DataFrame]:
    """Of usable rows: of equal vectors only the k + 1 first rows by vec_id, since no others can be among the nearest; and the queries."""
    first = Window.partitionBy("embedding").orderBy("vec_id")
    entries = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    entries = entries.select("code", "vec_id", "embedding", F.least("copies", F.lit(k + 1)).cast("int").alias("copies"))
    return materialize(entries, "nearest-entries"), materialize(rows.where(F.col("vec_id") % every == 0), "nearest-queries")


def _sample(entries: DataFrame, total: int) -> DataFrame:
    """The SAMPLE entries with the smallest hashes of vec_id. Most others are left out before they are put in order, by one task."""
    h = F.xxhash64("vec_id")
    if total > 2 * SAMPLE:
        few = entries.where(h < int(2 * SAMPLE / total * 2**64) - 2**63)
        entries = few if few.count() >= SAMPLE else entries
    return entries.orderBy(h, "vec_id", "code").limit(SAMPLE)


def _search(entries: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """search among entries of one length.

    Entries are stored in rows of bounded size, and queries meet them in chunks, so a crowded cell is many rows. A query is
    sent to a row of entries with the distance up to which it visits cells, not with the cells. The join is by merge: Spark
    takes the queries, exploded to rows of entries, for as small as their file, and would broadcast them.
    """
    spark = entries.sparkSession
    kind, vector = dict(entries.dtypes)["vec_id"], dict(entries.dtypes)["embedding"]
    total = entries.count()
    sample = _sample(entries, total).select("embedding").toArrow().column(0).combine_chunks()
    x = scaled(matrix(sample.chunk(0) if isinstance(sample, pa.ChunkedArray) else sample))
    half = x.shape[1] // 2
    size = int(min(MOST_CENTROIDS, max(1, round((total / PER_CELL) ** 0.5))))
    index = MultiIndex(fit_centroids(x[:, :half], size), fit_centroids(x[:, half:], size))
    fitted = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fitted.value.cells(matrix(b.column(2))).astype(np.int32))], ["code", "vec_id", "embedding", "copies", "cell"])

    placed = materialize(entries.mapInArrow(place, f"code long, vec_id {kind}, embedding {vector}, copies int, cell int"), "nearest-cells")
    discard(entries)
    # At most MOST_CENTROIDS^2 numbers.
    counts = np.zeros(len(index.left) * len(index.right), np.int64)
    found = placed.groupBy("cell").count().toArrow()
    counts[found.column(0).to_numpy()] = found.column(1).to_numpy()
    enough = int(max(LEAST_ENTRIES, index.share_for(x, k) * total)) + k + 1
    n_right = len(index.right)
    most = max(BLOCK, min(-(-total // GROUPS), GROUP_NUMBERS // x.shape[1]))
    dealt = deal(counts.reshape(-1, n_right).sum(1).tolist(), most)
    counted = spark.sparkContext.broadcast(MultiIndex(index.left, index.right, counts))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                found = list(counted.value.visit(matrix(part.column(1)), enough))
                groups = [sorted({dealt[x][0] + n for x in lefts for n in range(dealt[x][1])}) for _, lefts in found]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([r for r, _ in found], pa.float64()), pa.array(groups, pa.list_(pa.int32()))], ["asked", "query", "reach", "groups"])

    chunks = max(1, -(-queries.count() // QUERY_CHUNK))
    visits = queries.select("code", "embedding").mapInArrow(visit, f"asked long, query {vector}, reach double, groups array<int>")
    visits = visits.select("asked", "query", "reach", F.explode("groups").alias("group"), F.pmod(F.xxhash64("asked"), F.lit(chunks)).alias("chunk"))
    # Dealt by group at once, where entries are met: the chunks are laid together there.
    asked = visits.repartition("group").groupBy("group", "chunk").agg(F.collect_list(F.struct("asked", "query", "reach")).alias("q"))
    known = spark.createDataFrame([(i, *x) for i, x in enumerate(dealt)], "left int, first int, parts int")
    held = placed.withColumn("left", F.floor(F.col("cell") / n_right).cast("int")).join(F.broadcast(known), "left")
    held = held.withColumn("group", F.col("first") + F.pmod(F.xxhash64("code"), F.col("parts").cast("long")).cast("int"))
    held = held.groupBy("group").agg(F.collect_list(F.struct("code", "embedding", "cell", "vec_id", "copies")).alias("e"))

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                asking, entry = b.column(0)[i].values, b.column(1)[i].values
                every, e = matrix(asking.field(1)), matrix(entry.field(1))
                codes, reach = (asking.field(n).to_numpy(zero_copy_only=False) for n in (0, 2))
                en, ids, copies = (entry.field(n).to_numpy(zero_copy_only=False) for n in (0, 3, 4))
                cells, cell = np.unique(entry.field(2).to_numpy(zero_copy_only=False), return_inverse=True)
                unit, step = scaled(e).T, max(1, HELD // max(len(e), len(cells)))
                for at in range(0, len(every), step):
                    q, qn = every[at : at + step], codes[at : at + step]
                    near = scaled(q) @ unit
                    # The query's own row is none of its candidates; equal rows beside it are.
                    near[~counted.value.reached(q, reach[at : at + step], cells)[:, cell] | ((qn[:, None] == en[None, :]) & (copies < 2)[None, :])] = -np.inf
                    last = np.partition(near, -k, 1)[:, -k] if near.shape[1] > k else np.full(len(q), -2.0)
                    # Near ties stay in; the exact measure and the ids decide.
                    a, c = np.nonzero(near >= np.maximum(-2.0, last - 1e-9)[:, None])
                    score = cosines(q[a], e[c])
                    order = np.lexsort((ids[c], -score, a))
                    a, c, score = a[order], c[order], score[order]
                    best = np.arange(len(a)) - np.searchsorted(a, a, "left") < k
                    a, c, score = a[best], c[best], score[best]
                    times = np.minimum(k, copies[c] - (qn[a] == en[c])).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(qn[a]), pa.array(ids[c]), pa.array(score), pa.array(times)], ["asked", "vec_id", "score", "times"])

    met = asked.join(held.hint("merge"), "group").select("q", "e")
    found = met.mapInArrow(rerank, f"asked long, vec_id {kind}, score double, times int")
    found = found.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("again", "times")
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # Equal query rows, laid out from blocks, have one answer.
    block = F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / BLOCK))
    named = queries.select(F.col("code").alias("asked"), F.col("vec_id").alias("query_id"), F.explode(block).alias("at"), "copies")
    named = ranked.join(named, "asked").withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(BLOCK), F.col("copies") - F.col("at") * BLOCK))))
    return named.select("query_id", "rank", "vec_id", "score")
