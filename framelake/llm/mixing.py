"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hashing import HASH_BITS, hash52
from .scratch import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Sources whose plan, of one short row each, goes whole to every executor; more are joined by source and salt.
BROADCAST_SOURCES, SALTS = 100_000, 64
#: Repeats of a row that are laid out from one row.
REPEATS = 4096
#: Ranges of the record hash in which a source's words are summed before the one that holds the cut is looked into.
CUT_RANGES = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Add `target` to (source, source_size, weight): the budget shared by weight, no source above max_epochs times its size.

    Clamping the sources above their cap and sharing their excess by weight, again and again, fills sources in the order of
    cap over weight. So one pass in that order finds all that end up clamped: a source is, if its share of what is left by
    those before it is above its own cap. The table has one row for each source; only this pass orders them all.
    """
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    ahead, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    df = df.withColumn("total", F.sum("source_size").over(every) * F.lit(float(budget)))
    left = F.col("total") - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))
    df = df.withColumn("clamped", F.col("weight") * left / F.sum("weight").over(rest) > F.col("cap"))
    df = df.withColumn("left", F.col("total") - F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))).over(every), F.lit(0.0)))
    df = df.withColumn("shared", F.sum(F.when(~F.col("clamped"), F.col("weight"))).over(every))
    return df.withColumn("target", F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("weight") * F.col("left") / F.col("shared"))).drop(
        "cap", "total", "clamped", "left", "shared"
    )


def mixing_plan(rows: DataFrame, weights: Sequence[float], budget: float, max_epochs: float) -> DataFrame:
    """For each source of (doc_id, source, size, order_hash, range): target, whole repetitions, and which records get one more.

    A record is all rows that share order_hash, doc_id and size. A source's fractional repetition goes to the rows that come
    first by seeded hash, up to the one nearest to the target: to all rows of records up to `last`, and to `some` rows of
    the record `split`. Only sums by hash range, and the records of the one range with the cut, are put in order.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), rank % len(weights))
    plan = water_fill(sizes.withColumn("weight", weight), budget, max_epochs).drop("weight")
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("part", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    plan = materialize(plan, "mixing-plan")

    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("words")).withColumn("ahead", F.coalesce(F.sum("words").over(before), F.lit(0)))
    p = plan.select(F.col("source").alias("p_source"), "part")
    cut = ranges.join(p, F.col("source").eqNullSafe(F.col("p_source"))).where((F.col("ahead") <= F.col("part")) & (F.col("part") < F.col("ahead") + F.col("words")))
    cut = cut.select("p_source", F.col("range").alias("p_range"), "ahead", "part")
    inside = rows.join(cut, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("range") == F.col("p_range")))
    inside = inside.groupBy("source", "order_hash", "doc_id", "size", "ahead", "part").agg(F.count("*").alias("rows"))
    upto = Window.partitionBy("source").orderBy("order_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = 2 * F.col("part") - 2 * (F.col("ahead") + F.coalesce(F.sum(F.col("rows") * F.col("size")).over(upto), F.lit(0)))
    some = F.when(F.col("size") == 0, F.when(room >= 0, F.col("rows")).otherwise(0)).otherwise(F.floor((room - F.col("size")) / (2 * F.col("size"))) + 1)
    record = F.struct("order_hash", "doc_id", "size")
    dealt = inside.withColumn("some", F.greatest(F.lit(0), F.least(some, F.col("rows"))).cast("long")).where(F.col("some") > 0)
    broken = F.col("some") < F.col("rows")
    last = dealt.groupBy(F.col("source").alias("l_source")).agg(F.max(F.when(~broken, record)).alias("last"), F.max(F.when(broken, record)).alias("split"), F.max(F.when(broken, F.col("some"))).alias("some"))
    start = cut.select(F.col("p_source").alias("c_source"), F.shiftleft(F.col("p_range").cast("long"), HASH_BITS - CUT_RANGES.bit_length() + 1).alias("cut_start"))
    plan = plan.join(start, F.col("source").eqNullSafe(F.col("c_source")), "left").join(last, F.col("source").eqNullSafe(F.col("l_source")), "left")
    return plan.select("source", "source_size", "target", "whole", "cut_start", "last", "split", "some")


def _ordered(docs: DataFrame, seed: int, *more: str) -> DataFrame:
    """Adds what a row is chosen by: size, a hash of doc_id, text and `more`, and the hash's range."""
    parts = [F.col("doc_id"), F.coalesce("text", F.lit("")), *map(F.col, more)]
    rows = docs.withColumn("size", n_words(F.col("text"))).withColumn("order_hash", hash52(F.lit("mix"), F.lit(seed), *parts))
    return rows.withColumn("range", F.shiftright("order_hash", HASH_BITS - CUT_RANGES.bit_length() + 1).cast("int"))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with source and order_hash, joined to their source's plan; a source with much of the table stays spread out."""
    plan = plan.select(F.col("source").alias("m_source"), F.col("source_size").alias("m_size"), F.col("target").alias("m_target"), "whole", "cut_start", "last", "split", "some")
    same = F.col("source").eqNullSafe(F.col("m_source"))
    if plan.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(plan), same)
    salted = plan.withColumn("m_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", (F.col("order_hash") % SALTS).cast("int")).join(salted, same & (F.col("salt") == F.col("m_salt")))


def _dealt(rows: DataFrame, plan: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of all rows, and `copies`: whole repetitions, and one more for rows before the cut.

    Rows of a split record are counted and laid out again, so that the right number of them gets one more.
    """
    plan = materialize(plan, "mixing-cuts")
    record = F.struct("order_hash", "doc_id", "size")
    df = _with_plan(rows, plan)
    first = (F.col("size") > 0) & ((F.col("order_hash") < F.col("cut_start")) | (record <= F.col("last")))
    more = F.when(F.coalesce(first, F.lit(False)), F.lit(1)).otherwise(F.lit(0))
    if not plan.where("split IS NOT NULL").take(1):
        return df.select(*keep, (F.col("whole") + more).alias("copies"))
    apart = F.col("split").isNotNull() & record.eqNullSafe(F.col("split"))
    out = df.where(~apart).select(*keep, (F.col("whole") + more).alias("copies"))
    few = df.where(apart).groupBy(*keep, "whole", "some").agg(F.count("*").alias("rows"))
    few = few.withColumn("k", F.explode(F.array(F.struct(F.col("some").alias("n"), F.lit(1).alias("more")), F.struct((F.col("rows") - F.col("some")).alias("n"), F.lit(0).alias("more")))))
    few = few.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("k.n") - 1) / REPEATS))))
    size = F.least(F.lit(REPEATS), F.col("k.n") - F.col("block") * REPEATS)
    return out.union(few.withColumn("row_no", F.explode(F.sequence(F.lit(1).cast("long"), size))).select(*keep, (F.col("whole") + F.col("k.more")).alias("copies")))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """How often the mix takes each row of (doc_id, source, text): doc_id, size, source_size, target, taken.

    Sizes are words. Sources by code point, null last, get the weights in turn and share `budget` times all words, at most
    `max_epochs` times their own. A row is taken whole, floor or ceiling of its source's rate; which rows get one more
    depends on seed, doc_id and text alone, and of equal rows on their number, so null and repeated doc_ids are dealt like
    others. Null texts have size 0. An empty table gives an empty result.
    """
    rows = materialize(_ordered(docs.select("doc_id", "source", "text"), seed).drop("text"), "mixing-rows")
    out = _dealt(rows, mixing_plan(rows, weights, budget, max_epochs), ["doc_id", "size", "m_size", "m_target"])
    return out.select("doc_id", "size", F.col("m_size").alias("source_size"), F.col("m_target").alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


def mix_rows(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """The mix itself: every row of docs, all columns, as often as `mix` takes it; of rows that differ in other columns alone,
    these decide which get one more. Rows without words count for nothing in a target: they follow their source's whole
    repetitions, none more, so a source without any words has none of its rows in the mix. No row is repeated more than
    max_epochs times. Up to BROADCAST_SOURCES sources, texts aren't shuffled."""
    others = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    packed = docs.select(F.struct("*").alias("row"), "doc_id", "source", "text", F.xxhash64(F.lit(0), *others).alias("other"))
    packed = _ordered(packed, seed, "other").select("row", "doc_id", "source", "size", "order_hash", "range")
    rows = materialize(packed.drop("row"), "mixing-rows")
    copies = _dealt(packed, mixing_plan(rows, weights, budget, max_epochs), ["row"]).where(F.col("copies") > 0)
    return copies.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")


MIXING_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix:17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) AS h
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS weight
  FROM base GROUP BY source
), capped AS (
  SELECT *, source_size * 2e0 AS cap, sum(source_size) OVER () * 1.5e0 AS total FROM sizes
), flagged AS (
  SELECT *, weight * (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) > cap AS clamped
  FROM capped
), targets AS (
  SELECT source, source_size, CASE WHEN clamped THEN cap
    ELSE weight * (total - coalesce(sum(CASE WHEN clamped THEN cap END) OVER (), 0e0)) / sum(CASE WHEN NOT clamped THEN weight END) OVER () END AS target
  FROM flagged
), split AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets
), ordered AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM base
)
SELECT o.doc_id, o.size, s.source_size, s.target,
  CAST(o.size * (s.whole + CASE WHEN 2 * o.ahead + o.size <= 2 * greatest(0e0, s.target - s.whole * s.source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ordered o JOIN split s ON o.source IS NOT DISTINCT FROM s.source
"""
