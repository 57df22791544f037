"""Sharding by rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hashing import HASH_BITS, hash52, unit
from .scratch import materialize

#: Ranges of the record hash into which each shard is cut to number its rows in parallel.
SLOT_RANGES = 1024
#: Repeats of a row that are numbered as one record.
REPEATS = 4096


def shard_score(key: Column, shard: Column, weight: Column) -> Column:
    """The least score over all shards wins; a shard wins a share of the keys in proportion to its weight."""
    return -F.log(unit(hash52(shard, key))) / weight


def assign_shards(df: DataFrame, key: Column, shards: Sequence[tuple[int, float]], extra: tuple[int, float] | None = None) -> DataFrame:
    """Add `shard`, and `grown_shard`: where the key goes if `extra` joins the shards (null without it).

    Only the key and the list of shards decide. Each shard draws its score from its own hash of the key, so another
    shard takes rows only into itself, and about its share of the weight. Weights must be above zero.
    """
    if not shards or any(w <= 0 for _, w in [*shards, *([extra] if extra else [])]):
        raise ValueError("shards need weights above zero")
    table = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(float(w)).alias("w")) for i, w in shards])
    best = F.array_min(F.transform(table, lambda s: F.struct(shard_score(key, s["id"], s["w"]).alias("score"), s["id"].alias("id"))))
    df = df.withColumn("__best", best)
    grown: Column = F.lit(None).cast("int")
    if extra:
        new = F.struct(shard_score(key, F.lit(extra[0]), F.lit(float(extra[1]))).alias("score"), F.lit(extra[0]).alias("id"))
        grown = F.least(F.col("__best"), new)["id"]
    return df.withColumns({"shard": F.col("__best")["id"], "grown_shard": grown}).drop("__best")


def shard_documents(docs: DataFrame, n_shards: int, weights: Sequence[float] | None = None, overhead: int = 16) -> DataFrame:
    """Every row's shard by the law `key`, and its place in the shard.

    Result: doc_id, size (UTF-8 bytes plus `overhead`), text_crc32, law, shard, slot, grown_shard. Rows of one doc_id share
    a shard whatever their texts. Slots count from 0 without gaps in each shard, by a hash of doc_id, checksum, size and,
    of repeated rows, the number of their block. A null text counts as empty (checksum 0), a null doc_id as a key of its
    own. An empty table gives an empty result. Repeated rows are counted before the shuffle, and laid out again from blocks
    of REPEATS, so neither a key nor a row that holds much of the table meets in one task; a shard's rows are numbered in
    `SLOT_RANGES` hash ranges whose sizes alone are summed up.
    """
    w = list(weights) if weights is not None else [1.0] * n_shards
    shards = list(enumerate(w))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    # Scores are drawn where the rows are read, by as many tasks as there is text.
    rows = assign_shards(rows, F.col("doc_id"), shards, (n_shards, 1.0)).groupBy("doc_id", "size", "text_crc32", "shard", "grown_shard").agg(F.count("*").alias("copies"))
    last = F.floor((F.col("copies") - 1) / REPEATS)
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = rows.withColumn("copies", F.least(F.lit(REPEATS), F.col("copies") - F.col("block") * REPEATS))
    rows = rows.withColumn("order_hash", hash52(F.lit("slot"), F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("block")))
    rows = materialize(rows.withColumn("range", F.shiftright("order_hash", HASH_BITS - SLOT_RANGES.bit_length() + 1).cast("int")), "sharding-rows")

    # At most shards x SLOT_RANGES rows.
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("shard", "range").agg(F.sum("copies").alias("in_range"))
        .select("shard", "range", F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("shard", "range").orderBy("order_hash", "doc_id", "text_crc32", "size", "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("ahead", F.coalesce(F.sum("copies").over(within), F.lit(0))).join(F.broadcast(offsets), ["shard", "range"])
    return placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("ahead") + F.col("copy")).alias("slot"), "grown_shard"
    )


SHARDING_SQL = """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t
), base AS (
  SELECT doc_id, coalesce(text, '') AS body, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k FROM documents
), hexed AS (
  SELECT doc_id, k, body, hex(encode(body)) AS digits FROM base
), sized AS (
  SELECT doc_id, k, CAST(strlen(body) + 16 AS BIGINT) AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(digits, '..'), lambda d: CAST(('0x' || d) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295::BIGINT) AS text_crc32
  FROM hexed, crc_table
), scored AS (
  SELECT *, list_transform(range(41), lambda s: {'score': -ln((CAST('0x' || substr(md5(s || ':' || k), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0), 'id': s}) AS scores,
    (row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1) // 4096 AS block
  FROM sized
), placed AS (
  SELECT *, CAST(list_min(scores[1:40]).id AS INTEGER) AS shard, CAST(list_min(scores).id AS INTEGER) AS grown_shard,
    CAST('0x' || substr(md5('slot:' || k || ':' || text_crc32 || ':' || size || ':' || block), 1, 13) AS BIGINT) AS order_hash
  FROM scored
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY order_hash, doc_id NULLS FIRST, text_crc32, size, block) - 1 AS slot, grown_shard
FROM placed
"""
