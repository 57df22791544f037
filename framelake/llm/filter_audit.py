"""Audit of five filters that overlap: steps of every order, and each filter's share by potentials of removal games."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import join_crowded
from .scratch import materialize

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"


def own_failures(text: Column) -> list[Column]:
    """Which of the filters A to D a text fails, as flags: few words, repeated words, capitals, symbols."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [F.size(words) < 50, 100 * F.size(F.array_distinct(words)) < 65 * F.size(words), 100 * capitals > 5 * F.length(text), text.rlike("[#$%&*|]")]


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row: bit i of mask is set if the row fails filter i, E (a copy of a smaller doc_id's text) being the last.

    Texts are equal if their SHA-256 and length are. A null doc_id is neither smaller nor larger than another one, so its row
    never fails E and makes no other row fail; rows that share a doc_id don't make each other fail. Texts are read once;
    the least doc_id of a text with many copies is broadcast (`components.join_crowded`), so copies stay where they are.
    """
    text = F.coalesce("text", F.lit(""))
    bits = [F.when(f, F.lit(1 << i)).otherwise(0) for i, f in enumerate(own_failures(F.col("t")))]
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("t"))
    rows = rows.select("doc_id", "part", sum(bits, F.lit(0)).alias("own"), F.unhex(F.sha2("t", 256)).alias("digest"), F.octet_length("t").alias("bytes"))
    rows = materialize(rows.select("doc_id", "part", "own", F.concat("digest", F.encode(F.col("bytes").cast("string"), "utf-8")).alias("digest")), "audit-rows")
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    copy = F.when(F.col("doc_id") > F.col("least"), F.lit(1 << 4)).otherwise(0)
    return join_crowded(rows, least, "digest", "rows", rows.count()).select("doc_id", "part", (F.col("own") + copy).alias("mask"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with `good` and `toxic`: whether any of the doc_id's labels says quality 1, or toxic 1. A null doc_id has no labels.

    A doc_id with many rows gets its labels by broadcast.
    """
    said = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    named = rows.where("doc_id IS NOT NULL")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    known = named.groupBy("doc_id").agg(F.count("*").alias("rows")).join(said, "doc_id", "left").select("doc_id", "rows", flag("good"), flag("toxic"))
    return join_crowded(named, known, "doc_id", "rows", named.count()).unionByName(rows.where("doc_id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)}))


def removal_game(counts: Column, k: int) -> Column:
    """The rows that each of 2^k coalitions of filters removes: those whose mask meets it. counts: rows by mask."""
    every = F.sequence(F.lit(0), F.lit((1 << k) - 1))
    meets = lambda s: lambda acc, m: acc + F.when(m.bitwiseAND(s) != 0, F.get(counts, m)).otherwise(0)
    return F.transform(every, lambda s: F.aggregate(every, F.lit(0).cast("long"), meets(s)))


def potentials(game: Column, k: int) -> Column:
    """|S|! times the potential of every subgame S: P(S) = (v(S) + the potentials of S without one of its filters) / |S|.

    Subsets of a coalition have smaller numbers, so one pass in order has all it needs; whole numbers throughout.
    """
    ways = F.array(*[F.lit(math.factorial(max(0, n - 1))).cast("long") for n in range(k + 1)])

    def put(acc: Column, s: Column) -> Column:
        without = [F.when(s.bitwiseAND(1 << i) != 0, F.get(acc, s - (1 << i))).otherwise(0) for i in range(k)]
        return F.array_append(acc, F.get(ways, F.bit_count(s)) * F.get(game, s) + sum(without[1:], without[0]))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << k) - 1)), F.array(F.lit(0).cast("long")), put)


def interactions(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The steps of every order of the filters, one letter each, from (part, mask, good, toxic), for every part.

    Rows are counted by part and mask first; all else is arithmetic on one short row a part. A step removes what the
    coalition up to it removes and the one before it doesn't. `shapley` is k! times the Shapley value: the potential of all
    filters less the potential of all others.
    """
    k = len(filters)
    everyone = (1 << k) - 1
    cells = rows.groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    by_mask = lambda which: F.array(*[F.sum(F.when((F.col("mask") == m) & which, F.col("n")).otherwise(0)) for m in range(everyone + 1)])
    parts = cells.groupBy("part").agg(by_mask(F.lit(True)).alias("all"), by_mask(F.col("good")).alias("fine"), by_mask(F.col("toxic")).alias("bad"))
    total = F.aggregate("all", F.lit(0).cast("long"), lambda acc, n: acc + n)
    parts = parts.select("part", total.alias("total"), *[removal_game(F.col(c), k).alias(c) for c in ("all", "fine", "bad")])
    parts = parts.withColumn("potential", potentials(F.col("all"), k))
    orders = F.array(*[F.struct(F.lit("".join(filters[i] for i in p)).alias("name"), F.array(*[F.lit(1 << i) for i in p]).alias("bits")) for p in itertools.permutations(range(k))])
    steps = parts.withColumn("order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    before = F.aggregate(F.slice("order.bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda acc, bit: acc + bit)
    steps = steps.withColumns({"own": F.get("order.bits", F.col("step") - 1), "before": before})
    after, rest = F.col("before") + F.col("own"), F.lit(everyone) - F.col("own")
    gone = lambda c: F.get(c, after) - F.get(c, F.col("before"))
    return steps.select(
        "part", F.col("order.name").alias("filter_order"), "step",
        (F.col("total") - F.get("all", after)).alias("kept"),
        gone("all").alias("removed"),
        (F.get("all", F.col("own")) - gone("all")).alias("redundant"),
        (F.get("all", F.lit(everyone)) - F.get("all", rest)).alias("unique_fails"),
        gone("fine").alias("good_lost"),
        gone("bad").alias("toxic_lost"),
        (F.get("potential", F.lit(everyone)) - k * F.get("potential", rest)).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What the filters A to E remove from each source, alone and in all 120 orders.

    Result: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. Null texts
    count as empty (they fail A); a null source is the part of the empty string, with sources that are empty. An empty
    table gives an empty result. See `masks` and `labelled` for null and repeated doc_ids. Other columns are ignored.
    """
    return interactions(labelled(masks(docs), labels))


AUDIT_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), worded AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM base
), said AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > least THEN 'E' ELSE '' END AS fails
  FROM worded w LEFT JOIN said s ON w.doc_id = s.doc_id
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS letter, filter_order[1:step - 1] AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS step)
), cells AS (SELECT part, fails, good, toxic, count(*) AS n FROM failed GROUP BY ALL
), played AS (
  SELECT *, contains(fails, letter) AS here, len(list_filter(string_split(earlier, ''), lambda y: y <> '' AND contains(fails, y))) > 0 AS gone FROM cells, steps
), counted AS (
  SELECT part, filter_order, step, letter, CAST(coalesce(sum(n) FILTER (NOT gone AND NOT here), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (NOT gone AND here), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (gone AND here), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (fails = letter), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(n) FILTER (NOT gone AND here AND good), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(n) FILTER (NOT gone AND here AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM played GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM counted
"""
