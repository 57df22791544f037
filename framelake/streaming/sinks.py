"""Sinks for foreachBatch that hold each row once, however often a micro-batch is tried, and event streams with a dead letter."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import events

Sink = Callable[[DataFrame, int], None]


def query_of(df: DataFrame) -> str:
    """The id of the streaming query that runs this micro-batch; it stays the same when the query restarts from its checkpoint."""
    return df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"


def table_sink(root: str, name: str, only: Column | None = None) -> Sink:
    """Rows (those for which `only` holds) to root/name, a folder for each query and micro-batch.

    A micro-batch that is tried again replaces what the failed try left, so each row stands once. Read the table with
    `read_table`, which sees whole micro-batches only.
    """

    def write(df: DataFrame, epoch: int) -> None:
        rows = df if only is None else df.where(only)
        rows.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}/query={query_of(df)}/epoch={epoch}")

    return write


def read_table(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """The rows of a table_sink, with `query` and `epoch`; micro-batches that aren't whole yet are left out, and a table that
    isn't there is empty."""
    jvm = spark._jvm
    base = f"{root.rstrip('/')}/{name}"
    found = jvm.org.apache.hadoop.fs.Path(f"{base}/query=*/epoch=*/_SUCCESS")
    done = found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found)
    paths = [os.path.dirname(s.getPath().toString()) for s in done or []]
    full = f"{schema}, query string, epoch bigint"
    return spark.read.schema(full).option("basePath", base).parquet(*paths) if paths else spark.createDataFrame([], full)


def log_sink(root: str, lines: Callable[[DataFrame], DataFrame]) -> Sink:
    """Log lines of each micro-batch as text, by day, query and micro-batch; `lines` makes (day, value) of its rows."""

    def write(df: DataFrame, epoch: int) -> None:
        lines(df).write.mode("overwrite").partitionBy("day").text(f"{root.rstrip('/')}/query={query_of(df)}/epoch={epoch}")

    return write


def fan_out(sinks: list[Sink]) -> Sink:
    """Each micro-batch, computed once, to every sink in order. If one fails, the whole micro-batch is tried again from the
    first sink on, so sinks must replace what they wrote for it, as those above do."""

    def write(df: DataFrame, epoch: int) -> None:
        df.persist()
        try:
            for sink in sinks:
                sink(df, epoch)
        finally:
            df.unpersist()

    return write


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events as JSON lines in files that come in: (value)."""
    return spark.readStream.text(path)


def judged(values: DataFrame, payload: str = events.PAYLOAD) -> DataFrame:
    """(value) to (value, reason, e): the event, with the columns type, timestamp and those of payload, and why it can't be taken.

    reason is null for good events; `corrupt` for what isn't JSON or has a field of a wrong type, `unknown type` for types
    that aren't among KINDS or are missing, `no timestamp` for the rest.
    """
    schema = f"type string, timestamp bigint, {payload}, _corrupt string"
    df = values.withColumn("e", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    known = F.coalesce(F.col("e.type").isin(events.KINDS), F.lit(False))
    corrupt = F.col("value").isNull() | F.col("e").isNull() | F.col("e._corrupt").isNotNull()
    reason = F.when(corrupt, "corrupt").when(~known, "unknown type").when(F.col("e.timestamp").isNull(), "no timestamp")
    return df.select("value", reason.alias("reason"), F.col("e").dropFields("_corrupt").alias("e"))


def good_events(df: DataFrame) -> DataFrame:
    return df.where("reason IS NULL").select("e.*")


def forwarded_events(df: DataFrame) -> DataFrame:
    """The six kinds that callers get to see."""
    return good_events(df).where(F.col("type").isin(events.FORWARDED))


def dead_letters(df: DataFrame) -> DataFrame:
    return df.where("reason IS NOT NULL").select("value", "reason")


def routed(root: str, forward: Callable[[DataFrame, int], None] | None = None) -> Sink:
    """For a stream of `judged`: good events to the table `events`, forwarded kinds to `forwarded` (and to a callable, which
    may see a micro-batch twice), the rest to `dead_letters`, all in the same micro-batch."""
    part = lambda name, pick: lambda df, epoch: table_sink(root, name)(pick(df), epoch)
    sinks = [part("events", good_events), part("forwarded", forwarded_events), part("dead_letters", dead_letters)]
    if forward:
        sinks.append(lambda df, epoch: forward(forwarded_events(df), epoch))
    return fan_out(sinks)
