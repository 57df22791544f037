"""Progress and events as streams.

The gate and the running maximum depend on order. Inside a micro-batch rows are put in order of time and event; between
micro-batches they count in the order of arrival, as the batch operators would see a table that came in that order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framelake.functions import exprs as X
from framelake.operators import progress as P

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: A job that is silent for so long has ended.
IDLE_SECS = 6 * 3600.0


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that transformWithState needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def read_progress_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of progress logs as they come in; carriage returns end lines too."""
    return spark.readStream.text(path).select(F.col("value").alias("line"))


def parsed(lines: DataFrame, duration_secs: float) -> DataFrame:
    """The fields of each progress line; native expressions alone, the same as in a batch."""
    return P.parse_lines(lines.withColumns({"event_id": F.lit(None).cast("bigint"), "duration_secs": F.lit(float(duration_secs))})).drop("event_id", "line")


def enriched(lines: DataFrame, jobs: DataFrame) -> DataFrame:
    """Stream-static join with the jobs' durations and frames."""
    return P.enriched(lines, jobs)


OUTPUT = ["event_id", "job_id", "run_no", "bucket", "emitted", "shown_percent"]


class Run:
    """A job's run so far: its number, the last five per cent let through, and the most shown."""

    def __init__(self, run_no: int = 0, last: int = -1, most: float = 0.0) -> None:
        self.run_no, self.last, self.most = run_no, last, most

    def state(self) -> tuple[int, int, float]:
        return self.run_no, self.last, self.most

    def see(self, event_id: int, job_id: int, kind: str, percent: float) -> tuple | None:
        """The row of OUTPUT for a snapshot; None for other events."""
        if kind == "encoding_started":
            self.run_no, self.last, self.most = self.run_no + 1, -1, 0.0
        if kind != "encoding_progress":
            return None
        bucket = int(percent / P.GATE_PERCENT)
        emit = self.last < bucket <= P.LAST_BUCKET
        self.last, self.most = bucket if emit else self.last, max(self.most, min(100.0, max(0.0, percent)))
        return event_id, job_id, self.run_no, bucket, emit, self.most


class _Gate(StatefulProcessor):
    """Per job: the state of its run."""

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", "run_no bigint, bucket int, shown double", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        run = Run(*(self.state.get() if self.state.exists() else ()))
        out = [x for r in df.itertuples(index=False) if (x := run.see(r.event_id, key[0], r.kind, r.percent))]
        self.state.update(run.state())
        yield pd.DataFrame(out, columns=OUTPUT)

    def close(self) -> None:
        pass


def tracked(progress: DataFrame, idle_secs: float | None = IDLE_SECS) -> DataFrame:
    """Every snapshot with its run, bucket, whether the gate lets it through, and the percentage to show.

    State is three numbers for each job, dropped when the job has been silent for idle_secs (None: never): what it says
    later counts as a new job's. With a timeout Spark also runs batches without data, so give the query a trigger interval.
    """
    df = progress.withColumns({"ts": F.col("ts").cast("timestamp"), "percent": X.percent_done(F.col("elapsed_secs"), F.col("duration_secs"))})
    df = df.select("job_id", "event_id", "ts", "kind", "percent")
    return df.groupBy("job_id").transformWithStateInPandas(
        _Gate(round(idle_secs * 1000) if idle_secs else None), "event_id bigint, job_id bigint, run_no bigint, bucket int, emitted boolean, shown_percent double", "Append", "ProcessingTime" if idle_secs else "None"
    )


def gate(progress: DataFrame) -> DataFrame:
    return tracked(progress).where("emitted").select("event_id", "job_id", "run_no", "bucket")


def monotone(progress: DataFrame) -> DataFrame:
    return tracked(progress).select("event_id", "job_id", "run_no", "shown_percent")


#: A batch lasts no longer than this from its start; later results of it are late.
LASTING = "2 days"


def once(results: DataFrame, lasting: str = LASTING) -> DataFrame:
    """Results (with batch, started: when their batch began, and file_id), each file of a batch once, however often it is
    delivered: the first delivery counts. What is remembered of a batch goes when batches that began `lasting` later come in."""
    return results.withColumn("started", F.col("started").cast("timestamp")).withWatermark("started", lasting).dropDuplicatesWithinWatermark(["batch", "file_id"])


def totals(results: DataFrame, lasting: str = LASTING) -> DataFrame:
    """The sums of each batch so far, for update mode, or append mode if only ended batches are wanted.

    Rows of `once` are summed by batch and start. A batch ends when the watermark passes its start: its state goes, and
    results that still come are late, so they are dropped (Spark counts them as numRowsDroppedByWatermark).
    """
    return once(results, lasting).groupBy("batch", "started").agg(
        F.count("*").alias("successful"), F.sum("input_size").alias("input_bytes"), F.sum("output_size").alias("output_bytes"), F.sum("elapsed_ms").alias("elapsed_ms"), F.sum("video_ms").alias("video_ms"), F.count_if("is_valid").alias("passed")
    )
