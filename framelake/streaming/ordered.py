"""Progress streams put in order: rows wait in state until the watermark says that no earlier one can come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framelake.functions import exprs as X

from .progress import OUTPUT, Run

#: How far rows may be out of order, and how long (in event time) a job may be silent before its state goes.
DELAY, IDLE_SECS = "10 minutes", 6 * 3600.0


def _ms(us: int) -> int:
    """The first millisecond at which a watermark has passed this microsecond."""
    return -(-us // 1000)


class _InOrder(StatefulProcessor):
    """Per job: the rows that wait, its run so far, and the one timer that is set."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts_us bigint, event_id bigint, kind string, percent double")
        self.run = handle.getValueState("run", "run_no bigint, bucket int, shown double, seen_us bigint")
        self.timer = handle.getValueState("timer", "at bigint, last_us bigint")

    def _set(self, at: int, last_us: int) -> None:
        old = self.timer.get()[0] if self.timer.exists() else None
        if old != at:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)
        self.timer.update((at, last_us))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows))[["ts_us", "event_id", "kind", "percent"]].astype(object)
        new = [tuple(None if pd.isna(x) else x for x in r) for r in df.itertuples(index=False, name=None)]
        first, last = min(r[0] for r in new), max(r[0] for r in new)
        if self.timer.exists():
            at, known = self.timer.get()
            last = max(last, known)
            first_ms = min(at, _ms(first)) if self.waiting.exists() else _ms(first)
        else:
            first_ms = _ms(first)
        self.waiting.appendList(new)
        self._set(first_ms, last)
        yield pd.DataFrame(columns=OUTPUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_us = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1])) if self.waiting.exists() else []
        ready, rest = [r for r in rows if r[0] <= now_us], [r for r in rows if r[0] > now_us]
        last_us = self.timer.get()[1]
        self.timer.clear()  # it has just gone off
        *state, seen = self.run.get() if self.run.exists() else (None,)
        run, out = Run(*state), []
        for at, event_id, kind, percent in ready:
            if seen is not None and at - seen > self.idle_ms * 1000:
                run = Run()
            seen = at
            out += [x for x in [run.see(event_id, key[0], kind, percent)] if x]
        if rest:
            self.waiting.put(rest)
            self._set(_ms(rest[0][0]), last_us)
        else:
            self.waiting.clear()
            idle = last_us // 1000 + self.idle_ms
            if idle > now_us // 1000:
                self._set(idle, last_us)
        if self.timer.exists() and seen is not None:
            self.run.update((*run.state(), seen))
        else:
            self.run.clear()
        yield pd.DataFrame(out, columns=OUTPUT)

    def close(self) -> None:
        pass


def tracked(progress: DataFrame, delay: str = DELAY, idle_secs: float = IDLE_SECS) -> DataFrame:
    """Every snapshot with its run, bucket, whether the gate lets it through, and the percentage to show, as the batch
    operators see the whole table, in whatever order the rows come.

    A row comes out once the watermark (the latest time seen less `delay`) has reached its time; those still waiting when the
    stream stops come out after its restart, when later rows push the watermark on. Rows that come after the watermark has
    passed them are late: they are dropped, and Spark counts them as numRowsDroppedByWatermark. A row without a time is
    left out. State is the waiting rows and four numbers a job; what a job says after a silence of more than idle_secs of
    event time counts as a new job's, and the state of a job that has been silent so long is dropped.
    """
    df = progress.withColumns({"at": F.col("ts").cast("timestamp"), "percent": X.percent_done(F.col("elapsed_secs"), F.col("duration_secs"))})
    df = df.where("at IS NOT NULL").withWatermark("at", delay).select("job_id", "at", F.unix_micros("at").alias("ts_us"), "event_id", "kind", "percent")
    kinds = "event_id bigint, job_id bigint, run_no bigint, bucket int, emitted boolean, shown_percent double"
    return df.groupBy("job_id").transformWithStateInPandas(_InOrder(round(idle_secs * 1000)), kinds, "Append", "EventTime")


def gate(progress: DataFrame, delay: str = DELAY) -> DataFrame:
    return tracked(progress, delay).where("emitted").select("event_id", "job_id", "run_no", "bucket")


def monotone(progress: DataFrame, delay: str = DELAY) -> DataFrame:
    return tracked(progress, delay).select("event_id", "job_id", "run_no", "shown_percent")
