"""Progress of encodes: parsed lines, runs, the gate that lets a line through every five per cent, and running maxima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import exprs as X

from .numbering import scan_runs

GATE_PERCENT, LAST_BUCKET = 5, 20


def _field(name: str, line: Column) -> Column:
    """The text after name=, up to the blank that must follow it."""
    return F.regexp_extract(line, rf"{name}= *([^ \t]+)[ \t]", 1)


def line_texts(line: Column) -> dict[str, Column]:
    """The texts of frame, fps, bitrate, speed and the clock's parts in a progress line; empty where there is none."""
    return {
        "frame": _field("frame", line),
        "fps": _field("fps", line),
        "bitrate": _field("bitrate", line),
        "speed": F.regexp_extract(line, r"speed= *([^ \t\rx\n]+)", 1),
        "elapsed": F.split(F.regexp_extract(line, r"time=([0-9]{2}:[0-9]{2}:[0-9]{2}\.?[0-9]*)", 1), ":", -1),
    }


def line_fields() -> dict[str, Column]:
    """frame, fps, speed and elapsed seconds of line_texts; 0 where a field doesn't parse."""
    single = lambda c: F.coalesce(X.number(F.col(c)).cast("float").cast("double"), F.lit(0.0))
    frame = F.col("frame")
    return {
        "frame": F.coalesce(F.when(frame.rlike(r"\A[0-9]{1,18}\z"), frame.try_cast("bigint")), F.lit(0).cast("bigint")),
        "fps": single("fps"),
        "speed": single("speed"),
        "elapsed": F.coalesce(X.clock_parts_secs(F.col("elapsed")), F.lit(0.0)),
    }


def parse_lines(lines: DataFrame) -> DataFrame:
    """(event_id, line, duration_secs) to event_id, frame, fps, bitrate, speed, elapsed, percent, eta. Lines without a frame go.

    Each text is matched once, and then read from its column as often as its number needs it.
    """
    df = lines.where(F.col("line").contains("frame=")).withColumns(line_texts(F.col("line"))).withColumns(line_fields())
    percent, eta = X.percent_done(F.col("elapsed"), F.col("duration_secs")), X.eta_secs(F.col("elapsed"), F.col("duration_secs"), F.col("speed"))
    return df.withColumns({"percent": percent, "eta": eta})


def enriched(lines: DataFrame, jobs: DataFrame) -> DataFrame:
    """Lines with the duration and frames of their job; 0 where the job isn't known: event_id, job_id, frame, total_frames, percent, eta."""
    df = lines.drop("duration_secs").join(jobs, "job_id", "left")
    df = df.withColumns({"duration_secs": F.coalesce("duration_secs", F.lit(0.0)), "total_frames": F.coalesce("total_frames", F.lit(0)).cast("bigint")})
    return parse_lines(df).select("event_id", "job_id", "frame", "total_frames", "percent", "eta")


ORDER = ["ts", "event_id"]


def _started() -> Column:
    return F.col("kind") == "encoding_started"


def runs(progress: DataFrame) -> DataFrame:
    """Adds run_no: each start begins a new run of its job; what comes before the first one is run 0."""
    return scan_runs(progress, "job_id", ORDER, _started()).drop("before")


def with_percent(progress: DataFrame) -> DataFrame:
    """Adds the percentage of each snapshot, null for other events."""
    return progress.withColumn("percent", F.when(F.col("kind") == "encoding_progress", X.percent_done(F.col("elapsed_secs"), F.col("duration_secs"))))


def bucket(percent: Column) -> Column:
    return (percent / F.lit(float(GATE_PERCENT))).cast("int")


def shown(percent: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), percent))


def gate(progress: DataFrame) -> DataFrame:
    """The snapshots that reach a new five per cent of their run: event_id, job_id, run_no, bucket."""
    df = with_percent(progress).withColumn("bucket", bucket(F.col("percent"))).select("event_id", "job_id", "ts", "kind", "bucket")
    df = scan_runs(df, "job_id", ORDER, _started(), F.when(F.col("bucket") <= LAST_BUCKET, F.col("bucket")))
    new = (F.col("bucket") <= LAST_BUCKET) & (F.col("bucket") > F.coalesce("before", F.lit(-1)))
    return df.where(new).select("event_id", "job_id", "run_no", "bucket")


def monotone(progress: DataFrame) -> DataFrame:
    """The percentage to show, which never falls in a run: event_id, job_id, run_no, shown_percent."""
    df = with_percent(progress).select("event_id", "job_id", "ts", "kind", F.when(F.col("percent").isNotNull(), shown(F.col("percent"))).alias("shown"))
    df = scan_runs(df, "job_id", ORDER, _started(), F.col("shown")).where("shown IS NOT NULL")
    return df.select("event_id", "job_id", "run_no", F.greatest("shown", "before").alias("shown_percent"))


def latest(progress: DataFrame) -> DataFrame:
    """Each job's newest snapshot: job_id, event_id, elapsed_secs, percent."""
    newest = F.max_by(F.struct("event_id", "elapsed_secs", "percent"), F.struct(*ORDER))
    return with_percent(progress).where("kind = 'encoding_progress'").groupBy("job_id").agg(newest.alias("s")).select("job_id", "s.event_id", "s.elapsed_secs", "s.percent")
