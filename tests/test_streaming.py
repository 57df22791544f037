"""Streams give what the batch operators give on the same rows."""

import datetime
import glob
import os
import random
import time
import uuid

from pyspark.sql import functions as F

from framelake.operators import events, progress, results
from framelake.plans import catalogue_events
from framelake.plans.relations import relation
from framelake.streaming import ordered, sinks
from framelake.streaming import progress as S

SF = "/root/testdata/sf0.001"


def run(df, mode="append", sink=None, rows=None):
    """rows: of a stream with a timeout, which never runs out of batches, how many to wait for."""
    name = f"s{uuid.uuid4().hex}"
    w = df.writeStream.outputMode(mode)
    w = w.trigger(processingTime="500 milliseconds") if rows else w
    q = (w.foreachBatch(sink) if sink else w.format("memory").queryName(name)).start()
    if rows:
        until = time.time() + 90
        while sum(p["numInputRows"] for p in q.recentProgress) < rows and time.time() < until:
            time.sleep(0.2)
    else:
        q.processAllAvailable()
    q.stop()
    return None if sink else df.sparkSession.table(name)


def as_stream(spark, df, path, by, parts=3):
    """The rows in files that follow each other in order, one for each micro-batch."""
    rows = df.orderBy(*by).collect()
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def same(a, b):
    columns = sorted(b.columns)
    assert sorted(map(repr, a.select(*columns).collect())) == sorted(map(repr, b.select(*columns).collect()))


def test_gate_and_maximum(spark, tmp_path):
    batch = relation(spark, SF, "m_progress")
    stream = as_stream(spark, batch, str(tmp_path / "in"), ["ts", "event_id"])
    same(run(S.gate(stream), rows=batch.count()), progress.gate(batch))
    same(run(S.monotone(stream), rows=batch.count()), progress.monotone(batch))


def test_state_of_silent_jobs_is_dropped(spark, tmp_path):
    rows = [(n, 1, f"2024-01-01 00:00:{n:02d}", "encoding_started" if n == 0 else "encoding_progress", 30.0 * n, 300.0) for n in range(4)]
    batch = spark.createDataFrame(rows, "event_id bigint, job_id bigint, ts string, kind string, elapsed_secs double, duration_secs double").selectExpr("event_id", "job_id", "cast(ts as timestamp_ntz) as ts", "kind", "elapsed_secs", "duration_secs")
    runs = lambda idle: {r["event_id"]: r["run_no"] for r in run(S.tracked(as_stream(spark, batch, str(tmp_path / f"in{idle}"), ["event_id"], parts=4), idle), rows=idle and 4).collect()}
    assert runs(None) == runs(3600.0) == {1: 1, 2: 1, 3: 1}
    assert runs(0.001) == {1: 0, 2: 0, 3: 0}


def test_parsed_lines(spark, tmp_path):
    batch = relation(spark, SF, "m_line")
    batch.select("line").coalesce(1).write.text(str(tmp_path / "lines"))
    got = run(S.parsed(S.read_progress_lines(spark, str(tmp_path / "lines")), 300.0))
    same(got.select("frame", "percent", "eta"), progress.parse_lines(batch).select("frame", "percent", "eta"))
    jobs = batch.where("job_id % 2 = 0").select("job_id").distinct().withColumns({"duration_secs": F.lit(300.0), "total_frames": F.lit(9)})
    same(run(S.enriched(as_stream(spark, batch, str(tmp_path / "in"), ["event_id"]), jobs)), progress.enriched(batch, jobs))


RESULTS = "batch int, started timestamp, file_id bigint, input_size bigint, output_size bigint, elapsed_ms bigint, video_ms bigint, is_valid boolean"


def results_of(spark, batches, day=1, files=10):
    rows = [(b, datetime.datetime(2024, 1, day, b), 100 * b + i, 10 * i, 4 * i, i, 2 * i, i % 2 == 0) for b in batches for i in range(files)]
    return spark.createDataFrame(rows, RESULTS)


def in_files(spark, parts, path):
    """Each part is a file, and a micro-batch."""
    for k, df in enumerate(parts):
        df.coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):
            if f.endswith(".parquet") and not f.startswith("k"):
                os.rename(f"{path}/{f}", f"{path}/k{k:03d}-{f}")
                os.utime(f"{path}/k{k:03d}-{f}", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


SUMS = ["batch", "successful", "input_bytes", "output_bytes", "elapsed_ms", "video_ms", "passed"]


def test_totals_count_each_result_once(spark, tmp_path):
    """Delivered twice, in the same micro-batch or another: counted once, as the batch summary has it."""
    rows = results_of(spark, [0, 1, 2])
    stream = in_files(spark, [rows.where("file_id % 2 = 0"), rows.union(rows.where("batch = 1")), rows], str(tmp_path / "in"))
    got = run(S.totals(stream), "update")
    last = got.groupBy("batch").agg(F.max("successful").alias("successful"), *[F.max(c).alias(c) for c in SUMS[2:]])
    same(last, results.summary(rows, rows).select(*SUMS))


def test_state_of_ended_batches_goes(spark, tmp_path):
    """Batches that began two days before the newest one are ended: final sums come once, and later results are late. Spark
    lets a watermark take effect on late rows one micro-batch after it ends states."""
    parts = [results_of(spark, [0, 1]), results_of(spark, [5], day=9), results_of(spark, [6], day=9), results_of(spark, [1], files=12), results_of(spark, [7], day=20), results_of(spark, [8], day=20)]
    stream = in_files(spark, parts, str(tmp_path / "in"))
    q = S.totals(stream).writeStream.outputMode("append").format("memory").queryName("ended").start()
    q.processAllAvailable()
    state = q.lastProgress["stateOperators"]
    dropped = sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"])
    q.stop()
    got = spark.table("ended")
    assert sorted((r["batch"], r["successful"]) for r in got.collect()) == [(0, 10), (1, 10), (5, 10), (6, 10)]
    assert dropped == 12 and sorted(o["numRowsTotal"] for o in state) == [2, 20]


def test_each_row_once_after_a_failure_between_two_sinks(spark, tmp_path):
    """The first sink has written a micro-batch when the second one fails; after a restart both hold each row once."""
    rows = results_of(spark, [0, 1, 2])
    stream = in_files(spark, [rows.where(f"batch = {b}") for b in range(3)], str(tmp_path / "in"))
    root, failed = str(tmp_path / "out"), []

    def breaks(df, epoch):
        if epoch == 1 and not failed:
            df.limit(3).write.mode("overwrite").parquet(f"{root}/some/query={sinks.query_of(df)}/epoch={epoch}")  # half done
            failed.append(epoch)
            raise RuntimeError("between two sinks")

    both = sinks.fan_out([sinks.table_sink(root, "all"), breaks, sinks.table_sink(root, "some", F.col("is_valid"))])
    for _ in range(2):
        q = stream.writeStream.foreachBatch(both).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        try:
            q.processAllAvailable()
        except Exception as e:
            assert "between two sinks" in str(e)
        q.stop()
    assert failed == [1]
    same(sinks.read_table(spark, root, "all", RESULTS).drop("query", "epoch"), rows)
    same(sinks.read_table(spark, root, "some", RESULTS).drop("query", "epoch"), rows.where("is_valid"))
    assert sinks.read_table(spark, root, "none", RESULTS).count() == 0


def test_a_failed_try_is_not_read(spark, tmp_path):
    sinks.table_sink(str(tmp_path), "t")(spark.range(3).selectExpr("id as batch"), 0)
    os.remove(glob.glob(f"{tmp_path}/t/*/*/_SUCCESS")[0])
    assert sinks.read_table(spark, str(tmp_path), "t", "batch bigint").count() == 0


def shuffled_files(spark, batch, path, spread_secs, parts=6, seed=1):
    """The rows in files, each at most spread_secs later than its place; then a row that pushes the watermark on."""
    df = batch.withColumn("__at", F.col("ts").cast("timestamp").cast("double") + F.rand(seed) * spread_secs)
    rows = [r for r in df.orderBy("__at").drop("__at").collect()]
    size = -(-len(rows) // parts)
    cut = [spark.createDataFrame(random.Random(k).sample(rows[k * size : (k + 1) * size], len(rows[k * size : (k + 1) * size])), batch.schema) for k in range(parts)]
    end = batch.limit(1).withColumns({"ts": F.lit("2099-01-01 00:00:00").cast("timestamp_ntz"), "job_id": F.lit(-1).cast("bigint"), "kind": F.lit("encoding_started")})
    return in_files(spark, [*cut, end.select(*batch.columns)], path)


def test_disorder_within_the_watermark_changes_nothing(spark, tmp_path):
    batch = relation(spark, SF, "m_progress")
    lo, hi = batch.agg(F.min("ts"), F.max("ts")).first()
    spread = (hi - lo).total_seconds() / 4
    delay = f"{int(spread) + 1} seconds"
    stream = shuffled_files(spark, batch, str(tmp_path / "in"), spread)
    got = run(ordered.tracked(stream, delay, 10**9)).persist()
    same(got.where("emitted").select("event_id", "job_id", "run_no", "bucket"), progress.gate(batch))
    same(got.select("event_id", "job_id", "run_no", "shown_percent"), progress.monotone(batch))
    arrival = run(S.tracked(shuffled_files(spark, batch, str(tmp_path / "again"), spread), None))
    assert sorted(map(tuple, arrival.where("emitted").select("event_id", "run_no").collect())) != sorted(map(tuple, progress.gate(batch).select("event_id", "run_no").collect()))


PROGRESS = "event_id bigint, job_id bigint, ts timestamp_ntz, kind string, elapsed_secs double, duration_secs double"


def at(event_id, minute, kind="encoding_progress", percent=0.0, job_id=1):
    return (event_id, job_id, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute), kind, percent, 100.0)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    parts = [[at(1, 0, percent=10.0), at(2, 30, percent=40.0)], [at(3, 60, percent=50.0)], [at(4, 5, percent=99.0), at(5, 55, percent=45.0)], [at(6, 300, job_id=2)], [at(7, 301, job_id=2)]]
    stream = in_files(spark, [spark.createDataFrame(p, PROGRESS) for p in parts], str(tmp_path / "in"))
    q = ordered.tracked(stream, "10 minutes").writeStream.outputMode("append").format("memory").queryName("late").start()
    q.processAllAvailable()
    dropped = sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"])
    q.stop()
    assert sorted((r["event_id"], r["shown_percent"]) for r in spark.table("late").where("job_id = 1").collect()) == [(1, 10.0), (2, 40.0), (3, 50.0), (5, 45.0)]
    assert dropped == 1


def test_waiting_rows_outlive_a_restart_and_silent_jobs_do_not(spark, tmp_path):
    parts = [[at(1, 0, "encoding_started"), at(2, 2, percent=50.0)], [at(3, 1, percent=20.0)], [at(4, 60, percent=60.0), at(9, 60, job_id=2)], [at(5, 1000, percent=5.0)], [at(8, 2000, job_id=2)]]
    frames = [spark.createDataFrame(p, PROGRESS) for p in parts]
    path, root = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(len(frames)):
        stream = in_files(spark, frames[k : k + 1], path) if not k else None
        if k:
            frames[k].coalesce(1).write.mode("append").parquet(path)
            stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)
        q = ordered.tracked(stream, "10 minutes", 6 * 3600.0).writeStream.outputMode("append").foreachBatch(sinks.table_sink(root, "t")).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
    got = sinks.read_table(spark, root, "t", "event_id bigint, job_id bigint, run_no bigint, bucket int, emitted boolean, shown_percent double")
    assert sorted((r["event_id"], r["run_no"], r["shown_percent"]) for r in got.where("job_id = 1").collect()) == [(2, 1, 50.0), (3, 1, 20.0), (4, 1, 60.0), (5, 0, 5.0)]


def test_event_stream_with_dead_letters(spark, tmp_path):
    """Good events, the forwarded six kinds and dead letters in one pass, equal to the batch."""
    log = catalogue_events.full_log(spark, SF).where("type <> 'encoding_progress' OR subject % 20 = 5").persist()
    bad = ['{"type": "encoding_progress", "timestamp": "soon"}', "{not json", '{"type": "hardware", "timestamp": 1}', '{"timestamp": 1}', '{"type": "warning"}', "[1]", ""]
    values = events.as_json(log).select("value").union(spark.createDataFrame([(b,) for b in bad], "value string"))
    values.repartition(3).write.text(str(tmp_path / "in"))
    seen, root = [], str(tmp_path / "out")
    stream = sinks.judged(sinks.read_events(spark, str(tmp_path / "in")))
    run(stream, sink=sinks.routed(root, lambda df, epoch: seen.append(df.count())))
    kinds = f"type string, timestamp bigint, {events.PAYLOAD}"
    flat = events.flat(log).drop("subject").withColumnRenamed("ts_epoch", "timestamp")
    same(sinks.read_table(spark, root, "events", kinds).drop("query", "epoch"), flat)
    same(sinks.read_table(spark, root, "forwarded", kinds).drop("query", "epoch"), events.forwarded(flat))
    assert sum(seen) == events.forwarded(log).count() and {r["type"] for r in log.select("type").distinct().collect()} == set(events.KINDS)
    dead = sinks.read_table(spark, root, "dead_letters", "value string, reason string").collect()
    assert sorted(r["reason"] for r in dead) == ["corrupt"] * 4 + ["no timestamp"] + ["unknown type"] * 2


def test_log_sink_replaces_what_a_failed_try_left(spark, tmp_path):
    lines = lambda df: df.select(F.lit("2024-05-06").alias("day"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("value"))
    sink = sinks.log_sink(str(tmp_path), lines)
    sink(spark.range(9), 0)
    sink(spark.range(3), 0)
    assert spark.read.text(f"{tmp_path}/*/*").count() == 3


def test_events_as_json(spark, tmp_path):
    log = events.progress_events(progress.parse_lines(relation(spark, SF, "m_line")))
    same(events.from_json(events.as_json(log)), events.flat(log))
    empty = log.limit(1).withColumn("payload", F.parse_json(F.lit("{}")))
    assert events.as_json(empty).first()["value"].endswith("}")
    lines = spark.createDataFrame([("INFO", "a"), ("DEBUG", "b")], "level string, message string")
    shown = events.written(events.at_level(lines, verbose=False), F.lit("2024-05-06 07:08:09").cast("timestamp"))
    events.write_log(shown, str(tmp_path / "log"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "log")).collect()] == ["2024-05-06 07:08:09 [INFO] a"]
