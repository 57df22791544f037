"""Registered queries on progress, events and log lines, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import crop, events, listing, probe, progress, results
from framelake.sources.tables import materialize

from .catalogue_encode import ALL_CROPS_SQL, CHECK_SQL, PLAN_SQL, RESULTS_SQL, batched, checked, described, encoded, summarised
from .catalogue_files import PLANNED_SQL, VIDEO_SQL
from .catalogue_media import TO_DECISION, sql
from .catalogue_probe import FACTS_SQL, SHAPED_SQL, decoded
from .relations import relation

#: Results carry no time of their own here; theirs is this second plus their number.
SECOND = 1_735_689_600

PARSE_SQL = r"""parts AS (SELECT *, regexp_extract(line, 'frame= *([^ \t]+)[ \t]', 1) AS frame_text, regexp_extract(line, 'fps= *([^ \t]+)[ \t]', 1) AS fps_text, regexp_extract(line, 'bitrate= *([^ \t]+)[ \t]', 1) AS bitrate,
  regexp_extract(line, 'speed= *([^ \t\rx\n]+)', 1) AS speed_text, regexp_extract(line, 'time=([0-9]{2}:[0-9]{2}:[0-9]{2}\.?[0-9]*)', 1) AS time_text FROM m_line WHERE contains(line, 'frame=')),
fields AS (SELECT *, coalesce(TRY_CAST(frame_text AS BIGINT), 0) AS frame, coalesce(CAST(TRY_CAST(fps_text AS FLOAT) AS DOUBLE), 0e0) AS fps, coalesce(CAST(TRY_CAST(speed_text AS FLOAT) AS DOUBLE), 0e0) AS speed,
  CASE WHEN time_text = '' THEN 0e0 ELSE CAST(string_split(time_text, ':')[1] AS DOUBLE) * 3600 + CAST(string_split(time_text, ':')[2] AS DOUBLE) * 60 + CAST(string_split(time_text, ':')[3] AS DOUBLE) END AS elapsed FROM parts),
parsed AS (SELECT *, least(elapsed / duration_secs * 100e0, 100e0) AS percent, CASE WHEN speed > 0 THEN CAST(trunc((duration_secs - elapsed) / speed) AS BIGINT) ELSE 0 END AS eta FROM fields)"""
RUNS_SQL = """runs AS (SELECT *, CAST(sum(CASE WHEN kind = 'encoding_started' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_no FROM m_progress),
snapshots AS (SELECT *, least(elapsed_secs / duration_secs * 100e0, 100e0) AS percent FROM runs WHERE kind = 'encoding_progress'),
bucketed AS (SELECT *, CAST(trunc(percent / 5e0) AS INTEGER) AS bucket FROM snapshots),
gated AS (SELECT event_id, job_id, run_no, bucket FROM (SELECT *, coalesce(max(bucket) OVER (PARTITION BY job_id, run_no ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS b
  FROM bucketed WHERE bucket <= 20) WHERE bucket > b)"""
#: The payload's fields in the other engine; the steps of a validation are JSON text there.
DUCK = {"double": "DOUBLE", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN"}
OUT = "/out"


def _event(kind: str, ts: str, subject: str, source: str, **payload: str) -> str:
    columns = [f"{payload[k] if k in payload else 'NULL'} AS {k}" for k in events.fields()]
    columns = [f"CAST({c.rsplit(' AS ', 1)[0]} AS {DUCK.get(t, 'VARCHAR')}) AS {k}" for c, (k, t) in zip(columns, events.fields().items())]
    return f"SELECT {kind} AS type, CAST({ts} AS BIGINT) AS ts_epoch, CAST({subject} AS BIGINT) AS subject, {', '.join(columns)} FROM {source}"


FILE_TS, NAME = f"{SECOND} + file_id", "'f' || file_id || '.mkv'"
SIZES_REDUCTION = "CASE WHEN input_bytes = 0 THEN 0e0 ELSE (input_bytes - output_bytes) / CAST(input_bytes AS DOUBLE) * 100e0 END"
KNOWN_FRAMES = "CASE WHEN job_id % 7 <> 0 THEN job_id * 10 ELSE 0 END"
SKIPPED_SQL = "SELECT file_id, 'Output file already exists: ' || output_path || '. Skipping encode.' AS skip_message FROM planned WHERE output_path IN (SELECT output_path FROM existing)"
POSITION_SQL = """SELECT * FROM (SELECT file_id, name, CAST(row_number() OVER (PARTITION BY directory ORDER BY lower(name), path, file_id) AS BIGINT) AS current_file, count(*) OVER (PARTITION BY directory) AS total_files FROM videos) WHERE total_files > 1"""
LABEL_SQL = "'Grain'"
LOG_SQL = "positions AS (" + POSITION_SQL + "), skips AS (" + SKIPPED_SQL + "), log AS (" + "\nUNION ALL ".join([
    _event("'encoding_progress'", "floor(epoch(ts))", "event_id", "parsed", percent="percent", speed="speed", fps="fps", eta_seconds="eta"),
    _event("'encoding_started'", "floor(epoch(ts))", "event_id", "m_progress WHERE kind = 'encoding_started'", total_frames=KNOWN_FRAMES),
    _event("'error'", "floor(epoch(ts))", "event_id", "m_progress WHERE kind = 'error'", title="'Encoding Error'", message="'Could not encode job ' || job_id", context="'Job: ' || job_id", suggestion="'Check the encoder''s log for more details'"),
    _event("'error'", FILE_TS, "file_id", "doc_facts WHERE reason IS NOT NULL", title="'Analysis Error'", message=f"'Could not analyze ' || {NAME} || ': ' || reason", context=f"'File: ' || {NAME}", suggestion="'Check if the file is a valid video format'"),
    _event("'warning'", FILE_TS, "file_id", "skips", message="skip_message"),
    _event("'file_progress'", FILE_TS, "file_id", "positions", current_file="current_file", total_files="total_files"),
    _event("'initialization'", FILE_TS, "file_id", "plan", input_file=NAME, output_file=NAME, duration="duration", resolution="resolution", category="category", dynamic_range="CASE WHEN is_hdr THEN 'HDR' ELSE 'SDR' END", audio_description="audio_description"),
    _event("'crop_result'", FILE_TS, "file_id", "plan", message="crop_message", crop="crop_filter", required="crop_required", disabled="false", total_samples="total_samples"),
    _event("'encoding_config'", FILE_TS, "file_id", "plan", encoder="'SVT-AV1'", preset="'6'", tune="'0'", quality="'CRF ' || crf", pixel_format="'yuv420p10le'", matrix_coefficients="matrix", audio_codec="'Opus'", audio_description="audio_config",
           preset_label=LABEL_SQL, preset_settings="settings", svt_params="svt_params"),
    _event("'stage_progress'", FILE_TS, "file_id", "plan", stage="'planning'", percent="100e0", message="(n_streams + 2) || ' encode tasks'"),
    _event("'validation_complete'", FILE_TS, "file_id", "wide JOIN (SELECT file_id AS f, to_json(list({'step': name, 'passed': passed, 'details': details} ORDER BY step_no)) AS said FROM steps GROUP BY file_id) ON file_id = f", validation_passed="is_valid", validation_steps="said"),
    _event("'encoding_complete'", FILE_TS, "file_id", "reduced", output_file=NAME, original_size="input_size", encoded_size="output_size", size_reduction_percent="reduction_pct"),
    _event("'batch_started'", f"{SECOND} + batch", "batch", "summary WHERE total_files > 1", total_files="total_files", output_dir=f"'{OUT}'"),
    _event("'batch_complete'", f"{SECOND} + batch", "batch", "summary WHERE successful > 1", successful_count="successful", total_files="total_files", total_size_reduction_percent=SIZES_REDUCTION),
    _event("CASE successful WHEN 0 THEN 'warning' ELSE 'operation_complete' END", f"{SECOND} + batch", "batch", "summary WHERE successful <= 1",
           message="CASE successful WHEN 0 THEN 'No files were successfully encoded' ELSE 'Successfully encoded ' || only_name END"),
]) + ")"
CLOCK = "printf('%02d:%02d:%02d', {0} // 3600, {0} % 3600 // 60, {0} % 60)"
SIZE = "printf('Size: %.2f MB (%.2f GB) -> %.2f MB (%.2f GB) (%.1f%% reduction)', {0} / 1048576e0, {0} / 1073741824e0, {1} / 1048576e0, {1} / 1073741824e0, {2})"
#: What is said of a planned file, in order.
PLAN_LINES = [
    "'=== VIDEO ==='", f"'Input: ' || {NAME}", f"'Output: ' || {NAME}", "'Duration: ' || duration", "'Resolution: ' || resolution || ' (' || category || ')'", "'Dynamic range: ' || CASE WHEN is_hdr THEN 'HDR' ELSE 'SDR' END",
    "'Audio: ' || audio_description", "'Crop detection: ' || crop_message || CASE WHEN crop_required THEN ' (' || crop_filter || ')' ELSE ' (no crop needed)' END", "'=== ENCODING CONFIG ==='", "'Encoder: SVT-AV1'", "'Preset: 6'", "'Tune: 0'",
    "'Quality: CRF ' || crf", "'Pixel format: yuv420p10le'", "'Matrix: ' || matrix", "'Audio codec: Opus'", "'Audio: ' || audio_config", f"'Profile: ' || {LABEL_SQL}", "'Preset values: ' || settings", "'SVT params: ' || svt_params",
    "'[PLANNING] ' || (n_streams + 2) || ' encode tasks'",
]
RESULT_LINES = [
    "'=== RESULTS ==='", f"'Output: ' || {NAME}", SIZE.format("input_size", "output_size", "reduction_pct"), "'Video: AV1 (libsvtav1), ' || out_width || 'x' || out_height", "'Audio: ' || audio_results",
    f"'Time: ' || {CLOCK.format('(elapsed_ms // 1000)')} || printf(' (avg speed %.1fx)', speed)", f"'Saved to: {OUT}/' || {NAME}",
]
BATCH_LINES = [
    "'=== BATCH COMPLETE ==='", "successful || ' of ' || total_files || ' succeeded'", "'Validation: ' || passed || ' passed, ' || failed || ' failed'", SIZE.format("input_bytes", "output_bytes", SIZES_REDUCTION),
    f"'Time: ' || {CLOCK.format('(elapsed_ms // 1000)')} || printf(' (avg speed %.1fx)', avg_speed)",
]


def _each(prefix: str, key: str, level: str, source: str, said: list[str]) -> str:
    """A SELECT of numbered lines; those without text are left out."""
    texts = ", ".join(said)
    return f"SELECT '{prefix}/' || {key} AS event_key, CAST(k - 1 AS INTEGER) AS line_no, '{level}' AS level, said[k] AS message FROM (SELECT {key}, [{texts}] AS said, unnest(range(1, {len(said) + 1})) AS k FROM {source}) WHERE said[k] IS NOT NULL"


LINES_SQL = f"""line_gate AS (SELECT *, coalesce(max(b) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM (SELECT *, CAST(trunc(percent / 5e0) AS INTEGER) AS b FROM parsed)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY cnt DESC, crop) AS k, count(*) OVER (PARTITION BY file_id) AS n, round(cnt / sum(cnt) OVER (PARTITION BY file_id) * 100e0, 6) AS pct FROM crop_counts),
planned_results AS (SELECT r.*, out_width, out_height, audio_results FROM reduced r LEFT JOIN plan p ON r.file_id = p.file_id),
positions AS ({POSITION_SQL}), skips AS ({SKIPPED_SQL}),
lines AS (
  SELECT 'progress/' || event_id AS event_key, 0 AS line_no, 'INFO' AS level, printf('Progress: %.0f%% (speed %.1fx, fps %.1f, eta ', percent, speed, fps) || {CLOCK.format('eta')} || ')' AS message FROM line_gate WHERE b > before
  UNION ALL {_each("plan", "file_id", "INFO", "plan", PLAN_LINES)}
  UNION ALL {_each("start", "event_id", "INFO", "m_progress WHERE kind = 'encoding_started'", [f"'=== ENCODING STARTED === (total frames: ' || {KNOWN_FRAMES} || ')'"])}
  UNION ALL SELECT 'validation/' || file_id, 0, 'INFO', '=== VALIDATION ===' FROM wide
  UNION ALL SELECT 'validation/' || file_id, 1, CASE WHEN is_valid THEN 'INFO' ELSE 'WARN' END, CASE WHEN is_valid THEN 'Result: PASSED' ELSE 'Result: FAILED' END FROM wide
  UNION ALL SELECT 'validation/' || file_id, step_no + 1, 'INFO', '  - ' || name || ': ' || CASE WHEN passed THEN 'ok' ELSE 'FAILED' END || ' (' || details || ')' FROM steps
  UNION ALL {_each("result", "file_id", "INFO", "planned_results", RESULT_LINES)}
  UNION ALL {_each("batch-start", "batch", "INFO", "summary WHERE total_files > 1", ["'=== BATCH STARTED ==='", f"'Processing ' || total_files || ' files -> {OUT}'"])}
  UNION ALL {_each("batch", "batch", "INFO", "summary WHERE successful > 1", BATCH_LINES)}
  UNION ALL {_each("batch", "batch", "WARN", "summary WHERE successful = 0", ["'No files were successfully encoded'"])}
  UNION ALL {_each("batch", "batch", "INFO", "summary WHERE successful = 1", ["'=== COMPLETE === Successfully encoded ' || only_name"])}
  UNION ALL SELECT 'batch/' || batch, CAST(4 + row_number() OVER (PARTITION BY batch ORDER BY file_id) AS INTEGER), 'INFO', '  - ' || filename || printf(' (%.1f%% reduction)', reduction_pct) FROM reduced WHERE batch IN (SELECT batch FROM summary WHERE successful > 1)
  UNION ALL {_each("file", "file_id", "INFO", "positions", ["'--- File ' || current_file || ' of ' || total_files || ' ---'", "'  ' || current_file || '. ' || name"])}
  UNION ALL {_each("skip", "file_id", "WARN", "skips", ["skip_message"])}
  UNION ALL {_each("reject", "file_id", "ERROR", "doc_facts WHERE reason IS NOT NULL", [f"'Analysis Error: Could not analyze ' || {NAME} || ': ' || reason", f"'  Context: File: ' || {NAME}", "'  Suggestion: Check if the file is a valid video format'"])}
  UNION ALL {_each("error", "event_id", "ERROR", "m_progress WHERE kind = 'error'", ["'Encoding Error: Could not encode job ' || job_id", "'  Context: Job: ' || job_id", "'  Suggestion: Check the encoder''s log for more details'"])}
  UNION ALL SELECT DISTINCT 'crop/' || file_id, 0, 'DEBUG', 'Crop candidates (' || CAST(sum(cnt) OVER (PARTITION BY file_id) AS BIGINT) || ' samples, ' || n || ' unique values):' FROM ranked
  UNION ALL SELECT 'crop/' || file_id, CAST(k AS INTEGER), 'DEBUG', '  ' || k || '. crop=' || crop || ' count=' || cnt || printf(' (%.1f%%)', pct) FROM ranked WHERE k <= 10
  UNION ALL SELECT 'crop/' || file_id, 11, 'DEBUG', '  ... and ' || greatest(n - 10, 0) || ' more' FROM ranked WHERE k = 10)"""


def _seen(s: SparkSession, d: str, planned: bool = True) -> dict[str, DataFrame]:
    """What events and lines are made of; what several of them read is written once. Without `planned`, neither plans nor
    positions are made."""
    made = {"check": materialize(checked(s, d), "checked")}
    done = materialize(batched(encoded(s, d, made["check"])), "results")
    files = listing.with_output(relation(s, d, "m_file"))
    existing = files.where("file_id % 5 = 0").select("output_path").distinct()
    if planned:
        made |= {"plans": materialize(described(s, d), "described"), "positions": listing.positions(relation(s, d, "m_file"))}
    return made | {
        "done": done, "summary": materialize(results.with_only(summarised(s, d, done), done), "summary"), "parsed": progress.parse_lines(relation(s, d, "m_line")), "progress": relation(s, d, "m_progress"), "jobs": jobs(s, d),
        "rejects": probe.rejects(decoded(s, d)), "skipped": listing.skipped(files, existing),
    }


def full_log(s: SparkSession, d: str, wide: bool = False, planned: bool = True) -> DataFrame:
    """All kinds of events, as type, ts_epoch, subject and payload, or as events.flat has them if `wide`; those of plans and
    positions only if `planned`. Results carry no time of their own; theirs is SECOND plus their number."""
    x = _seen(s, d, planned)
    at = lambda df, key="file_id": df.withColumn("ts_epoch", F.lit(SECOND) + F.col(key))
    parts = [
        events.progress_events(x["parsed"], wide), events.job_events(x["progress"], x["jobs"], wide), events.reject_events(at(x["rejects"]), wide), events.skip_events(at(x["skipped"]), wide),
        events.validation_events(at(x["check"]), wide), events.result_events(at(x["done"]), wide), events.batch_events(at(x["summary"], "batch"), OUT, wide),
    ]
    if planned:
        parts += [events.plan_events(at(x["plans"]), wide), events.position_events(at(x["positions"]), wide)]
    return events.union(parts)


def _shown(log: DataFrame) -> DataFrame:
    return log.withColumn("validation_steps", F.to_json("validation_steps"))


def event_log(s: SparkSession, d: str) -> DataFrame:
    return _shown(full_log(s, d, wide=True))


def events_forwarded(s: SparkSession, d: str) -> DataFrame:
    """The kinds that callers get to see; no plan or position is one of them, so those aren't made."""
    return _shown(events.forwarded(full_log(s, d, wide=True, planned=False)))


def log_lines(s: SparkSession, d: str, verbose: bool = True) -> DataFrame:
    """Lines of all levels; without `verbose` those for debugging aren't made."""
    x = _seen(s, d)
    x["parsed"] = materialize(x["parsed"].drop("line", "frame", "bitrate"), "parsed")
    streams = x["plans"].select("file_id", "out_width", "out_height", "audio_results")
    parts = [
        events.plan_lines(x["plans"]), events.start_lines(x["progress"], x["jobs"]), events.progress_lines(x["parsed"]), events.validation_lines(x["check"]), events.result_lines(x["done"].join(streams, "file_id", "left"), OUT),
        events.batch_lines(x["summary"], OUT), events.reduction_lines(results.file_reductions(x["done"]), x["summary"]), events.position_lines(x["positions"]), events.skip_lines(x["skipped"]), events.reject_lines(x["rejects"]),
        events.job_error_lines(x["progress"]),
    ]
    if verbose:
        parts.append(events.candidate_lines(crop.candidates(relation(s, d, "m_crop"))))
    return events.union(parts)


def log_written(s: SparkSession, d: str) -> DataFrame:
    """The lines as a log file has them, without those for debugging; a line's second is its number in its event, in turns of a minute."""
    start = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    return events.written(events.at_level(log_lines(s, d, verbose=False), verbose=False), F.timestamp_add("SECOND", F.col("line_no") % 60, start))


def jobs(s: SparkSession, d: str) -> DataFrame:
    known = relation(s, d, "m_line").where("job_id % 7 <> 0")
    return known.groupBy("job_id").agg(F.max("duration_secs").alias("duration_secs")).withColumn("total_frames", F.col("job_id") * 10)


def _sql(body: str) -> str:
    return sql("m_progress", f",{RUNS_SQL} {body}")


def _events_sql(body: str) -> str:
    facts = f"{SHAPED_SQL},{FACTS_SQL.replace('facts AS', 'doc_facts AS', 1)}"
    plan = PLAN_SQL.removeprefix(ALL_CROPS_SQL).lstrip(",\n")
    return sql("m_probe m_crop m_track m_audio m_output m_out_audio m_progress m_line m_file", f",{CHECK_SQL},{RESULTS_SQL},{plan},{facts},{VIDEO_SQL},{PLANNED_SQL},{PARSE_SQL},{body}", *TO_DECISION, "audio_lists")


QUERIES = {
    "progress_parse": (
        lambda s, d: progress.parse_lines(relation(s, d, "m_line")).select("event_id", "frame", "fps", "bitrate", "speed", "elapsed", "percent", "eta"),
        sql("m_line", f",{PARSE_SQL} SELECT event_id, frame, fps, bitrate, speed, elapsed, percent, eta FROM parsed"),
    ),
    "progress_enriched": (
        lambda s, d: progress.enriched(relation(s, d, "m_line"), jobs(s, d)),
        sql("m_line", f""",{PARSE_SQL} SELECT event_id, job_id, frame, CASE WHEN job_id % 7 <> 0 THEN job_id * 10 ELSE 0 END AS total_frames, CASE WHEN job_id % 7 <> 0 THEN percent ELSE 0e0 END AS percent,
  CASE WHEN job_id % 7 <> 0 THEN eta ELSE 0 END AS eta FROM parsed"""),
    ),
    "progress_runs": (lambda s, d: progress.runs(relation(s, d, "m_progress")).select("event_id", "job_id", "run_no"), _sql("SELECT event_id, job_id, run_no FROM runs")),
    "progress_gate": (lambda s, d: progress.gate(relation(s, d, "m_progress")), _sql("SELECT * FROM gated")),
    "progress_monotone": (
        lambda s, d: progress.monotone(relation(s, d, "m_progress")),
        _sql("SELECT event_id, job_id, run_no, max(greatest(0e0, percent)) OVER (PARTITION BY job_id, run_no ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS shown_percent FROM snapshots"),
    ),
    "progress_latest": (
        lambda s, d: progress.latest(relation(s, d, "m_progress")),
        _sql("SELECT job_id, event_id, elapsed_secs, percent FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS k FROM snapshots) WHERE k = 1"),
    ),
    "event_log": (event_log, _events_sql(f"{LOG_SQL} SELECT * FROM log")),
    "events_forwarded": (
        events_forwarded,
        _events_sql(f"{LOG_SQL} SELECT * FROM log WHERE type IN ('encoding_progress', 'validation_complete', 'encoding_complete', 'warning', 'error', 'batch_complete')"),
    ),
    "log_written": (
        log_written,
        _events_sql(f"{LINES_SQL} SELECT '2025-01-01' AS day, '2025-01-01 00:00:' || printf('%02d', line_no % 60) || ' [' || level || '] ' || message AS value FROM lines WHERE level <> 'DEBUG'"),
    ),
    "log_lines": (log_lines, _events_sql(f"{LINES_SQL} SELECT * FROM lines")),
}
