"""One log of all events, and the lines that are written of them.

An event is its type, the second it happened, a subject (the file, batch or progress line it is about) and a payload. Kinds
have different payloads, so it is one VARIANT column: a new field changes no table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import exprs as X

from . import encoding
from . import progress as P

#: The kinds of events, and those that callers get to see.
KINDS = (
    "initialization stage_progress encoding_started encoding_config crop_result encoding_progress validation_complete encoding_complete operation_complete batch_started file_progress batch_complete warning error".split()
)
FORWARDED = ["encoding_progress", "validation_complete", "encoding_complete", "warning", "error", "batch_complete"]
LEVELS = ["DEBUG", "INFO", "WARN", "ERROR"]
#: Fields of payloads, by the kinds that have them first.
PAYLOAD = (
    "percent double, speed double, fps double, eta_seconds bigint, validation_passed boolean, validation_steps array<struct<step: string, passed: boolean, details: string>>, "
    "output_file string, original_size bigint, encoded_size bigint, size_reduction_percent double, title string, message string, context string, suggestion string, "
    "successful_count bigint, total_files bigint, total_size_reduction_percent double, input_file string, duration string, resolution string, category string, dynamic_range string, audio_description string, "
    "crop string, required boolean, disabled boolean, total_samples bigint, encoder string, preset string, tune string, quality string, pixel_format string, matrix_coefficients string, audio_codec string, "
    "preset_label string, preset_settings string, svt_params string, total_frames bigint, stage string, current_file bigint, output_dir string"
)


def fields() -> dict[str, str]:
    """PAYLOAD's fields and their types."""
    out, depth, part = {}, 0, ""
    for c in PAYLOAD + ",":
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            name, kind = part.strip().split(" ", 1)
            out[name], part = kind, ""
        else:
            part += c
    return out


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970 of a time without zone."""
    return (ts - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("interval second").cast("bigint")


def event(df: DataFrame, kind: str | Column, subject: str, wide: bool = False, **payload: Column) -> DataFrame:
    """An event of each row of df (with ts_epoch): type, ts_epoch, subject, payload; as `flat` has it if `wide`, with nothing packed."""
    kinds = fields()
    if wide:
        laid = [payload.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()]
        return df.select((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), F.col("ts_epoch").cast("bigint").alias("ts_epoch"), F.col(subject).cast("bigint").alias("subject"), *laid)
    packed = F.to_variant_object(F.struct(*[v.cast(kinds[k]).alias(k) for k, v in payload.items()]))
    return df.select((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), F.col("ts_epoch").cast("bigint").alias("ts_epoch"), F.col(subject).cast("bigint").alias("subject"), packed.alias("payload"))


def union(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts in one table; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def flat(log: DataFrame) -> DataFrame:
    """type, ts_epoch, subject and every field of PAYLOAD; null where a kind lacks it."""
    return log.select("type", "ts_epoch", "subject", *[F.try_variant_get("payload", f"$.{k}", t).alias(k) for k, t in fields().items()])


def forwarded(log: DataFrame) -> DataFrame:
    return log.where(F.col("type").isin(FORWARDED))


def as_json(log: DataFrame) -> DataFrame:
    """(type, value): an event as one JSON object: type, timestamp, subject, then its payload."""
    base = F.to_json(F.struct("type", F.col("ts_epoch").alias("timestamp"), "subject"))
    rest = F.to_json("payload")
    value = F.when(rest.isNull() | (rest == "{}"), base).otherwise(F.concat(F.expr("left(__base, length(__base) - 1)"), F.lit(","), F.substring(rest, 2, 1 << 30)))
    return log.withColumn("__base", base).select("type", value.alias("value"))


def from_json(values: DataFrame, payload: str = PAYLOAD) -> DataFrame:
    """(value) as `flat` has it, with the fields of payload."""
    df = values.select(F.from_json("value", f"type string, timestamp bigint, subject bigint, {payload}").alias("e")).select("e.*")
    return df.withColumnRenamed("timestamp", "ts_epoch")


def file_name(file_id: Column) -> Column:
    return F.concat(F.lit("f"), X.text(file_id), F.lit(".mkv"))


def out_path(file_id: Column, out_dir: str) -> Column:
    return F.concat(F.lit(f"{out_dir}/"), file_name(file_id))


def plan_events(plans: DataFrame, wide: bool = False) -> DataFrame:
    """initialization, crop_result, encoding_config and stage_progress of each planned file (encoding.described, with
    ts_epoch), in one pass over the plans; four if `wide`."""
    c, kinds = F.col, fields()

    def one(kind: str, **payload: Column) -> Column | DataFrame:
        if wide:
            return event(plans, kind, "file_id", wide, **payload)
        return F.struct(F.lit(kind).alias("type"), F.to_variant_object(F.struct(*[v.cast(kinds[k]).alias(k) for k, v in payload.items()])).alias("payload"))

    each = [
        one(
            "initialization", input_file=file_name(c("file_id")), output_file=file_name(c("file_id")), duration=c("duration"), resolution=c("resolution"), category=c("category"),
            dynamic_range=c("dynamic_range"), audio_description=c("audio_description"),
        ),
        one("crop_result", message=c("crop_message"), crop=c("crop_filter"), required=c("crop_required"), disabled=c("crop_disabled"), total_samples=c("total_samples")),
        one(
            "encoding_config", encoder=F.lit(encoding.ENCODER), preset=X.text(c("encoder_preset")), tune=X.text(c("tune")), quality=F.concat(F.lit("CRF "), X.text(c("crf"))),
            pixel_format=F.lit(encoding.PIXEL_FORMAT), matrix_coefficients=c("matrix"), audio_codec=F.lit(encoding.AUDIO_CODEC), audio_description=c("audio_config"),
            preset_label=c("preset_label"), preset_settings=c("settings"), svt_params=c("svt_params"),
        ),
        one("stage_progress", stage=F.lit("planning"), percent=F.lit(100.0), message=planned_text()),
    ]
    if wide:
        return union(each)
    return plans.select("ts_epoch", c("file_id").cast("bigint").alias("subject"), F.explode(F.array(*each)).alias("e")).select("e.type", "ts_epoch", "subject", "e.payload")


def planned_text() -> Column:
    """A plan is a video task, one for each stream, and the mux."""
    return F.concat(X.text(F.col("n_streams") + 2), F.lit(" encode tasks"))


def progress_events(parsed: DataFrame, wide: bool = False) -> DataFrame:
    """encoding_progress of parsed lines (progress.parse_lines, with event_id and ts)."""
    df = parsed.withColumn("ts_epoch", epoch(F.col("ts")))
    return event(df, "encoding_progress", "event_id", wide, percent=F.col("percent"), speed=F.col("speed"), fps=F.col("fps"), eta_seconds=F.col("eta"))


def job_events(progress: DataFrame, jobs: DataFrame, wide: bool = False) -> DataFrame:
    """encoding_started (with its job's frames, 0 if unknown) and error of a progress table."""
    df = progress.withColumn("ts_epoch", epoch(F.col("ts")))
    started = df.where("kind = 'encoding_started'").join(jobs.select("job_id", "total_frames"), "job_id", "left")
    return union([event(started, "encoding_started", "event_id", wide, total_frames=F.coalesce("total_frames", F.lit(0))), event(df.where("kind = 'error'"), "error", "event_id", wide, **_job_error())])


def _job_error() -> dict[str, Column]:
    job = X.text(F.col("job_id"))
    return {"title": F.lit("Encoding Error"), "message": F.concat(F.lit("Could not encode job "), job), "context": F.concat(F.lit("Job: "), job), "suggestion": F.lit("Check the encoder's log for more details")}


def _reject_error() -> dict[str, Column]:
    name = file_name(F.col("file_id"))
    return {"title": F.col("title"), "message": F.concat(F.lit("Could not analyze "), name, F.lit(": "), F.col("error_reason")), "context": F.concat(F.lit("File: "), name), "suggestion": F.col("suggestion")}


def reject_events(rejects: DataFrame, wide: bool = False) -> DataFrame:
    """error of each document that can't be used (probe.rejects, with ts_epoch)."""
    return event(rejects, "error", "file_id", wide, **_reject_error())


def skip_events(skipped: DataFrame, wide: bool = False) -> DataFrame:
    """warning of each file whose output is there (listing.skipped, with ts_epoch)."""
    return event(skipped, "warning", "file_id", wide, message=F.col("message"))


def position_events(positions: DataFrame, wide: bool = False) -> DataFrame:
    """file_progress of each file of a batch of several (listing.positions, with ts_epoch)."""
    return event(positions, "file_progress", "file_id", wide, current_file=F.col("current_file"), total_files=F.col("total_files"))


def validation_events(checked: DataFrame, wide: bool = False) -> DataFrame:
    """validation_complete of each checked file (validation.check, with ts_epoch)."""
    steps = F.transform("steps", lambda s: F.struct(s["name"].alias("step"), s["passed"].alias("passed"), s["details"].alias("details")))
    return event(checked, "validation_complete", "file_id", wide, validation_passed=F.col("is_valid"), validation_steps=steps)


def result_events(results: DataFrame, wide: bool = False) -> DataFrame:
    """encoding_complete of each result (with ts_epoch)."""
    c = F.col
    return event(results, "encoding_complete", "file_id", wide, output_file=file_name(c("file_id")), original_size=c("input_size"), encoded_size=c("output_size"), size_reduction_percent=c("reduction_pct"))


def outcome_kind(n: Column) -> Column:
    return F.when(n == 0, "warning").when(n == 1, "operation_complete").otherwise("batch_complete")


def batch_events(summary: DataFrame, out_dir: str, wide: bool = False) -> DataFrame:
    """batch_started of batches of several files; batch_complete of those with several results, else what stands for it
    (results.summary, with only_name and ts_epoch)."""
    c, n = F.col, F.col("successful")
    begun = event(summary.where("total_files > 1"), "batch_started", "batch", wide, total_files=c("total_files"), output_dir=F.lit(out_dir))
    done = event(
        summary.where(n > 1), "batch_complete", "batch", wide, successful_count=n, total_files=c("total_files"), total_size_reduction_percent=X.size_reduction(c("input_bytes"), c("output_bytes"))
    )
    return union([begun, done, event(summary.where(n <= 1), outcome_kind(n), "batch", wide, message=outcome_text())])


def outcome_text() -> Column:
    return F.when(F.col("successful") == 0, "No files were successfully encoded").otherwise(F.concat(F.lit("Successfully encoded "), F.col("only_name")))


def _join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _line(no: Column | int, level: Column | str, message: Column | str) -> Column:
    return F.struct((F.lit(no) if isinstance(no, int) else no).cast("int").alias("line_no"), (F.lit(level) if isinstance(level, str) else level).alias("level"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def _said(*messages: Column | str, level: str = "INFO") -> Column:
    """Lines numbered from 0; those without text are left out."""
    return F.filter(F.array(*[_line(k, level, m) for k, m in enumerate(messages)]), lambda x: x["message"].isNotNull())


def _lines(df: DataFrame, source: str, key: str, lines: Column) -> DataFrame:
    """One pass over df: a row for each line of each row's array."""
    df = df.select(_join(f"{source}/", X.text(F.col(key))).alias("event_key"), F.explode(lines).alias("l"))
    return df.select("event_key", "l.line_no", "l.level", "l.message")


def plan_lines(plans: DataFrame) -> DataFrame:
    """What is said of each planned file before it is encoded: the video, the stage, the crop, the settings."""
    c, name = F.col, file_name(F.col("file_id"))
    crop = F.when(c("crop_disabled"), "Crop detection: disabled").when(c("crop_required"), _join("Crop detection: ", c("crop_message"), " (", c("crop_filter"), ")")).otherwise(_join("Crop detection: ", c("crop_message"), " (no crop needed)"))
    said = [
        "=== VIDEO ===", _join("Input: ", name), _join("Output: ", name), _join("Duration: ", c("duration")), _join("Resolution: ", c("resolution"), " (", c("category"), ")"), _join("Dynamic range: ", c("dynamic_range")),
        _join("Audio: ", c("audio_description")), crop, "=== ENCODING CONFIG ===", f"Encoder: {encoding.ENCODER}", _join("Preset: ", X.text(c("encoder_preset"))), _join("Tune: ", X.text(c("tune"))), _join("Quality: CRF ", X.text(c("crf"))),
        f"Pixel format: {encoding.PIXEL_FORMAT}", _join("Matrix: ", c("matrix")), f"Audio codec: {encoding.AUDIO_CODEC}", _join("Audio: ", c("audio_config")), _join("Profile: ", c("preset_label")), _join("Preset values: ", c("settings")),
        _join("SVT params: ", c("svt_params")), _join("[PLANNING] ", planned_text()),
    ]
    return _lines(plans, "plan", "file_id", _said(*said))


def start_lines(progress: DataFrame, jobs: DataFrame) -> DataFrame:
    started = progress.where("kind = 'encoding_started'").join(jobs.select("job_id", "total_frames"), "job_id", "left")
    return _lines(started, "start", "event_id", _said(_join("=== ENCODING STARTED === (total frames: ", X.text(F.coalesce("total_frames", F.lit(0))), ")")))


def progress_lines(parsed: DataFrame) -> DataFrame:
    """Lines of snapshots that reach a new five per cent; parsed has job_id and ts, each job being one run."""
    snapshots = parsed.select("event_id", "job_id", "ts", F.lit("encoding_progress").alias("kind"), F.col("elapsed").alias("elapsed_secs"), "duration_secs")
    df = P.gate(snapshots).select("event_id").join(parsed, "event_id")
    d = lambda c: X.fixed(F.col(c), 1)
    message = _join("Progress: ", X.fixed(F.col("percent"), 0), "% (speed ", d("speed"), "x, fps ", d("fps"), ", eta ", X.clock_text(F.col("eta")), ")")
    return _lines(df, "progress", "event_id", F.array(_line(0, "INFO", message)))


def validation_lines(checked: DataFrame) -> DataFrame:
    """The verdict of each file, then its steps."""
    ok = F.col("is_valid")
    verdict = _line(1, F.when(ok, "INFO").otherwise("WARN"), F.when(ok, "Result: PASSED").otherwise("Result: FAILED"))
    each = F.transform("steps", lambda s, i: _line(i + 2, "INFO", _join("  - ", s["name"], ": ", F.when(s["passed"], "ok").otherwise("FAILED"), " (", s["details"], ")")))
    return _lines(checked, "validation", "file_id", F.concat(F.array(_line(0, "INFO", "=== VALIDATION ==="), verdict), each))


def _size_line(before: str, after: str, reduction: Column) -> Column:
    return _join("Size: ", X.bytes_readable(F.col(before)), " -> ", X.bytes_readable(F.col(after)), " (", X.fixed(reduction, 1), "% reduction)")


def _time_line(ms: str, rate: str) -> Column:
    return _join("Time: ", X.clock_text((F.col(ms) / F.lit(1000)).cast("bigint")), " (avg speed ", X.fixed(F.col(rate), 1), "x)")


def result_lines(results: DataFrame, out_dir: str) -> DataFrame:
    """Of results joined with their plans; a result without a plan says nothing of its streams."""
    c = F.col
    video = _join(f"Video: AV1 ({encoding.VIDEO_CODEC}), ", X.text(c("out_width")), "x", X.text(c("out_height")))
    said = [
        "=== RESULTS ===", _join("Output: ", file_name(c("file_id"))), _size_line("input_size", "output_size", c("reduction_pct")), video, _join("Audio: ", c("audio_results")), _time_line("elapsed_ms", "speed"),
        _join("Saved to: ", out_path(c("file_id"), out_dir)),
    ]
    return _lines(results, "result", "file_id", _said(*said))


def batch_lines(summary: DataFrame, out_dir: str) -> DataFrame:
    """The start of batches of several files, and how each ended."""
    t, n = lambda c: X.text(F.col(c)), F.col("successful")
    begun = _said("=== BATCH STARTED ===", _join("Processing ", t("total_files"), f" files -> {out_dir}"))
    many = _said(
        "=== BATCH COMPLETE ===", _join(t("successful"), " of ", t("total_files"), " succeeded"), _join("Validation: ", t("passed"), " passed, ", t("failed"), " failed"),
        _size_line("input_bytes", "output_bytes", X.size_reduction(F.col("input_bytes"), F.col("output_bytes"))), _time_line("elapsed_ms", "avg_speed"),
    )
    done = F.when(n == 0, _said(outcome_text(), level="WARN")).when(n == 1, _said(_join("=== COMPLETE === ", outcome_text()))).otherwise(many)
    return union([_lines(summary.where("total_files > 1"), "batch-start", "batch", begun), _lines(summary, "batch", "batch", done)])


def reduction_lines(reductions: DataFrame, summary: DataFrame) -> DataFrame:
    """What each file of a batch with several results saved (results.file_reductions), below the batch's own lines."""
    df = reductions.join(summary.where("successful > 1").select("batch"), "batch", "left_semi")
    message = _join("  - ", F.col("filename"), " (", X.fixed(F.col("reduction_pct"), 1), "% reduction)")
    return _lines(df, "batch", "batch", F.array(_line(F.col("position") + 4, "INFO", message)))


def position_lines(positions: DataFrame) -> DataFrame:
    """Which file of how many is next in each directory, and the directory's list of files."""
    t = lambda c: X.text(F.col(c))
    return _lines(positions, "file", "file_id", _said(_join("--- File ", t("current_file"), " of ", t("total_files"), " ---"), _join("  ", t("current_file"), ". ", X.basename(F.col("path")))))


def skip_lines(skipped: DataFrame) -> DataFrame:
    return _lines(skipped, "skip", "file_id", _said(F.col("message"), level="WARN"))


def _error_lines(e: dict[str, Column]) -> Column:
    return _said(_join(e["title"], ": ", e["message"]), _join("  Context: ", e["context"]), _join("  Suggestion: ", e["suggestion"]), level="ERROR")


def reject_lines(rejects: DataFrame) -> DataFrame:
    return _lines(rejects, "reject", "file_id", _error_lines(_reject_error()))


def job_error_lines(progress: DataFrame) -> DataFrame:
    return _lines(progress.where("kind = 'error'"), "error", "event_id", _error_lines(_job_error()))


def candidate_lines(candidates: DataFrame, most: int = 10) -> DataFrame:
    """For debugging: how many crops a file's samples gave, the first of them, and how many more there are."""
    file = Window.partitionBy("file_id")
    df = candidates.withColumns({"samples": F.sum("cnt").over(file), "n": F.count("*").over(file)}).where(F.col("rank") <= most)
    t, rank = lambda c: X.text(F.col(c)), F.col("rank")
    head = _line(0, "DEBUG", _join("Crop candidates (", t("samples"), " samples, ", t("n"), " unique values):"))
    each = _line(rank, "DEBUG", _join("  ", t("rank"), ". crop=", F.col("crop"), " count=", t("cnt"), " (", X.fixed(F.col("pct"), 1), "%)"))
    more = _line(most + 1, "DEBUG", _join("  ... and ", X.text(F.greatest(F.col("n") - most, F.lit(0))), " more"))
    lines = F.array(F.when(rank == 1, head), each, F.when(rank == most, more))
    return _lines(df, "crop", "file_id", F.filter(lines, lambda x: x.isNotNull()))


def at_level(lines: DataFrame, verbose: bool) -> DataFrame:
    return lines if verbose else lines.where("level <> 'DEBUG'")


def written(lines: DataFrame, ts: Column) -> DataFrame:
    """(day, value): lines as they stand in a log file. A line's time is formatted once, its day is what stands before the blank."""
    df = lines.withColumn("stamp", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    return df.select(F.substring_index("stamp", " ", 1).alias("day"), _join(F.col("stamp"), " [", F.col("level"), "] ", F.col("message")).alias("value"))


def write_log(lines: DataFrame, path: str) -> None:
    """Text files by day of (day, value)."""
    lines.write.partitionBy("day").mode("append").text(path)
