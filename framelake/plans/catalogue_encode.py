"""Registered queries on plans, validation and results, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import exprs as X
from framelake.operators import audio, crop, encoding, listing, results, validation

from framelake.sources.tables import materialize

from .catalogue_files import CRF_SQL, EFFECTIVE_SQL, PLANNED_SQL, PRESET_SQL, TRACK_HDR
from .catalogue_media import TO_DECISION, sql
from .relations import relation

#: The batch of a file: one of 50, but for a few files that are encoded alone. The text runs in both engines.
BATCH = "CASE WHEN file_id % 501 = 1 THEN 1000 + file_id ELSE file_id % 50 END"

ALL_CROPS_SQL = """all_crops AS (SELECT p.*, coalesce(c.crop_filter, '') AS crop_filter, coalesce(c.message, 'Analyzed 141 samples') AS crop_message, coalesce(c.required, false) AS crop_required, coalesce(c.total_samples, 141) AS total_samples FROM m_probe p LEFT JOIN crop_decision c ON p.file_id = c.file_id),
dims AS (SELECT *, CASE WHEN crop_filter <> '' THEN CAST(string_split(replace(crop_filter, 'crop=', ''), ':')[1] AS BIGINT) ELSE width END AS out_w,
  CASE WHEN crop_filter <> '' THEN CAST(string_split(crop_filter, ':')[2] AS BIGINT) ELSE height END AS out_h FROM all_crops)"""
PLAN_SQL = f"""{ALL_CROPS_SQL},
track_hdr AS (SELECT *, {TRACK_HDR} AS is_hdr FROM m_track),
plan AS (SELECT d.file_id, CASE WHEN width >= 3840 THEN 'UHD' WHEN width >= 1920 THEN 'HD' ELSE 'SD' END AS category, width || 'x' || height AS resolution,
  printf('%02d:%02d:%02d', CAST(floor(duration_secs) AS BIGINT) // 3600, CAST(floor(duration_secs) AS BIGINT) % 3600 // 60, CAST(floor(duration_secs) AS BIGINT) % 60) AS duration,
  CASE WHEN width >= 1920 THEN 26 ELSE 24 END AS crf, is_hdr, CASE WHEN is_hdr THEN CASE WHEN matrix_coefficients = '' THEN 'bt2020nc' ELSE matrix_coefficients END ELSE 'bt709' END AS matrix,
  crop_filter, crop_filter AS filter_chain, crop_message, crop_required, total_samples, 'ac-bias=0.1:enable-variance-boost=0:tune=0:keyint=10s:scd=1:scm=0' AS svt_params,
  'CRF=' || CASE WHEN width >= 1920 THEN 26 ELSE 24 END || ', SVT preset=6, Tune=0, AC bias=0.10, Variance boost=disabled' AS settings, coalesce(a.config, 'No audio') AS audio_config, out_w AS out_width, out_h AS out_height,
  coalesce(a.basic, 'No audio') AS audio_description, coalesce(a.results, 'No audio') AS audio_results, coalesce(a.n, 0) AS n_streams
  FROM dims d JOIN track_hdr t ON d.file_id = t.file_id LEFT JOIN audio_texts a ON d.file_id = a.file_id)"""
PLAN_COLUMNS = ", ".join(encoding.PLAN)


#: From a name to a relation; `relation` over the given tables unless a plan is to read others, say bucketed ones.
Relations = Callable[[str], DataFrame]


def _rel(s: SparkSession, d: str, rel: Relations | None) -> Relations:
    return rel or (lambda name: relation(s, d, name))


def described(s: SparkSession, d: str, rel: Relations | None = None) -> DataFrame:
    return encoding.described(*map(_rel(s, d, rel), ("m_probe", "m_track", "m_crop", "m_audio")))


def plans(s: SparkSession, d: str, rel: Relations | None = None) -> DataFrame:
    return described(s, d, rel).select(*encoding.PLAN)


def requested(s: SparkSession, d: str) -> DataFrame:
    """Each file planned as its own request asks; files whose request fails a rule are left out."""
    settings = encoding.file_settings(relation(s, d, "m_asked"), relation(s, d, "m_request"), relation(s, d, "m_tuning"))
    return encoding.described(*map(_rel(s, d, None), ("m_probe", "m_track", "m_crop", "m_audio")), settings=settings)


def requested_plans(s: SparkSession, d: str) -> DataFrame:
    return requested(s, d).select(*encoding.PLAN)


REQUESTED_SQL = f"""{ALL_CROPS_SQL},{PRESET_SQL},{CRF_SQL},{EFFECTIVE_SQL},
track_hdr AS (SELECT *, {TRACK_HDR} AS is_hdr FROM m_track),
settings AS (SELECT a.file_id, e.*, coalesce(t.variance_boost, p.variance_boost) AS boost, coalesce(t.boost_strength, p.boost_strength) AS strength, coalesce(t.boost_octile, p.boost_octile) AS octile, coalesce(denoise_filter, '') AS denoise
  FROM m_asked a JOIN effective e ON a.request_id = e.request_id AND e.error IS NULL JOIN presets p ON e.preset = p.preset LEFT JOIN m_tuning t ON e.request_id = t.request_id),
sized AS (SELECT d.*, s.* EXCLUDE (file_id), CASE WHEN width >= 3840 THEN crf_uhd WHEN width >= 1920 THEN crf_hd ELSE crf_sd END AS crf FROM dims d JOIN settings s ON d.file_id = s.file_id),
plan AS (SELECT d.file_id, CASE WHEN width >= 3840 THEN 'UHD' WHEN width >= 1920 THEN 'HD' ELSE 'SD' END AS category, width || 'x' || height AS resolution,
  printf('%02d:%02d:%02d', CAST(floor(duration_secs) AS BIGINT) // 3600, CAST(floor(duration_secs) AS BIGINT) % 3600 // 60, CAST(floor(duration_secs) AS BIGINT) % 60) AS duration,
  crf, is_hdr, CASE WHEN is_hdr THEN CASE WHEN matrix_coefficients = '' THEN 'bt2020nc' ELSE matrix_coefficients END ELSE 'bt709' END AS matrix,
  crop_filter, concat_ws(',', nullif(crop_filter, ''), nullif(denoise, '')) AS filter_chain,
  'ac-bias=' || ac_bias || ':enable-variance-boost=' || CASE WHEN boost THEN '1:variance-boost-strength=' || strength || ':variance-octile=' || octile ELSE '0' END || ':tune=' || tune || ':keyint=10s:scd=1:scm=0'
    || CASE WHEN film_grain IS NULL THEN '' ELSE ':film-grain=' || film_grain || CASE WHEN film_grain_denoise IS NULL THEN '' WHEN film_grain_denoise THEN ':film-grain-denoise=1' ELSE ':film-grain-denoise=0' END END AS svt_params,
  'CRF=' || crf || ', SVT preset=' || encoder_preset || ', Tune=' || tune || ', AC bias=' || printf('%.2f', CAST(ac_bias AS DOUBLE)) || ', Variance boost=' || CASE WHEN boost THEN 'enabled (strength ' || strength || ', octile ' || octile || ')' ELSE 'disabled' END
    || CASE WHEN denoise = '' THEN '' ELSE ', Denoise=' || denoise END
    || CASE WHEN film_grain IS NULL THEN '' ELSE ', Film grain synth=film-grain ' || film_grain || ', denoise ' || CASE WHEN film_grain_denoise IS NULL THEN '-' WHEN film_grain_denoise THEN '1' ELSE '0' END END AS settings,
  coalesce(a.config, 'No audio') AS audio_config, out_w AS out_width, out_h AS out_height
  FROM sized d JOIN track_hdr t ON d.file_id = t.file_id LEFT JOIN audio_texts a ON d.file_id = a.file_id)"""


def checked(s: SparkSession, d: str, rel: Relations | None = None) -> DataFrame:
    """The live rules over m_output: all is expected, taken from m_probe, the crops and the audio."""
    rel, c = _rel(s, d, rel), F.col
    probe = rel("m_probe")
    tracks = rel("m_audio").where("channels > 0").groupBy("file_id").agg(F.count("*").cast("int").alias("tracks"))
    w, h = X.output_dims(c("width"), c("height"), F.when(c("file_id") % 2 == 0, c("crop_filter")))
    hdr = X.hdr_from_track(F.lit(""), F.when(c("color_transfer") == "smpte2084", "SMPTE 2084").otherwise(""), F.lit(""))
    expected = probe.join(crop.decide_all(probe, rel("m_crop")).select("file_id", "crop_filter"), "file_id").join(tracks, "file_id", "left")
    expected = expected.select("file_id", w.alias("width"), h.alias("height"), "duration_secs", (hdr & (c("file_id") % 3 == 0)).alias("hdr"), F.coalesce("tracks", F.lit(0)).alias("tracks"))
    found_hdr = F.when(c("file_id") % 53 != 0, X.hdr_from_track(F.lit(""), c("transfer_characteristics"), F.lit("")))
    actual = rel("m_output").select(
        "file_id", c("out_width").alias("width"), c("out_height").alias("height"), c("out_duration_secs").alias("duration_secs"), F.when(c("file_id") % 59 != 0, c("codec_name")).alias("codec"),
        c("out_bit_depth").alias("bit_depth"), F.when(c("file_id") % 8 == 0, F.lit(12)).alias("track_depth"), found_hdr.alias("hdr"),
    )
    streams = audio.ordered(rel("m_out_audio")).select("file_id", F.when(c("file_id") % 61 != 0, c("s")).alias("s"))
    return validation.check(expected, actual, streams)


CHECK_SQL = f"""{ALL_CROPS_SQL},
expected_tracks AS (SELECT file_id, count(*) AS tracks FROM m_audio WHERE channels > 0 GROUP BY file_id),
expected AS (SELECT d.file_id, CASE WHEN d.file_id % 2 = 0 THEN out_w ELSE width END AS ew, CASE WHEN d.file_id % 2 = 0 THEN out_h ELSE height END AS eh, duration_secs AS ed,
  color_transfer = 'smpte2084' AND d.file_id % 3 = 0 AS ehdr, coalesce(tracks, 0) AS etracks FROM dims d LEFT JOIN expected_tracks t ON d.file_id = t.file_id),
sounds AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY ord1, ord2, ord3, ord4) - 1 AS i, lower(codec_name) AS codec, duration_secs AS sd FROM m_out_audio),
sound_sums AS (SELECT s.file_id, count(*) AS n, bool_and(codec = 'opus') AS opus, string_agg(codec, ', ' ORDER BY i) AS codecs, count(*) FILTER (WHERE sd > 0) AS timed,
  min(i) FILTER (WHERE sd > 0 AND abs(sd - duration_secs) > 5e0) AS off_i, arg_min(sd, i) FILTER (WHERE sd > 0 AND abs(sd - duration_secs) > 5e0) AS off_d
  FROM sounds s JOIN m_probe p ON s.file_id = p.file_id GROUP BY s.file_id),
facts AS (SELECT e.*, o.file_id IS NOT NULL AS probed, out_width AS aw, out_height AS ah, out_duration_secs AS ad, CASE WHEN e.file_id % 59 <> 0 THEN codec_name ELSE '' END AS codec,
  coalesce(out_bit_depth, CASE WHEN e.file_id % 8 = 0 THEN 12 END, 10) AS depth, CASE WHEN e.file_id % 53 <> 0 THEN transfer_characteristics = 'SMPTE 2084' END AS ahdr,
  e.file_id % 61 = 0 AND s.file_id IS NOT NULL AS unread, coalesce(n, 0) AS n, coalesce(opus, true) AS opus, codecs, coalesce(timed, 0) AS timed, off_i, off_d, abs(out_duration_secs - ed) AS off
  FROM expected e LEFT JOIN m_output o ON e.file_id = o.file_id LEFT JOIN sound_sums s ON e.file_id = s.file_id),
flags AS (SELECT *, probed AND regexp_matches(lower(codec), 'av1|av01') AS is_av1, probed AND depth >= 10 AS is_10_bit, probed AND aw = ew AND ah = eh AS is_crop_correct, probed AND off <= 1e0 AS is_duration_correct,
  probed AND coalesce(ahdr = ehdr, false) AS is_hdr_correct, probed AND (unread OR opus) AS is_audio_opus, probed AND (unread OR n = etracks) AS is_track_count_correct, probed AND (unread OR off_i IS NULL) AS is_audio_duration_correct,
  probed AND off * 1000e0 <= 100e0 AS is_sync_preserved FROM facts),
wide AS (SELECT file_id, is_av1, is_10_bit, is_crop_correct, is_duration_correct, is_hdr_correct, is_audio_opus, is_track_count_correct, is_audio_duration_correct, is_sync_preserved,
  is_av1 AND is_10_bit AND is_crop_correct AND is_duration_correct AND is_hdr_correct AND is_audio_opus AND is_track_count_correct AND is_audio_duration_correct AND is_sync_preserved AS is_valid FROM flags),
steps AS (
  SELECT file_id, 1 AS step_no, 'Validation' AS name, false AS passed, 'failed to get output video properties' AS details FROM flags WHERE NOT probed
  UNION ALL SELECT file_id, 1, 'Video codec', is_av1, CASE WHEN is_av1 THEN 'AV1 (' || codec || ')' WHEN codec <> '' THEN 'Expected AV1, got ' || codec ELSE 'Unknown codec' END FROM flags WHERE probed
  UNION ALL SELECT file_id, 2, 'Bit depth', is_10_bit, CASE WHEN depth IN (8, 10, 12) THEN depth || '-bit' ELSE '' END FROM flags WHERE probed
  UNION ALL SELECT file_id, 3, 'Crop detection', is_crop_correct, CASE WHEN is_crop_correct THEN printf('Dimensions match: %dx%d', aw, ah) ELSE printf('Dimension mismatch: got %dx%d, expected %dx%d', aw, ah, ew, eh) END FROM flags WHERE probed
  UNION ALL SELECT file_id, 4, 'Video duration', is_duration_correct, CASE WHEN is_duration_correct THEN printf('Duration matches input (%.1fs)', ad) ELSE printf('Duration mismatch: got %.1fs, expected %.1fs (diff: %.1fs)', ad, ed, off) END FROM flags WHERE probed
  UNION ALL SELECT file_id, 5, 'HDR/SDR status', is_hdr_correct, CASE WHEN ahdr IS NULL THEN 'Failed to detect HDR status' WHEN ahdr = ehdr THEN CASE WHEN ahdr THEN 'HDR' ELSE 'SDR' END || ' preserved'
    ELSE 'Expected ' || CASE WHEN ehdr THEN 'HDR' ELSE 'SDR' END || ', found ' || CASE WHEN ahdr THEN 'HDR' ELSE 'SDR' END END FROM flags WHERE probed
  UNION ALL SELECT file_id, 6, 'Audio tracks', is_audio_opus AND is_track_count_correct, CASE WHEN unread THEN 'Failed to get audio info' WHEN n = 0 THEN 'No audio tracks' WHEN n = 1 AND opus THEN 'Audio track is Opus'
    WHEN n = 1 THEN 'Audio track is ' || codecs || ' (expected Opus)' WHEN opus THEN n || ' audio tracks, all Opus' ELSE n || ' audio tracks: ' || codecs END FROM flags WHERE probed
  UNION ALL SELECT file_id, 7, 'Audio durations', is_audio_duration_correct, CASE WHEN unread THEN 'Audio duration validation skipped' WHEN off_i IS NOT NULL THEN printf('Audio stream %d duration mismatch: got %.1fs, expected %.1fs (diff: %.1fs)', off_i, off_d, ed, abs(off_d - ed))
    WHEN timed = 0 THEN 'Audio duration unavailable - validation skipped' WHEN timed = 1 THEN 'Audio duration matches video' ELSE timed || ' audio stream durations match video' END FROM flags WHERE probed
  UNION ALL SELECT file_id, 8, 'Audio/video sync', is_sync_preserved, CASE WHEN is_sync_preserved THEN printf('Audio/video sync preserved (drift: %.1fms)', off * 1000e0) ELSE printf('Audio/video sync drift too large: %.1fms (max: 100.0ms)', off * 1000e0) END FROM flags WHERE probed)"""


def _check_sql(body: str) -> str:
    return sql("m_probe m_crop m_output m_out_audio", f",{CHECK_SQL} {body}", *TO_DECISION)


def encoded(s: SparkSession, d: str, check: DataFrame | None = None, rel: Relations | None = None) -> DataFrame:
    rel = _rel(s, d, rel)
    inputs = rel("m_probe").select("file_id", "input_size", "duration_secs")
    outputs = rel("m_output").select("file_id", F.when(F.col("file_id") % 97 != 0, F.col("output_size")).alias("output_size"), "elapsed_secs")
    return results.encode_results(inputs, outputs, (check or checked(s, d, rel)).select("file_id", "is_valid"))


def batched(df: DataFrame) -> DataFrame:
    return df.withColumns({"batch": F.expr(BATCH), "filename": F.format_string("f%d.mkv", "file_id")})


def summarised(s: SparkSession, d: str, done: DataFrame | None = None, rel: Relations | None = None) -> DataFrame:
    """done: results that have been computed before, as they are or batched."""
    return results.summary(batched(done or encoded(s, d, rel=rel)), batched(_rel(s, d, rel)("m_probe").select("file_id")))


def rolled_up(s: SparkSession, d: str) -> DataFrame:
    """What files encoded as their requests ask came to, by width band, dynamic range and preset."""
    facts = requested(s, d).select("file_id", "category", "dynamic_range", F.col("preset_label").alias("preset"))
    return results.rollup(encoded(s, d).join(facts, "file_id"))


RESULTS_SQL = f"""results AS (SELECT p.file_id, {BATCH.replace('file_id', 'p.file_id')} AS batch, 'f' || p.file_id || '.mkv' AS filename, p.input_size, CASE WHEN p.file_id % 97 <> 0 THEN output_size ELSE 0 END AS output_size,
  duration_secs, elapsed_secs, is_valid, CAST(round(duration_secs * 1000e0) AS BIGINT) AS video_ms, CAST(round(elapsed_secs * 1000e0) AS BIGINT) AS elapsed_ms
  FROM m_probe p JOIN m_output o ON p.file_id = o.file_id JOIN wide w ON p.file_id = w.file_id),
reduced AS (SELECT *, CASE WHEN input_size = 0 THEN 0e0 ELSE (input_size - output_size) / CAST(input_size AS DOUBLE) * 100e0 END AS reduction_pct, CASE WHEN elapsed_secs > 0 THEN duration_secs / elapsed_secs ELSE 0e0 END AS speed FROM results),
summary AS (SELECT f.batch, total_files, coalesce(successful, 0) AS successful, coalesce(input_bytes, 0) AS input_bytes, coalesce(output_bytes, 0) AS output_bytes, coalesce(elapsed, 0) AS elapsed_ms, coalesce(video, 0) AS video_ms,
  coalesce(passed, 0) AS passed, coalesce(CASE WHEN elapsed > 0 THEN video / CAST(elapsed AS DOUBLE) END, 0e0) AS avg_speed, coalesce(successful, 0) - coalesce(passed, 0) AS failed, only_name
  FROM (SELECT {BATCH} AS batch, count(*) AS total_files FROM m_probe GROUP BY 1) f LEFT JOIN (SELECT batch, count(*) AS successful, CAST(sum(input_size) AS BIGINT) AS input_bytes, CAST(sum(output_size) AS BIGINT) AS output_bytes,
    CAST(sum(elapsed_ms) AS BIGINT) AS elapsed, CAST(sum(video_ms) AS BIGINT) AS video, count(*) FILTER (WHERE is_valid) AS passed, min(filename) AS only_name FROM results GROUP BY batch) r ON f.batch = r.batch)"""


def _results_sql(body: str) -> str:
    return _check_sql(f",{RESULTS_SQL} {body}")


def batch_status(s: SparkSession, d: str) -> DataFrame:
    planned = listing.with_output(relation(s, d, "m_file"))
    there = planned.where("file_id % 5 = 0").select("output_path").distinct().withColumn("existing", F.lit(True))
    known = relation(s, d, "m_probe").select("file_id", (F.col("file_id") % 31 == 0).alias("failed"))
    done = relation(s, d, "m_output").select("file_id", F.lit(True).alias("encoded"))
    df = planned.join(there, "output_path", "left").join(known, "file_id", "left").join(done, "file_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return df.select("file_id", results.status(flag("existing"), F.coalesce("failed", F.lit(True)), flag("encoded")).alias("status"))


def duration_check(s: SparkSession, d: str) -> DataFrame:
    df = audio.ordered(relation(s, d, "m_out_audio")).join(relation(s, d, "m_probe").select("file_id", F.when(F.col("file_id") % 17 != 0, F.col("duration_secs")).alias("e")), "file_id")
    ok, message = audio.duration_checks(F.col("s"), F.col("e"))
    return df.select("file_id", ok.alias("ok"), message.alias("message"))


def track_check(s: SparkSession, d: str) -> DataFrame:
    want = audio.ordered(relation(s, d, "m_audio")).select("file_id", F.when(F.col("file_id") % 17 != 0, F.size("s")).alias("e"))
    opus, count, message = audio.track_checks(F.col("s"), F.col("e"))
    return audio.ordered(relation(s, d, "m_out_audio")).join(want, "file_id").select("file_id", opus.alias("all_opus"), count.alias("count_ok"), message.alias("message"))


QUERIES = {
    "encode_plan": (plans, sql("m_crop m_track m_audio", f",{PLAN_SQL} SELECT {PLAN_COLUMNS} FROM plan", *TO_DECISION, "audio_lists")),
    "encode_plan_requested": (requested_plans, sql("m_crop m_track m_audio m_request m_asked m_tuning", f",{REQUESTED_SQL} SELECT * FROM plan", *TO_DECISION, "audio_lists")),
    "encode_tasks": (
        lambda s, d: encoding.tasks(plans(s, d), audio.streams(relation(s, d, "m_audio"))),
        sql("m_crop m_track m_audio", f""",{PLAN_SQL}, counted AS (SELECT p.file_id, coalesce(n, 0) AS n FROM plan p LEFT JOIN audio_texts a ON p.file_id = a.file_id)
SELECT file_id, 0 AS task_no, 'video' AS kind, CAST(NULL AS INTEGER) AS audio_index, CAST(NULL AS BIGINT) AS bitrate_kbps, CAST(NULL AS VARCHAR) AS disposition, '' AS depends_on FROM plan
UNION ALL SELECT s.file_id, CAST(i + 1 AS INTEGER), 'audio', CAST(i AS INTEGER), CAST(k AS BIGINT), CASE WHEN d_default = 1 AND d_comment = 1 THEN 'default+comment' WHEN d_default = 1 THEN 'default' WHEN d_comment = 1 THEN 'comment' ELSE '0' END, ''
  FROM audio_streams s JOIN plan p ON s.file_id = p.file_id
UNION ALL SELECT file_id, CAST(n + 1 AS INTEGER), 'mux', NULL, NULL, NULL, array_to_string(range(n + 1), ',') FROM counted""", *TO_DECISION, "audio_lists"),
    ),
    "validation_wide": (lambda s, d: validation.wide(checked(s, d)), _check_sql("SELECT * FROM wide")),
    "validation_steps": (lambda s, d: validation.steps(checked(s, d)), _check_sql("SELECT * FROM steps")),
    "validation_failures": (lambda s, d: validation.failures(checked(s, d)), _check_sql("SELECT file_id, string_agg(name || ': ' || details, '; ' ORDER BY step_no) AS failures FROM steps WHERE NOT passed GROUP BY file_id")),
    "audio_duration_check": (
        duration_check,
        _check_sql("""SELECT f.file_id, f.file_id % 17 = 0 OR off_i IS NULL AS ok, CASE WHEN f.file_id % 17 = 0 THEN 'Audio duration validation skipped'
  WHEN off_i IS NOT NULL THEN printf('Audio stream %d duration mismatch: got %.1fs, expected %.1fs (diff: %.1fs)', off_i, off_d, ed, abs(off_d - ed)) WHEN timed = 0 THEN 'Audio duration unavailable - validation skipped'
  WHEN timed = 1 THEN 'Audio duration matches video' ELSE timed || ' audio stream durations match video' END AS message FROM facts f WHERE n > 0"""),
    ),
    "audio_track_check": (
        track_check,
        _check_sql("""SELECT file_id, opus AS all_opus, file_id % 17 = 0 OR n = etracks AS count_ok, CASE WHEN n = 1 AND opus THEN 'Audio track is Opus' WHEN n = 1 THEN 'Audio track is ' || codecs || ' (expected Opus)'
  WHEN opus THEN n || ' audio tracks, all Opus' ELSE n || ' audio tracks: ' || codecs END AS message FROM facts WHERE n > 0"""),
    ),
    "encode_results": (encoded, _results_sql("SELECT file_id, input_size, output_size, reduction_pct, speed, video_ms, elapsed_ms, is_valid FROM reduced")),
    "batch_status": (
        batch_status,
        sql("m_file m_probe m_output", f""",{PLANNED_SQL} SELECT f.file_id, CASE WHEN output_path IN (SELECT output_path FROM existing) THEN 'skipped' WHEN p.file_id IS NULL OR p.file_id % 31 = 0 THEN 'analysis_error'
  WHEN o.file_id IS NOT NULL THEN 'encoded' ELSE 'pending' END AS status FROM planned f LEFT JOIN m_probe p ON f.file_id = p.file_id LEFT JOIN m_output o ON f.file_id = o.file_id"""),
    ),
    "result_rollup": (
        rolled_up,
        sql("m_probe m_crop m_track m_audio m_output m_out_audio m_request m_asked m_tuning", f""",{CHECK_SQL},{RESULTS_SQL},{REQUESTED_SQL.removeprefix(ALL_CROPS_SQL).lstrip(",")},
asked_results AS (SELECT r.*, category, CASE WHEN p.is_hdr THEN 'HDR' ELSE 'SDR' END AS dynamic_range, upper(s.preset[1]) || s.preset[2:] AS preset FROM reduced r JOIN plan p ON r.file_id = p.file_id JOIN settings s ON r.file_id = s.file_id)
SELECT CAST(GROUPING(category, dynamic_range, preset) AS BIGINT) AS level, category, dynamic_range, preset, count(*) AS files, count(*) FILTER (WHERE is_valid) AS passed, CAST(sum(input_size) AS BIGINT) AS input_bytes,
  CAST(sum(output_size) AS BIGINT) AS output_bytes, CASE WHEN sum(input_size) = 0 THEN 0e0 ELSE (CAST(sum(input_size) AS BIGINT) - CAST(sum(output_size) AS BIGINT)) / CAST(CAST(sum(input_size) AS BIGINT) AS DOUBLE) * 100e0 END AS reduction_pct,
  coalesce(CASE WHEN sum(elapsed_ms) > 0 THEN CAST(sum(video_ms) AS BIGINT) / CAST(CAST(sum(elapsed_ms) AS BIGINT) AS DOUBLE) END, 0e0) AS avg_speed
FROM asked_results GROUP BY GROUPING SETS ((category, dynamic_range, preset), (category, dynamic_range), (category, preset), (category), (dynamic_range), (preset), ())""", *TO_DECISION, "audio_lists"),
    ),
    "batch_summary": (summarised, _results_sql("SELECT * EXCLUDE (only_name) FROM summary")),
    "batch_result": (
        lambda s, d: results.batch_result(summarised(s, d)),
        _results_sql("SELECT batch, successful, total_files, input_bytes, output_bytes, CASE WHEN input_bytes = 0 THEN 0e0 ELSE (input_bytes - output_bytes) / CAST(input_bytes AS DOUBLE) * 100e0 END AS reduction_pct, passed FROM summary"),
    ),
    "batch_outcome": (
        lambda s, d: (lambda done: results.outcome(summarised(s, d, done), batched(done)))(materialize(encoded(s, d), "results")),
        _results_sql("""SELECT batch, CASE successful WHEN 0 THEN 'warning' WHEN 1 THEN 'operation_complete' ELSE 'batch_complete' END AS kind, CASE successful WHEN 0 THEN 'No files were successfully encoded'
  WHEN 1 THEN 'Successfully encoded ' || only_name ELSE successful || ' of ' || total_files || ' succeeded' END AS message FROM summary"""),
    ),
    "file_reductions": (
        lambda s, d: results.file_reductions(batched(encoded(s, d))),
        _results_sql("SELECT batch, CAST(row_number() OVER (PARTITION BY batch ORDER BY file_id) AS INTEGER) AS position, filename, reduction_pct FROM reduced"),
    ),
}
