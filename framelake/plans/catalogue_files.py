"""Registered queries on dynamic range, settings and listings, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import exprs as X
from framelake.operators import config, hdr, listing

from .catalogue_media import HDR_TRACK_SQL, PROBE_HDR, sql
from .relations import relation

TRACK_HDR = HDR_TRACK_SQL.format(p="colour_primaries", t="transfer_characteristics", m="matrix_coefficients")
PRESET_SQL = """presets(preset, crf_sd, crf_hd, crf_uhd, encoder_default, tune, ac_bias, variance_boost, boost_strength, boost_octile) AS (
  VALUES ('grain', 24, 26, 26, 6, 0, '0.1', false, 0, 0), ('clean', 27, 29, 29, 6, 0, '0.05', false, 0, 0), ('quick', 32, 35, 36, 8, 0, '0.1', false, 0, 0))"""
CRF_SQL = r"""crf_parts AS (SELECT request_id, list_transform(string_split(regexp_replace(crf_spec, '^\s+|\s+$', '', 'g'), ','), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS p FROM m_request),
crf_values AS (SELECT request_id, CASE WHEN len(p) IN (1, 3) AND len(list_filter(p, lambda x: NOT coalesce(regexp_full_match(x, '0*[0-9]{1,10}') AND TRY_CAST(x AS BIGINT) <= 63, false))) = 0 THEN p END AS v FROM crf_parts),
crf AS (SELECT request_id, CAST(v[1] AS INTEGER) AS sd, CAST(v[CASE len(v) WHEN 3 THEN 2 ELSE 1 END] AS INTEGER) AS hd, CAST(v[len(v)] AS INTEGER) AS uhd, v IS NOT NULL AS ok FROM crf_values)"""
EFFECTIVE_SQL = """effective AS (SELECT r.request_id, preset, coalesce(sd, crf_sd) AS crf_sd, coalesce(hd, crf_hd) AS crf_hd, coalesce(uhd, crf_uhd) AS crf_uhd,
  coalesce(encoder_preset, encoder_default) AS encoder_preset, tune, ac_bias, film_grain, film_grain_denoise,
  CASE WHEN preset IS NULL THEN 'unknown_preset' WHEN crf_spec IS NOT NULL AND NOT ok THEN 'bad_crf_spec'
    WHEN coalesce(encoder_preset, encoder_default) NOT BETWEEN 0 AND 13 THEN 'encoder_preset_range'
    WHEN film_grain IS NULL AND film_grain_denoise IS NOT NULL THEN 'denoise_without_grain' END AS error
  FROM m_request r LEFT JOIN presets ON lower(coalesce(preset_name, 'grain')) = preset JOIN crf ON r.request_id = crf.request_id)"""
VIDEO_SQL = r"""named AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM m_file),
videos AS (SELECT *, lower(regexp_extract(name, '\.([^.]*)$', 1)) AS ext, '/out/' || regexp_replace(name, '\.[^.]*$', '') || '.mkv' AS output_path,
  regexp_replace(path, '/[^/]*$', '') AS directory FROM named
  WHERE NOT starts_with(name, '.') AND lower(regexp_extract(name, '\.([^.]*)$', 1)) IN ('mkv', 'wmv', 'ts', 'avi', 'mp4', 'm4v', 'mpg', 'mpeg', 'mov', 'webm', 'flv', 'm2ts', 'ogv', 'vob'))"""
PLANNED_SQL = r"""planned AS (SELECT file_id, path, '/out/' || regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', '') || '.mkv' AS output_path FROM m_file),
existing AS (SELECT DISTINCT output_path FROM planned WHERE file_id % 5 = 0)"""


def _planned(s, d):
    planned = listing.with_output(relation(s, d, "m_file"))
    return planned, planned.where("file_id % 5 = 0").select("output_path").distinct()


QUERIES = {
    "hdr_probe": (lambda s, d: hdr.by_probe(relation(s, d, "m_probe")), sql("m_probe", f"SELECT file_id, {PROBE_HDR} AS is_hdr FROM m_probe")),
    "hdr_track": (lambda s, d: hdr.by_track(relation(s, d, "m_track")), sql("m_track", f"SELECT file_id, {TRACK_HDR} AS is_hdr FROM m_track")),
    "hdr_disagreement": (
        lambda s, d: hdr.disagreements(relation(s, d, "m_probe"), relation(s, d, "m_track")),
        sql("m_track", f"""SELECT file_id, probe_hdr, track_hdr FROM (SELECT file_id, {PROBE_HDR} AS probe_hdr FROM m_probe) FULL JOIN (SELECT file_id, {TRACK_HDR} AS track_hdr FROM m_track) USING (file_id)
WHERE probe_hdr IS DISTINCT FROM track_hdr"""),
    ),
    "hdr_matrix": (
        lambda s, d: hdr.matrix(
            hdr.by_probe(relation(s, d, "m_probe")).select("file_id", F.when(F.col("file_id") % 3 != 0, F.col("is_hdr")).alias("expected_hdr")),
            relation(s, d, "m_output").select("file_id", F.when(F.col("file_id") % 4 != 0, X.hdr_from_track(F.lit(""), F.col("transfer_characteristics"), F.lit(""))).alias("actual_hdr")),
        ),
        sql("m_probe m_output", f"""SELECT file_id, coalesce((e IS NULL AND a IS NOT NULL) OR e = a, false) AS is_valid,
  CASE WHEN e IS NOT NULL AND a IS NOT NULL THEN CASE WHEN e = a THEN CASE WHEN a THEN 'HDR' ELSE 'SDR' END || ' preserved' ELSE 'Expected ' || CASE WHEN e THEN 'HDR' ELSE 'SDR' END || ', found ' || CASE WHEN a THEN 'HDR' ELSE 'SDR' END END
    WHEN a IS NOT NULL THEN 'Output is ' || CASE WHEN a THEN 'HDR' ELSE 'SDR' END WHEN e IS NOT NULL THEN 'Expected ' || CASE WHEN e THEN 'HDR' ELSE 'SDR' END || ', but could not detect HDR status'
    ELSE 'Could not detect HDR status' END AS message
FROM (SELECT file_id, CASE WHEN file_id % 3 <> 0 THEN {PROBE_HDR} END AS e FROM m_probe)
FULL JOIN (SELECT file_id, CASE WHEN file_id % 4 <> 0 THEN regexp_matches(lower(transfer_characteristics), 'pq|hlg|smpte 2084') END AS a FROM m_output) USING (file_id)"""),
    ),
    "resolution_band": (
        lambda s, d: relation(s, d, "m_probe").select("file_id", "width", X.band(F.col("width")).alias("category")),
        sql("m_probe", "SELECT file_id, width, CASE WHEN width >= 3840 THEN 'UHD' WHEN width >= 1920 THEN 'HD' ELSE 'SD' END AS category FROM m_probe"),
    ),
    "crf_band_join": (
        lambda s, d: config.crf_by_band(relation(s, d, "m_probe"), config.band_table(s)),
        sql("m_probe", """SELECT file_id, width, category, crf FROM m_probe
JOIN (VALUES ('SD', 0, 1920, 24), ('HD', 1920, 3840, 26), ('UHD', 3840, 2147483647, 26)) b(category, low, high, crf) ON width >= low AND width < high"""),
    ),
    "preset_dim": (
        lambda s, d: relation(s, d, "m_request").select(F.lower(F.coalesce("preset_name", F.lit("grain"))).alias("preset")).distinct().join(F.broadcast(config.presets(s)), "preset"),
        sql("m_request", f",{PRESET_SQL} SELECT preset, crf_sd, crf_hd, crf_uhd, encoder_default AS encoder_preset, tune, ac_bias, variance_boost, boost_strength, boost_octile FROM presets WHERE preset IN (SELECT lower(coalesce(preset_name, 'grain')) FROM m_request)"),
    ),
    "preset_names": (
        lambda s, d: relation(s, d, "m_request").select("request_id", X.preset_label(F.lower("preset_name")).alias("label")),
        sql("m_request", "SELECT request_id, CASE WHEN lower(preset_name) IN ('grain', 'clean', 'quick') THEN upper(preset_name[1]) || lower(preset_name[2:]) ELSE 'Default' END AS label FROM m_request"),
    ),
    "file_sizes": (
        lambda s, d: relation(s, d, "m_file").select("file_id", X.bytes_text(F.col("length") * F.col("file_id")).alias("size")),
        sql("m_file", "SELECT file_id, CASE WHEN n >= 1073741824 THEN printf('%.2f GiB', n / 1073741824e0) WHEN n >= 1048576 THEN printf('%.2f MiB', n / 1048576e0) WHEN n >= 1024 THEN printf('%.2f KiB', n / 1024e0) ELSE n || ' B' END AS size FROM (SELECT file_id, length * file_id AS n FROM m_file)"),
    ),
    "crf_parse": (lambda s, d: config.parse_requests(relation(s, d, "m_request")), sql("m_request", f",{CRF_SQL} SELECT * FROM crf")),
    "config_effective": (lambda s, d: config.resolved(relation(s, d, "m_request")), sql("m_request", f",{PRESET_SQL},{CRF_SQL},{EFFECTIVE_SQL} SELECT * EXCLUDE (error) FROM effective WHERE error IS NULL")),
    "config_check": (lambda s, d: config.audit(relation(s, d, "m_request")), sql("m_request", f",{PRESET_SQL},{CRF_SQL},{EFFECTIVE_SQL} SELECT request_id, coalesce(error, 'ok') AS error_code FROM effective")),
    "media_files": (lambda s, d: listing.sorted_videos(relation(s, d, "m_file")), sql("m_file", f",{VIDEO_SQL} SELECT file_id, path, name, ext, length FROM videos ORDER BY lower(name), path")),
    "output_path": (lambda s, d: listing.with_output(relation(s, d, "m_file")), sql("m_file", f",{PLANNED_SQL} SELECT * FROM planned")),
    "pending_files": (lambda s, d: listing.pending(*_planned(s, d)), sql("m_file", f",{PLANNED_SQL} SELECT * FROM planned WHERE output_path NOT IN (SELECT output_path FROM existing)")),
    "skipped_files": (
        lambda s, d: listing.skipped(*_planned(s, d)),
        sql("m_file", f",{PLANNED_SQL} SELECT *, 'Output file already exists: ' || output_path || '. Skipping encode.' AS message FROM planned WHERE output_path IN (SELECT output_path FROM existing)"),
    ),
    "output_collisions": (
        lambda s, d: listing.collisions(relation(s, d, "m_file")),
        sql("m_file", f""",{VIDEO_SQL} SELECT output_path, file_id, CAST(rn AS INTEGER) AS rn, CASE WHEN rn > 1 THEN f END AS blocked_by FROM (SELECT *, row_number() OVER w AS rn, first_value(file_id) OVER w AS f,
  count(*) OVER (PARTITION BY output_path) AS n FROM videos WINDOW w AS (PARTITION BY output_path ORDER BY lower(name), path, file_id)) WHERE n > 1"""),
    ),
    "batch_position": (
        lambda s, d: listing.positions(relation(s, d, "m_file")).drop("path"),
        sql("m_file", f""",{VIDEO_SQL} SELECT * FROM (SELECT directory, file_id, CAST(row_number() OVER (PARTITION BY directory ORDER BY lower(name), path, file_id) AS INTEGER) AS current_file,
  count(*) OVER (PARTITION BY directory) AS total_files FROM videos) WHERE total_files > 1"""),
    ),
    "stale_files": (
        lambda s, d: listing.stale(relation(s, d, "m_file").withColumn("age_hours", F.col("file_id") % 100), "red", 24),
        sql("m_file", r"SELECT file_id, path, file_id % 100 AS age_hours FROM m_file WHERE starts_with(regexp_extract(path, '[^/]*$'), 'red_') AND file_id % 100 > 24"),
    ),
}
