"""Registered queries on crops, audio and listings, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import exprs as X
from framelake.operators import audio, crop

from .relations import relation, with_clause

EXTRA_CTES = {
    "crop_counts": """
crop_counts AS (SELECT file_id, width, height, crop, count(*) AS cnt FROM m_crop WHERE crop <> '' GROUP BY ALL)""",
    "crop_margins": """
crop_parsed AS (SELECT *, string_split(crop, ':') AS p FROM crop_counts),
crop_numbers AS (SELECT *,
  CASE WHEN len(p) = 4 AND regexp_full_match(p[1], '0*[0-9]{1,10}') AND regexp_full_match(p[2], '0*[0-9]{1,10}') AND regexp_full_match(p[3], '0*[0-9]{1,10}') AND regexp_full_match(p[4], '0*[0-9]{1,10}')
    THEN [CAST(p[1] AS BIGINT), CAST(p[2] AS BIGINT), CAST(p[3] AS BIGINT), CAST(p[4] AS BIGINT)] END AS v FROM crop_parsed),
crop_fits AS (SELECT *, v IS NOT NULL AND v[3] <= width AND v[1] <= width - v[3] AND v[4] <= height AND v[2] <= height - v[4] AS ok FROM crop_numbers),
crop_margins AS (SELECT file_id, width, height, CAST(sum(cnt) AS BIGINT) AS total, count(*) AS n,
  min(CASE WHEN ok THEN v[4] - v[4] % 2 END) AS t, min(CASE WHEN ok THEN (height - v[4] - v[2]) - (height - v[4] - v[2]) % 2 END) AS b,
  min(CASE WHEN ok THEN v[3] - v[3] % 2 END) AS l, min(CASE WHEN ok THEN (width - v[3] - v[1]) - (width - v[3] - v[1]) % 2 END) AS r
  FROM crop_fits GROUP BY file_id, width, height)""",
    "crop_decision": """
crop_sized AS (SELECT *, width - l - r AS w, height - t - b AS h FROM crop_margins),
crop_usable AS (SELECT *, coalesce(w > 0 AND h > 0 AND w % 2 = 0 AND h % 2 = 0, false) AS usable, w = width AND h = height AS whole FROM crop_sized),
crop_decision AS (SELECT file_id,
  CASE WHEN usable AND NOT whole THEN 'crop=' || w || ':' || h || ':' || l || ':' || t ELSE '' END AS crop_filter,
  usable AND NOT coalesce(whole, true) AS required, usable AND coalesce(whole, false) AND n > 1 AS multiple_ratios,
  CASE WHEN usable AND NOT whole THEN 'Black bars detected' WHEN usable AND whole AND n > 1 THEN 'Multiple aspect ratios detected' ELSE 'Analyzed 141 samples' END AS message,
  total AS total_samples FROM crop_usable)""",
    "audio_lists": """
audio_streams AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ord1, ord2, ord3, ord4) - 1 AS i,
  CASE channels WHEN 1 THEN 64 WHEN 2 THEN 128 WHEN 6 THEN 256 WHEN 8 THEN 384 ELSE 48 * channels END AS k FROM m_audio WHERE channels > 0),
audio_lists AS (SELECT f.file_id, count(s.file_id) AS n, min(s.channels) AS c1, min(s.k) AS k1,
  coalesce(string_agg(CAST(s.channels AS VARCHAR), ',' ORDER BY i), '') AS channels_text,
  string_agg(printf('Stream %d (%dch)', i, channels), ', ' ORDER BY i) AS basic_many,
  string_agg(printf('Stream %d: %dch [%dkbps Opus]', i, channels, k), ', ' ORDER BY i) AS config_many,
  string_agg(printf('%dch@%dk', channels, k), ', ' ORDER BY i) AS results_many
  FROM (SELECT DISTINCT file_id FROM m_audio) f LEFT JOIN audio_streams s ON f.file_id = s.file_id GROUP BY f.file_id),
audio_texts AS (SELECT file_id, n, channels_text,
  CASE n WHEN 0 THEN 'No audio' WHEN 1 THEN printf('%d channels', c1) ELSE n || ' streams: ' || basic_many END AS basic,
  CASE n WHEN 0 THEN 'No audio' WHEN 1 THEN printf('%d channels @ %dkbps Opus', c1, k1) ELSE config_many END AS config,
  CASE n WHEN 0 THEN 'No audio' WHEN 1 THEN printf('Opus %dch @ %dkbps', c1, k1) ELSE 'Opus (' || results_many || ')' END AS results FROM audio_lists)""",
}
HDR_PROBE_SQL = "(regexp_matches(lower({p}), 'bt2020|bt\\.2020|bt2100') OR regexp_matches(lower({t}), 'pq|smpte2084|hlg|arib-std-b67') OR regexp_matches(lower({m}), 'bt2020|bt\\.2020'))"
HDR_TRACK_SQL = "(regexp_matches(lower({p}), 'bt\\.2020|bt\\.2100') OR regexp_matches(lower({t}), 'pq|hlg|smpte 2084') OR regexp_matches(lower({m}), 'bt\\.2020'))"


def sql(relations: str, body: str, *ctes: str) -> str:
    return with_clause(*relations.split()) + "".join("," + EXTRA_CTES[c] for c in ctes) + "\n" + body


PROBE_HDR = HDR_PROBE_SQL.format(p="color_primaries", t="color_transfer", m="color_space")
TO_MARGINS = ("crop_counts", "crop_margins")
TO_DECISION = (*TO_MARGINS, "crop_decision")

QUERIES = {
    "crop_decision": (lambda s, d: crop.decisions(relation(s, d, "m_crop")), sql("m_crop", "SELECT * FROM crop_decision", *TO_DECISION)),
    "crop_margins": (lambda s, d: crop.margins(relation(s, d, "m_crop")), sql("m_crop", "SELECT file_id, t, b, l, r FROM crop_margins WHERE t IS NOT NULL", *TO_MARGINS)),
    "crop_candidates": (
        lambda s, d: crop.candidates(relation(s, d, "m_crop")),
        sql("m_crop", """SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY cnt DESC, crop) AS INTEGER) AS rank, crop, cnt,
  round(cnt / sum(cnt) OVER (PARTITION BY file_id) * 100e0, 6) AS pct FROM crop_counts""", "crop_counts"),
    ),
    "crop_top10": (
        lambda s, d: crop.top_candidates(relation(s, d, "m_crop")),
        sql("m_crop", """SELECT file_id, rank, crop, cnt, pct, CASE WHEN rank = 10 THEN greatest(n - 10, 0) END AS remainder FROM (
  SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY cnt DESC, crop) AS INTEGER) AS rank, crop, cnt,
    round(cnt / sum(cnt) OVER (PARTITION BY file_id) * 100e0, 6) AS pct, count(*) OVER (PARTITION BY file_id) AS n FROM crop_counts) WHERE rank <= 10""", "crop_counts"),
    ),
    "crop_sample_mode": (
        lambda s, d: crop.sample_modes(relation(s, d, "m_crop")),
        sql("m_crop", """SELECT file_id, sample_no, crop, votes FROM (SELECT *, row_number() OVER (PARTITION BY file_id, sample_no ORDER BY votes DESC, crop) AS n
  FROM (SELECT file_id, sample_no, crop, count(*) AS votes FROM m_crop GROUP BY ALL)) WHERE n = 1"""),
    ),
    "crop_lines": (
        lambda s, d: crop.crops_of_lines(relation(s, d, "m_crop_line")),
        sql("m_crop_line", """SELECT file_id, sample_no, crop FROM (SELECT *, regexp_extract(line, 'crop=([0-9]+:[0-9]+:[0-9]+:[0-9]+)', 1) AS crop FROM m_crop_line)
WHERE crop <> '' AND len(list_filter(string_split(crop, ':'), lambda x: TRY_CAST(x AS UINTEGER) IS NULL)) = 0"""),
    ),
    "crop_sample_plan": (
        lambda s, d: crop.sample_plan(relation(s, d, "m_probe")),
        sql("m_probe", f"""SELECT file_id, CAST(i - 30 AS INTEGER) AS sample_no, i / 200e0 AS position, printf('%.2f', duration_secs * (i / 200e0)) AS start_secs,
  CASE WHEN {PROBE_HDR} THEN 100 ELSE 16 END AS limit_value FROM m_probe, (SELECT unnest(range(30, 171)) AS i)"""),
    ),
    "crop_detection": (
        lambda s, d: crop.decide_from_lines(relation(s, d, "m_probe"), relation(s, d, "m_crop_line")),
        sql("m_crop_line m_probe", """,
line_crops AS (SELECT file_id, sample_no, regexp_extract(line, 'crop=([0-9]+:[0-9]+:[0-9]+:[0-9]+)', 1) AS crop FROM m_crop_line),
line_modes AS (SELECT file_id, crop FROM (SELECT *, row_number() OVER (PARTITION BY file_id, sample_no ORDER BY votes DESC, crop) AS n
  FROM (SELECT file_id, sample_no, crop, count(*) AS votes FROM line_crops WHERE crop <> '' GROUP BY ALL)) WHERE n = 1),
crop_counts AS (SELECT m.file_id, p.width, p.height, m.crop, count(*) AS cnt FROM line_modes m JOIN m_probe p ON m.file_id = p.file_id GROUP BY ALL),"""
            + EXTRA_CTES["crop_margins"] + "," + EXTRA_CTES["crop_decision"] + """
SELECT p.file_id, coalesce(crop_filter, '') AS crop_filter, coalesce(required, false) AS required, coalesce(multiple_ratios, false) AS multiple_ratios,
  coalesce(message, 'Analyzed 141 samples') AS message, coalesce(total_samples, 141) AS total_samples FROM m_probe p LEFT JOIN crop_decision c ON p.file_id = c.file_id"""),
    ),
    "audio_streams": (
        lambda s, d: audio.streams(relation(s, d, "m_audio")),
        sql("m_audio", """SELECT file_id, CAST(i AS INTEGER) AS audio_index, channels, codec_name, duration_secs, CAST(k AS BIGINT) AS bitrate_kbps,
  CASE WHEN d_default = 1 AND d_comment = 1 THEN 'default+comment' WHEN d_default = 1 THEN 'default' WHEN d_comment = 1 THEN 'comment' ELSE '0' END AS disposition FROM audio_streams""", "audio_lists"),
    ),
    "audio_channels": (lambda s, d: audio.channel_lists(relation(s, d, "m_audio")), sql("m_audio", "SELECT file_id, channels_text FROM audio_texts", "audio_lists")),
    "audio_description": (lambda s, d: audio.descriptions(relation(s, d, "m_audio")), sql("m_audio", "SELECT file_id, basic, config, results FROM audio_texts", "audio_lists")),
}
