"""Relations of the media catalogue, derived from the driver's tables. The text runs in Spark SQL and in other engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelake.sources.tables import dealt

RELATIONS = {
    "m_probe": """
SELECT o_orderkey AS file_id,
  CASE o_orderkey % 6 WHEN 0 THEN 640 WHEN 1 THEN 1280 WHEN 2 THEN 1919 WHEN 3 THEN 1920 WHEN 4 THEN 3839 ELSE 3840 END AS width,
  CASE o_orderkey % 6 WHEN 0 THEN 480 WHEN 1 THEN 720 WHEN 2 THEN 1080 WHEN 3 THEN 1080 ELSE 2160 END AS height,
  o_totalprice / 100e0 AS duration_secs,
  CASE o_orderstatus WHEN 'F' THEN 'bt709' WHEN 'O' THEN 'BT2020' ELSE '' END AS color_primaries,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'smpte2084' WHEN '2-HIGH' THEN 'arib-std-b67' ELSE 'bt709' END AS color_transfer,
  CASE WHEN o_orderkey % 17 = 0 THEN 'bt2020nc' ELSE 'bt709' END AS color_space,
  CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN NULL WHEN '5-LOW' THEN 8 ELSE 10 END AS bit_depth,
  CAST(floor(o_totalprice * 1000e0) AS BIGINT) AS input_size
FROM orders""",
    "m_track": """
SELECT file_id,
  CASE color_primaries WHEN 'BT2020' THEN 'BT.2020' WHEN 'bt709' THEN 'BT.709' ELSE '' END AS colour_primaries,
  CASE color_transfer WHEN 'smpte2084' THEN 'PQ' WHEN 'arib-std-b67' THEN 'HLG' ELSE 'BT.709' END AS transfer_characteristics,
  CASE WHEN color_space = 'bt2020nc' THEN CASE WHEN file_id % 2 = 0 THEN 'BT.2020 non-constant' ELSE '' END ELSE 'BT.709' END AS matrix_coefficients,
  bit_depth
FROM m_probe WHERE file_id % 41 <> 0""",
    "m_audio": """
SELECT l_orderkey AS file_id,
  l_linenumber AS ord1, l_partkey AS ord2, l_suppkey AS ord3,
  CAST(floor(l_quantity) AS BIGINT) AS ord4,
  CAST(floor(l_quantity) AS BIGINT) % 9 AS channels,
  CASE l_returnflag WHEN 'A' THEN 'aac' WHEN 'N' THEN 'opus' ELSE 'Opus' END AS codec_name,
  CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS d_default,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS d_comment,
  CASE WHEN l_tax = 0e0 THEN 0e0 ELSE o_totalprice / 100e0 + (l_tax - 0.04e0) * 200e0 END AS duration_secs
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "m_out_audio": """
SELECT * FROM m_audio WHERE channels > 0 AND NOT (file_id % 23 = 0 AND ord1 = 1)""",
    "m_crop": """
SELECT l_orderkey AS file_id, l_linenumber AS sample_no, p.width, p.height,
  CASE WHEN l_quantity = 50e0 THEN 'x:1:2'
       WHEN l_quantity = 49e0 THEN CAST(p.width AS STRING) || ':' || CAST(p.height + 2 AS STRING) || ':0:0'
       WHEN l_orderkey % 4 = 0 AND l_discount > 0.07e0 THEN CAST(p.width AS STRING) || ':' || CAST(p.height AS STRING) || ':0:0'
       ELSE CAST(p.width AS STRING) || ':' || CAST(p.height - 60 - 3 * (l_orderkey % 5) - (l_partkey % 3) AS STRING) || ':0:' || CAST(30 + l_partkey % 3 AS STRING) END AS crop
FROM lineitem JOIN m_probe p ON l_orderkey = p.file_id""",
    "m_output": """
SELECT file_id,
  width AS out_width,
  CASE WHEN file_id % 11 = 0 THEN height - 2 ELSE height END AS out_height,
  duration_secs + CASE file_id % 7 WHEN 0 THEN 0.5e0 WHEN 1 THEN 2e0 WHEN 2 THEN 0.05e0 ELSE 0e0 END AS out_duration_secs,
  CASE file_id % 13 WHEN 0 THEN 'hevc' WHEN 1 THEN 'AV01' ELSE 'av1' END AS codec_name,
  bit_depth AS out_bit_depth,
  CASE WHEN file_id % 19 = 0 THEN 'SMPTE 2084' ELSE 'BT.709' END AS transfer_characteristics,
  CAST(floor(input_size * (0.2e0 + (file_id % 10) / 10e0)) AS BIGINT) AS output_size,
  (1 + file_id % 30) * 10e0 AS elapsed_secs
FROM m_probe WHERE file_id % 5 <> 0""",
    "m_progress": """
SELECT event_id, user_id AS job_id, ts,
  CASE event_type WHEN 'signup' THEN 'encoding_started' WHEN 'error' THEN 'error' ELSE 'encoding_progress' END AS kind,
  value AS elapsed_secs, 300e0 AS duration_secs
FROM events""",
    "m_file": """
SELECT p_partkey AS file_id,
  '/lib/d' || CAST(p_partkey % 7 AS STRING) || '/' || CASE WHEN p_partkey % 23 = 0 THEN '.' ELSE '' END
   || replace(p_name, ' ', '_') || CAST(p_partkey % 40 AS STRING)
   || CASE p_size % 6 WHEN 0 THEN '.mkv' WHEN 1 THEN '.MP4' WHEN 2 THEN '.m2ts' WHEN 3 THEN '.txt' WHEN 4 THEN '' ELSE '.webm' END AS path,
  CAST(floor(p_retailprice * 1000e0) AS BIGINT) AS length
FROM part""",
    "m_request": """
SELECT c_custkey AS request_id,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'grain' WHEN 'MACHINERY' THEN 'CLEAN' WHEN 'BUILDING' THEN 'quick' WHEN 'AUTOMOBILE' THEN NULL ELSE 'ultra' END AS preset_name,
  CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '27' WHEN 2 THEN ' 25 , 27 , 29 ' WHEN 3 THEN '64' WHEN 4 THEN '-1'
    WHEN 5 THEN '25,27' WHEN 6 THEN 'abc,27,29' WHEN 7 THEN '' ELSE '0' END AS crf_spec,
  CASE WHEN c_custkey % 10 = 0 THEN 14 WHEN c_custkey % 10 < 5 THEN NULL ELSE CAST(c_custkey % 14 AS INT) END AS encoder_preset,
  CASE c_custkey % 6 WHEN 0 THEN 8 ELSE NULL END AS film_grain,
  CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS film_grain_denoise
FROM customer""",
    "m_asked": """
SELECT o_orderkey AS file_id, o_custkey AS request_id FROM orders""",
    "m_tuning": """
SELECT c_custkey AS request_id,
  CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS variance_boost,
  CASE c_custkey % 5 WHEN 0 THEN CAST(1 + c_custkey % 3 AS INT) ELSE NULL END AS boost_strength,
  CASE c_custkey % 5 WHEN 0 THEN CAST(4 + c_custkey % 4 AS INT) ELSE NULL END AS boost_octile,
  CASE c_custkey % 7 WHEN 0 THEN 'hqdn3d=1:1:2:2' WHEN 1 THEN '' ELSE NULL END AS denoise_filter
FROM customer WHERE c_custkey % 3 <> 0""",
    "m_line": """
SELECT event_id, user_id AS job_id, ts, 300e0 AS duration_secs,
  CASE WHEN event_id % 10 = 0 THEN 'Press [q] to stop'
       WHEN event_id % 10 = 1 THEN 'frame= 12 fps=N/A q=0.0 size=N/A time=N/A bitrate=N/A speed=N/A'
       ELSE 'frame=' || lpad(CAST(event_id AS STRING), 6, ' ') || ' fps= ' || CAST(event_id % 60 AS STRING)
         || '.5 q=30.0 size= 1024KiB time=00:' || lpad(CAST(event_id % 60 AS STRING), 2, '0') || ':' || lpad(CAST(event_id % 47 AS STRING), 2, '0')
         || '.25 bitrate=' || CAST(event_id % 5000 AS STRING) || '.1kbits/s speed=' || CAST(event_id % 4 AS STRING) || '.25x' END AS line
FROM events""",
    "m_crop_line": """
SELECT file_id, sample_no,
  CASE WHEN file_id % 9 = 0 THEN 'size=N/A time=00:00:00.40' ELSE '[Parsed_cropdetect_0] x1:0 x2:1919 limit:16 crop=' || crop END AS line
FROM m_crop""",
}

#: The relations and base tables that each one reads.
NEEDS = {
    "m_probe": ["orders"], "m_track": ["m_probe"], "m_audio": ["lineitem", "orders"], "m_out_audio": ["m_audio"], "m_crop": ["lineitem", "m_probe"],
    "m_output": ["m_probe"], "m_progress": ["events"], "m_file": ["part"], "m_request": ["customer"], "m_asked": ["orders"], "m_tuning": ["customer"], "m_line": ["events"], "m_crop_line": ["m_crop"],
}


#: The largest table, by the key on which all that is made of it is joined and grouped.
DEALT = {"lineitem": "l_orderkey"}


def _closure(names: tuple[str, ...]) -> list[str]:
    """names and all they need, needed ones first."""
    out: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in out:
            out.append(n)

    for n in names:
        add(n)
    return out


def with_clause(*names: str) -> str:
    """WITH and the definitions of the relations, for text that goes on with further ones or a SELECT."""
    return "WITH " + ",\n".join(f"{n} AS ({RELATIONS[n]})" for n in _closure(names) if n in RELATIONS)


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for n in _closure((name,)):
        if n not in RELATIONS:
            df = spark.read.parquet(f"{sf_dir}/{n}.parquet")
            (dealt(df, DEALT[n]) if n in DEALT else df).createOrReplaceTempView(n)
    return spark.sql(f"{with_clause(name)}\nSELECT * FROM {name}")
