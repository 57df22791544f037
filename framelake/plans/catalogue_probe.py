"""Registered queries on probe and track documents, each beside its SQL.

The documents are made from the relations, so the SQL can read what they were made from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import probe
from framelake.sources import documents
from framelake.sources.tables import dealt

from .catalogue_media import PROBE_HDR, sql
from .relations import relation

#: How documents are spoiled, and what their streams hold, on top of the relation.
SHAPED_SQL = """shaped AS (SELECT *, file_id % 29 = 0 AS broken, file_id % 31 <> 0 AS has_video, CASE WHEN file_id % 37 = 0 THEN 0 ELSE width END AS w,
  file_id % 43 = 0 AS bad_duration, file_id % 47 = 0 AS no_duration, CASE WHEN file_id % 7 = 0 THEN 0 ELSE CAST(floor(duration_secs * 24e0) AS BIGINT) END AS frames FROM m_probe)"""
FACTS_SQL = """facts AS (SELECT *, CASE WHEN bad_duration OR no_duration THEN 0e0 ELSE duration_secs END AS secs,
  CASE WHEN broken THEN 'unreadable document' WHEN bad_duration THEN 'unreadable duration' WHEN NOT has_video THEN 'no video stream' WHEN w = 0 THEN 'no dimensions' END AS reason FROM shaped)"""


def probe_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i = dealt(relation(spark, sf_dir, "m_probe"), "file_id"), F.col("file_id")
    text = lambda c: c.cast("string")
    video = F.struct(
        F.lit("video").alias("codec_type"), F.lit("h264").alias("codec_name"), F.when(i % 37 == 0, F.lit(0)).otherwise(F.col("width")).cast("bigint").alias("width"),
        F.col("height").cast("bigint").alias("height"), F.lit(None).cast("int").alias("channels"), F.lit(None).cast("string").alias("duration"),
        F.when(i % 7 == 0, F.lit("N/A")).otherwise(text(F.floor(F.col("duration_secs") * 24.0))).alias("nb_frames"), "color_primaries", "color_transfer", "color_space",
        text(F.col("bit_depth")).alias("bits_per_raw_sample"), F.lit(None).cast("map<string,string>").alias("tags"), F.lit(None).cast("struct<default:int,forced:int>").alias("disposition"),
    )

    def sound(codec: str, channels, duration, tag):
        none = F.lit(None).cast("string")
        return F.struct(
            F.lit("audio").alias("codec_type"), F.lit(codec).alias("codec_name"), F.lit(None).cast("bigint").alias("width"), F.lit(None).cast("bigint").alias("height"), channels.cast("int").alias("channels"), duration.alias("duration"),
            none.alias("nb_frames"), none.alias("color_primaries"), none.alias("color_transfer"), none.alias("color_space"), none.alias("bits_per_raw_sample"),
            F.when(tag.isNotNull(), F.create_map(F.lit("DURATION"), tag)).alias("tags"), F.struct((i % 2).cast("int").alias("default"), (i % 3).cast("int").alias("forced")).alias("disposition"),
        )

    clock = F.format_string("00:%02d:30.500000000", i % 60)
    streams = F.array(sound("truehd", i % 9, text(F.col("duration_secs")), F.lit(None).cast("string")), video, sound("ac3", F.lit(6), F.lit("N/A"), clock), sound("opus", F.lit(2), F.lit(None).cast("string"), F.lit(None).cast("string")))
    streams = F.when(i % 31 == 0, F.filter(streams, lambda s: s["codec_type"] != "video")).otherwise(streams)
    duration = F.when(i % 43 == 0, F.lit("1d")).when(i % 47 == 0, F.lit("")).otherwise(text(F.col("duration_secs")))
    doc = F.to_json(F.struct(F.struct(duration.alias("duration")).alias("format"), streams.alias("streams")))
    return p.select("file_id", F.when(i % 29 == 0, F.concat(F.substring(doc, 1, 40), F.lit("}"))).otherwise(doc).alias("doc"))


def track_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relation(spark, sf_dir, "m_track")
    none = F.lit(None).cast("string")
    general = F.struct(F.lit("General").alias("@type"), F.lit("Matroska").alias("Format"), none.alias("BitDepth"), none.alias("colour_primaries"), none.alias("transfer_characteristics"), none.alias("matrix_coefficients"))
    video = F.struct(F.lit("Video").alias("@type"), F.lit("HEVC").alias("Format"), F.col("bit_depth").cast("string").alias("BitDepth"), "colour_primaries", "transfer_characteristics", "matrix_coefficients")
    tracks = F.when(F.col("file_id") % 31 == 0, F.array(general)).otherwise(F.array(general, video))
    return t.select("file_id", F.to_json(F.struct(F.struct(tracks.alias("track")).alias("media"))).alias("doc"))


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.probe_documents(probe_docs(spark, sf_dir))


def _sql(body: str) -> str:
    return sql("m_probe", f",{SHAPED_SQL},{FACTS_SQL} {body}")


QUERIES = {
    "probe_decode": (
        lambda s, d: probe.decoded_facts(decoded(s, d)),
        _sql("""SELECT file_id, broken AS failed, CASE WHEN NOT broken THEN CASE WHEN has_video THEN 4 ELSE 3 END END AS n_streams, CASE WHEN NOT broken THEN CASE WHEN has_video THEN 'h264' ELSE '' END END AS codec_name,
  CASE WHEN NOT broken THEN CAST(CASE WHEN has_video THEN w ELSE 0 END AS BIGINT) END AS width, CASE WHEN NOT broken THEN CAST(CASE WHEN has_video THEN height ELSE 0 END AS BIGINT) END AS height FROM facts"""),
    ),
    "media_info": (
        lambda s, d: probe.media_info(decoded(s, d)),
        _sql("SELECT file_id, secs AS duration_secs, CAST(CASE WHEN has_video THEN w ELSE 0 END AS BIGINT) AS width, CAST(CASE WHEN has_video THEN height ELSE 0 END AS BIGINT) AS height, CAST(CASE WHEN has_video THEN frames ELSE 0 END AS BIGINT) AS total_frames FROM facts WHERE NOT broken"),
    ),
    "video_properties": (
        lambda s, d: probe.video_properties(decoded(s, d)),
        _sql(f"SELECT file_id, CAST(w AS BIGINT) AS width, CAST(height AS BIGINT) AS height, secs AS duration_secs, bit_depth, {PROBE_HDR} AS is_hdr, color_primaries, color_transfer, color_space FROM facts WHERE reason IS NULL"),
    ),
    "rejects": (
        lambda s, d: probe.rejects(decoded(s, d)),
        _sql("SELECT file_id, 'Analysis Error' AS title, reason AS error_reason, 'Check if the file is a valid video format' AS suggestion FROM facts WHERE reason IS NOT NULL"),
    ),
    "probe_audio": (
        lambda s, d: probe.audio_streams(decoded(s, d)),
        _sql("""SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY pos) - 1 AS INTEGER) AS audio_index, CAST(channels AS INTEGER) AS channels, codec_name, secs AS duration_secs,
  CASE WHEN file_id % 2 = 1 AND file_id % 3 <> 0 THEN 'default+forced' WHEN file_id % 2 = 1 THEN 'default' WHEN file_id % 3 <> 0 THEN 'forced' ELSE '0' END AS disposition
FROM (SELECT file_id, 0 AS pos, file_id % 9 AS channels, 'truehd' AS codec_name, duration_secs AS secs FROM facts WHERE NOT broken
  UNION ALL SELECT file_id, 2, 6, 'ac3', (file_id % 60) * 60 + 30.5e0 FROM facts WHERE NOT broken UNION ALL SELECT file_id, 3, 2, 'opus', 0e0 FROM facts WHERE NOT broken) WHERE channels > 0"""),
    ),
    "track_decode": (
        lambda s, d: probe.track_facts(documents.track_documents(track_docs(s, d))),
        sql("m_track", """SELECT file_id, CASE WHEN v THEN 'HEVC' ELSE '' END AS format, CASE WHEN v THEN colour_primaries ELSE '' END AS primaries, CASE WHEN v THEN transfer_characteristics ELSE '' END AS transfer,
  CASE WHEN v THEN matrix_coefficients ELSE '' END AS matrix, CASE WHEN v THEN bit_depth END AS bit_depth FROM (SELECT *, file_id % 31 <> 0 AS v FROM m_track)"""),
    ),
}
