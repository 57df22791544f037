"""Facts of decoded documents, and the documents that have to be turned down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import exprs as X
from framelake.sources.documents import first_track, first_video
from framelake.sources.tables import computed_once


def _facts(decoded: DataFrame) -> DataFrame:
    v, text = F.col("v"), F.coalesce("d.format.duration", F.lit(""))
    df = decoded.withColumn("v", first_video(F.col("d.streams"))).withColumn("duration_text", text)
    string = lambda c: F.coalesce(v[c], F.lit(""))
    return df.select(
        "file_id", "failed", "duration_text", F.coalesce(F.size("d.streams"), F.lit(0)).alias("n_streams"), v.isNotNull().alias("has_video"),
        X.number(F.col("duration_text")).alias("duration"),
        F.coalesce(v["width"], F.lit(0)).alias("width"), F.coalesce(v["height"], F.lit(0)).alias("height"),
        F.coalesce(X.uint(string("nb_frames"), 2**31 - 1), F.lit(0)).cast("bigint").alias("total_frames"),
        X.uint(string("bits_per_raw_sample"), 255).cast("int").alias("bit_depth"),
        *[string(c).alias(c) for c in ("codec_name", "color_primaries", "color_transfer", "color_space")],
    )


def decoded_facts(decoded: DataFrame) -> DataFrame:
    """file_id, failed, n_streams, codec_name, width, height of every document; of failed ones only the first two."""
    only = lambda c: F.when(~F.col("failed"), F.col(c)).alias(c)
    return _facts(decoded).select("file_id", "failed", *map(only, ("n_streams", "codec_name", "width", "height")))


def media_info(decoded: DataFrame) -> DataFrame:
    """file_id, duration_secs, width, height, total_frames; zero for what isn't there."""
    return _facts(decoded).where("NOT failed").select("file_id", F.coalesce("duration", F.lit(0.0)).alias("duration_secs"), "width", "height", "total_frames")


def error_reason() -> Column:
    """Why a document can't be used; null if it can. An empty duration counts as 0, another text must be a number."""
    return (
        F.when(F.col("failed"), "unreadable document").when((F.col("duration_text") != "") & F.col("duration").isNull(), "unreadable duration")
        .when(~F.col("has_video"), "no video stream").when((F.col("width") <= 0) | (F.col("height") <= 0), "no dimensions")
    )


def video_properties(decoded: DataFrame) -> DataFrame:
    """file_id, width, height, duration_secs, bit_depth, is_hdr and the colour texts of documents that can be used."""
    df = _facts(decoded).where(error_reason().isNull())
    hdr = X.hdr_from_probe(F.col("color_primaries"), F.col("color_transfer"), F.col("color_space"))
    return df.select("file_id", "width", "height", F.coalesce("duration", F.lit(0.0)).alias("duration_secs"), "bit_depth", hdr.alias("is_hdr"), "color_primaries", "color_transfer", "color_space")


def rejects(decoded: DataFrame) -> DataFrame:
    """A row to report for each document that can't be used: file_id, title, error_reason, suggestion."""
    df = computed_once(_facts(decoded), "error_reason", error_reason()).where("error_reason IS NOT NULL")
    return df.select("file_id", F.lit("Analysis Error").alias("title"), "error_reason", F.lit("Check if the file is a valid video format").alias("suggestion"))


def audio_streams(decoded: DataFrame) -> DataFrame:
    """Audio streams with channels, numbered from 0: file_id, audio_index, channels, codec_name, duration_secs, disposition."""
    df = decoded.where("NOT failed").select("file_id", F.posexplode("d.streams").alias("pos", "s"))
    df = df.where((F.col("s.codec_type") == "audio") & (F.col("s.channels") > 0))
    index = F.row_number().over(Window.partitionBy("file_id").orderBy("pos")) - 1
    flags = {f: F.coalesce(F.col("s.disposition")[f], F.lit(0)) for f in X.DISPOSITIONS}
    return df.select(
        "file_id", index.alias("audio_index"), F.col("s.channels").alias("channels"), F.coalesce("s.codec_name", F.lit("")).alias("codec_name"), X.stream_secs(F.coalesce("s.duration", F.lit("")), F.col("s.tags")).alias("duration_secs"), X.disposition_text(flags).alias("disposition")
    )


def track_facts(decoded: DataFrame) -> DataFrame:
    """file_id, format, primaries, transfer, matrix, bit_depth of the first video track; empty without one."""
    df = decoded.where("NOT failed").withColumn("v", first_track(F.col("d.media.track"), "Video"))
    string = lambda c: F.coalesce(F.col("v")[c], F.lit(""))
    return df.select(
        "file_id", string("Format").alias("format"), string("colour_primaries").alias("primaries"), string("transfer_characteristics").alias("transfer"), string("matrix_coefficients").alias("matrix"), X.uint(string("BitDepth"), 255).cast("int").alias("bit_depth")
    )
