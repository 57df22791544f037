"""Probe and track documents: their schemas, and decoding them with what can't be decoded kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import exprs as X

_FLAGS = ", ".join(f"`{f}`: int" for f in X.DISPOSITIONS)
PROBE_SCHEMA = (
    "format struct<duration: string>, streams array<struct<codec_type: string, codec_name: string, profile: string, width: bigint, height: bigint, channels: int, "
    "duration: string, nb_frames: string, pix_fmt: string, color_primaries: string, color_transfer: string, color_space: string, bits_per_raw_sample: string, "
    f"tags: map<string, string>, disposition: struct<{_FLAGS}>>>"
)
TRACK_SCHEMA = (
    "media struct<track: array<struct<`@type`: string, Format: string, Width: string, Height: string, Duration: string, BitDepth: string, ColorSpace: string, ChromaSubsampling: string, "
    "colour_range: string, colour_primaries: string, transfer_characteristics: string, matrix_coefficients: string, Channels: string, SamplingRate: string, BitRate: string>>>"
)


def decode(docs: DataFrame, schema: str) -> DataFrame:
    """(file_id, doc) to (file_id, d, failed). A syntax error or a wrong type anywhere fails the whole document."""
    parsed = F.from_json("doc", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    df = docs.select("file_id", parsed.alias("d"))
    return df.withColumn("failed", F.col("d").isNull() | F.col("d._corrupt").isNotNull())


def probe_documents(docs: DataFrame) -> DataFrame:
    return decode(docs, PROBE_SCHEMA)


def track_documents(docs: DataFrame) -> DataFrame:
    return decode(docs, TRACK_SCHEMA)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, doc): one JSON file a document, named by its path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file_id"), F.col("value").alias("doc"))


def first_video(streams: Column) -> Column:
    """The first stream that is video, in the document's order."""
    return F.get(F.filter(streams, lambda s: s["codec_type"] == "video"), F.lit(0))


def first_track(tracks: Column, kind: str) -> Column:
    return F.get(F.filter(tracks, lambda t: t["@type"] == kind), F.lit(0))
