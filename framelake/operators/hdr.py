"""Dynamic range by both vocabularies, which are kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions import exprs as X


def by_probe(probe: DataFrame) -> DataFrame:
    return probe.select("file_id", X.hdr_from_probe(F.col("color_primaries"), F.col("color_transfer"), F.col("color_space")).alias("is_hdr"))


def by_track(tracks: DataFrame) -> DataFrame:
    return tracks.select("file_id", X.hdr_from_track(F.col("colour_primaries"), F.col("transfer_characteristics"), F.col("matrix_coefficients")).alias("is_hdr"))


def disagreements(probe: DataFrame, tracks: DataFrame) -> DataFrame:
    """Files on which the two detectors differ, or of which only one knows: file_id, probe_hdr, track_hdr."""
    a, b = by_probe(probe).withColumnRenamed("is_hdr", "probe_hdr"), by_track(tracks).withColumnRenamed("is_hdr", "track_hdr")
    return a.join(b, "file_id", "full_outer").where(~F.col("probe_hdr").eqNullSafe(F.col("track_hdr"))).select("file_id", "probe_hdr", "track_hdr")


def matrix(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Stand-alone check of (file_id, expected_hdr) against (file_id, actual_hdr): file_id, is_valid, message.

    Without a detected range nothing is valid; without an expected one any detected range is.
    """
    df = expected.join(actual, "file_id", "full_outer")
    e, a = F.col("expected_hdr"), F.col("actual_hdr")
    es, as_ = X.dynamic_range(e), X.dynamic_range(a)
    message = (
        F.when(e.isNotNull() & a.isNotNull(), F.when(e == a, F.concat(as_, F.lit(" preserved"))).otherwise(F.concat(F.lit("Expected "), es, F.lit(", found "), as_)))
        .when(a.isNotNull(), F.concat(F.lit("Output is "), as_))
        .when(e.isNotNull(), F.concat(F.lit("Expected "), es, F.lit(", but could not detect HDR status")))
        .otherwise("Could not detect HDR status")
    )
    return df.select("file_id", F.coalesce((e.isNull() & a.isNotNull()) | (e == a), F.lit(False)).alias("is_valid"), message.alias("message"))
