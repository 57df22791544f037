"""Listings of files: which are videos, where their outputs go, which are still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import exprs as X

from .numbering import numbered

OUTPUT_DIR = "/out"


def videos(files: DataFrame) -> DataFrame:
    """The listing's videos: file_id, path, name, ext, length. Hidden files and other extensions go."""
    name = X.basename(F.col("path"))
    df = files.select("file_id", "path", name.alias("name"), X.extension(name).alias("ext"), "length")
    return df.where(~F.col("name").startswith(".") & F.col("ext").isin(X.VIDEO_EXTENSIONS))


def sorted_videos(files: DataFrame) -> DataFrame:
    """videos in the order they are worked on: by name whatever its case, then by path."""
    return videos(files).orderBy(F.lower("name"), "path")


def output_path(path: Column, out_dir: str = OUTPUT_DIR) -> Column:
    return F.concat(F.lit(f"{out_dir}/"), X.stem(X.basename(path)), F.lit(".mkv"))


def with_output(files: DataFrame) -> DataFrame:
    return files.select("file_id", "path", output_path(F.col("path")).alias("output_path"))


def pending(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """Files whose output isn't there yet. existing: (output_path)."""
    return planned.join(existing, "output_path", "left_anti").select("file_id", "path", "output_path")


def skipped(planned: DataFrame, existing: DataFrame) -> DataFrame:
    found = planned.join(existing, "output_path", "left_semi")
    message = F.concat(F.lit("Output file already exists: "), F.col("output_path"), F.lit(". Skipping encode."))
    return found.select("file_id", "path", "output_path", message.alias("message"))


def collisions(files: DataFrame) -> DataFrame:
    """Videos that share an output: output_path, file_id, rn, blocked_by (the first one, which keeps it).

    Numbers are given by ranges, so one output of very many files isn't one task.
    """
    df = videos(files).select(output_path(F.col("path")).alias("output_path"), F.lower("name").alias("low"), "path", "file_id")
    df = numbered(df, "output_path", ["low", "path", "file_id"]).where("in_group > 1")
    return df.select("output_path", "file_id", F.col("position").alias("rn"), F.when(F.col("position") > 1, F.col("leader.file_id")).alias("blocked_by"))


def positions(files: DataFrame) -> DataFrame:
    """File i of n in each directory with more than one video: directory, file_id, path, current_file, total_files."""
    df = videos(files).select(X.directory(F.col("path")).alias("directory"), F.lower("name").alias("low"), "path", "file_id")
    df = numbered(df, "directory", ["low", "path", "file_id"]).where("in_group > 1")
    return df.select("directory", "file_id", "path", F.col("position").alias("current_file"), F.col("in_group").alias("total_files"))


def stale(files: DataFrame, prefix: str, max_age_hours: float) -> DataFrame:
    """Files named prefix_... that are older than so many hours: file_id, path, age_hours. Of a listing with age_hours."""
    return files.where(X.basename(F.col("path")).startswith(f"{prefix}_") & (F.col("age_hours") > max_age_hours)).select("file_id", "path", "age_hours")
