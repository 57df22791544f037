"""File listings, detector logs and progress logs as tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import exprs as X

from .directories import MediaListing


def list_directories(spark: SparkSession, paths: list[str], tasks: int = 64) -> DataFrame:
    """The videos in these directories, not below them: path, length, modificationTime. Contents aren't read, tasks do the listing."""
    spark.dataSource.register(MediaListing)
    return spark.read.format(MediaListing.name()).option("directories", json.dumps(paths)).option("tasks", tasks).load()


def list_directory(spark: SparkSession, path: str) -> DataFrame:
    """The videos in one directory, by name whatever its case, equal names by path. A directory without any is an error."""
    found = list_directories(spark, [path])
    if found.isEmpty():
        raise FileNotFoundError(f"no video files in {path}")
    return found.orderBy(F.lower(X.basename(F.col("path"))), "path")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of logs; carriage returns and newlines both end one."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"))
