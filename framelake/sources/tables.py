"""Tables that are written: results for others, and intermediate ones in the folder that all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: By which columns a result is laid out; the others are written as they come.
PARTITIONS = {"encode_plan": ["category"], "validation_steps": ["step_no"], "encode_results": ["is_valid"], "batch_summary": []}

#: About how many rows of the largest table a task gets when they are dealt by key.
PART_ROWS = 150_000


def write_table(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> str:
    """df as Parquet under root/name, by the columns of PARTITIONS; of a table that is there, only the partitions that df
    holds are replaced. Returns the path."""
    path, by = f"{root.rstrip('/')}/{name}", PARTITIONS.get(name, [])
    writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return path


def shared_dir(df: DataFrame) -> str:
    """spark.checkpoint.dir, or the context's own; a local session without one makes a temporary folder, a cluster is an error."""
    spark = df.sparkSession
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def app_dir(df: DataFrame) -> str:
    """This application's folder for intermediate tables. It is deleted when the driver ends; if that is killed, the
    cluster's retention clears it."""
    spark = df.sparkSession
    path = f"{shared_dir(df)}/tables-{spark.sparkContext.applicationId}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, for what several parts of a query read."""
    path = f"{app_dir(df)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key to parts of some PART_ROWS rows, so that a task of what is joined and grouped by the key after it
    holds as much, however large df is and before any of it is sorted or counted. A table of one part stays as it is.

    df should be a table of Parquet: its rows are counted from the files' footers.
    """
    parts = -(-df.count() // PART_ROWS)
    return df if parts < 2 else df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds value as a column that is computed once for each row, also if rows are filtered by it: a filter on a plain column is
    moved below what the column is made of, and then makes it again, all of it for each time that value names it. It isn't
    moved below a list of one that is laid out as rows.
    """
    return df.withColumn(f"__{name}", value).withColumn(name, F.explode_outer(F.array(f"__{name}"))).drop(f"__{name}")


def release(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    for f in {os.path.dirname(x) for x in df.inputFiles() if "/tables-" in x}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
