"""Reading tables, and writing intermediate ones to the folder that all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Bytes of rows that go to a Python worker at once, where the session leaves it open. Rows of long texts would else stand in
#: one batch of 10,000, several times over: in the executor, and in each of its workers.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application, wherever the driver was started, and have long texts
    reach their Python workers in small batches: BATCH_SETTING is set in the caller's session for good, where it is unset."""
    app = spark.sparkContext.applicationId
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    out = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{root.name}-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is named, a local session makes a temporary one; a cluster is an error,
    since its executors would each write to their own disks."""
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not given:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        given = context.getCheckpointDir()
    return given.rstrip("/")


def app_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one. It is deleted when the driver ends; if that is killed, the cluster's
    retention clears it."""
    path = f"{shared_dir(spark)}/framelake-{spark.sparkContext.applicationId}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return path


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, so lost executors cost no rerun.
    codec: the compression, the session's if it is None."""
    spark = df.sparkSession
    path = f"{app_dir(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for f in {os.path.dirname(os.path.dirname(x)) for x in df.inputFiles() if "/framelake-" in x}:
        p = jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(conf).delete(p, True)
