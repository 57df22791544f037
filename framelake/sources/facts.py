"""Facts about files as bucketed tables, so that joins and aggregations on file_id need no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

KEY = "file_id"


def write_facts(facts: dict[str, DataFrame], buckets: int, prefix: str = "facts_") -> None:
    """Each table of facts as prefix + name in the catalogue, dealt to so many buckets by file_id and sorted in each.

    Tables with equal buckets are co-partitioned: whatever reads several of them, or the same one often, finds all rows of
    a file in one place. Each bucket is one file; take as many buckets as give files of some hundred megabytes in the
    largest table. Tables of that name are replaced.
    """
    for name, df in facts.items():
        dealt = df.repartition(buckets, KEY)
        dealt.write.mode("overwrite").bucketBy(buckets, KEY).sortBy(KEY).format("parquet").saveAsTable(prefix + name)


def reader(spark: SparkSession, prefix: str = "facts_") -> Callable[[str], DataFrame]:
    """From a name to the table that write_facts has written."""
    return lambda name: spark.table(prefix + name)
