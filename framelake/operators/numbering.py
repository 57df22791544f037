"""Numbers of rows, and scans along them, inside groups of which one may hold much of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.sources.tables import materialize

RANGE = "__range"


def in_ranges(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df dealt by ranges of group and order, written with each row's range. A group is as many tasks as it has ranges.

    Dealing by ranges reads its input twice, once for a sample; df should be a table, not a long plan.
    """
    return materialize(df.repartitionByRange(group, *order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def with_carry(rows: DataFrame, carry: DataFrame, group: str) -> DataFrame:
    """rows in ranges joined with carry, one row for each group and range; a null group is one too."""
    c = carry.withColumnsRenamed({group: "__group", RANGE: "__in"})
    return rows.join(c, F.col(group).eqNullSafe(F.col("__group")) & (F.col(RANGE) == F.col("__in"))).drop("__group", "__in", RANGE)


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds `position` (from 1, in this order), `in_group`, the rows of the group, and `leader`, the order's columns of its first row.

    Rows are numbered inside each range, and shifted by what stands before it. df is computed once.
    """
    dealt = in_ranges(materialize(df, "unnumbered"), group, order)
    whole = Window.partitionBy(group)
    before = whole.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(group, RANGE).agg(F.count("*").alias("__n"), F.min(F.struct(*order)).alias("__least"))
    counts = counts.withColumns({"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), "in_group": F.sum("__n").over(whole), "leader": F.min("__least").over(whole)}).drop("__n", "__least")
    inside = dealt.withColumn("position", F.row_number().over(Window.partitionBy(group, RANGE).orderBy(*order)))
    return with_carry(inside, counts, group).withColumn("position", (F.col("position") + F.col("__before")).cast("int")).drop("__before")


def scan_runs(df: DataFrame, group: str, order: list[str], start: Column, value: Column | None = None) -> DataFrame:
    """Adds `run_no`, the starts of the group up to and with the row, and `before`, the largest value of the row's run ahead
    of it (null if there is none, or without value).

    A segmented scan in three steps: each range of a group comes down to its number of starts and the largest value since
    the last of them; these carries, one short row each, are combined in order; then each range is scanned from its carry.
    So no task reads more of a group than a range.
    """
    dealt = in_ranges(df.withColumns({"__start": F.coalesce(start, F.lit(False)).cast("int"), "__value": F.lit(None) if value is None else value}), group, order)
    inside = Window.partitionBy(group, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.withColumn("__local", F.sum("__start").over(inside))
    tail = F.max(F.when(F.col("__value").isNotNull(), F.struct(F.col("__local").alias("run"), F.col("__value").alias("value"))))
    carry = local.groupBy(group, RANGE).agg(F.max("__local").alias("__starts"), tail.alias("__tail"))
    ahead = Window.partitionBy(group).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.withColumn("__runs", F.coalesce(F.sum("__starts").over(ahead), F.lit(0)))
    tail = F.when(F.col("__tail").isNotNull(), F.struct((F.col("__runs") + F.col("__tail.run")).alias("run"), F.col("__tail.value").alias("value")))
    carry = carry.withColumn("__seen", F.max(tail).over(ahead))
    carry = carry.select(group, RANGE, "__runs", F.when(F.col("__seen.run") == F.col("__runs"), F.col("__seen.value")).alias("__carried"))
    run = Window.partitionBy(group, RANGE, "__local").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    scanned = with_carry(local.withColumn("__own", F.max("__value").over(run)), carry, group)
    before = F.when(F.col("__local") == 0, F.greatest("__own", "__carried")).otherwise(F.col("__own"))
    out = scanned.withColumns({"run_no": F.col("__runs") + F.col("__local"), "before": before})
    return out.drop("__start", "__value", "__local", "__own", "__runs", "__carried")
