"""What encodes and batches came to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from framelake.functions import exprs as X

from framelake.sources.tables import write_table

from .numbering import numbered


def encode_results(inputs: DataFrame, outputs: DataFrame, checked: DataFrame) -> DataFrame:
    """file_id, input_size, output_size (0 if unknown), reduction_pct, speed, video_ms, elapsed_ms, is_valid of encoded files.

    inputs: file_id, input_size, duration_secs. outputs: file_id, output_size, elapsed_secs. checked: file_id, is_valid.
    """
    df = inputs.join(outputs, "file_id").join(checked.select("file_id", "is_valid"), "file_id")
    before, after = F.coalesce("input_size", F.lit(0)), F.coalesce("output_size", F.lit(0))
    ms = lambda c: F.round(F.col(c) * F.lit(1000.0)).cast("bigint")
    return df.select(
        "file_id", before.alias("input_size"), after.alias("output_size"), X.size_reduction(before, after).alias("reduction_pct"), X.speed(F.col("duration_secs"), F.col("elapsed_secs")).alias("speed"),
        ms("duration_secs").alias("video_ms"), ms("elapsed_secs").alias("elapsed_ms"), "is_valid",
    )


def status(existing: Column, failed: Column, encoded: Column) -> Column:
    """An output that exists is a reason to skip a file before it is even probed, so it wins over a broken input."""
    return F.when(existing, "skipped").when(failed, "analysis_error").when(encoded, "encoded").otherwise("pending")


def summary(results: DataFrame, files: DataFrame) -> DataFrame:
    """A row for each batch of files: batch, successful, total_files (skipped and failed ones too), sums, average speed, passed, failed.

    Durations are summed as whole milliseconds, so the order of rows doesn't matter. results and files have a column batch.
    """
    totals = files.groupBy("batch").agg(F.count("*").alias("total_files"))
    sums = results.groupBy("batch").agg(
        F.count("*").alias("successful"), F.sum("input_size").alias("input_bytes"), F.sum("output_size").alias("output_bytes"), F.sum("elapsed_ms").alias("elapsed_ms"), F.sum("video_ms").alias("video_ms"), F.count_if("is_valid").alias("passed")
    )
    df = totals.join(sums, "batch", "left").na.fill(0)
    return df.withColumns({"avg_speed": F.when(F.col("elapsed_ms") > 0, F.col("video_ms") / F.col("elapsed_ms")).otherwise(F.lit(0.0)), "failed": F.col("successful") - F.col("passed")})


def batch_result(summarised: DataFrame) -> DataFrame:
    """batch, successful, total_files, input_bytes, output_bytes, reduction_pct, passed."""
    return summarised.select("batch", "successful", "total_files", "input_bytes", "output_bytes", X.size_reduction(F.col("input_bytes"), F.col("output_bytes")).alias("reduction_pct"), "passed")


def with_only(summarised: DataFrame, results: DataFrame) -> DataFrame:
    """Adds only_name, the least file name of each batch's results."""
    return summarised.join(results.groupBy("batch").agg(F.min("filename").alias("only_name")), "batch", "left")


def outcome(summarised: DataFrame, results: DataFrame) -> DataFrame:
    """batch, kind, message: a warning without results, the file's name for one, a batch summary for more."""
    n = F.col("successful")
    kind = F.when(n == 0, "warning").when(n == 1, "operation_complete").otherwise("batch_complete")
    message = F.when(n == 0, "No files were successfully encoded").when(n == 1, F.concat(F.lit("Successfully encoded "), F.col("only_name"))).otherwise(F.concat(X.text(n), F.lit(" of "), X.text(F.col("total_files")), F.lit(" succeeded")))
    return with_only(summarised, results).select("batch", kind.alias("kind"), message.alias("message"))


def file_reductions(results: DataFrame) -> DataFrame:
    """Each batch's files in their order with what each saved: batch, position, filename, reduction_pct."""
    return numbered(results.select("batch", "file_id", "filename", "reduction_pct"), "batch", ["file_id"]).select("batch", "position", "filename", "reduction_pct")


LEVELS = [["category", "dynamic_range", "preset"], ["category", "dynamic_range"], ["category", "preset"], ["category"], ["dynamic_range"], ["preset"], []]


def rollup(results: DataFrame) -> DataFrame:
    """Results (with category, dynamic_range and preset) summed at each of LEVELS in one pass: level (the grouping id: a bit
    for each column that is summed over, category's the highest), the columns (null where summed over), files, passed,
    input_bytes, output_bytes, reduction_pct, avg_speed. No results, no rows."""
    sets = results.groupingSets([[F.col(c) for c in level] for level in LEVELS], *map(F.col, LEVELS[0]))
    df = sets.agg(
        F.grouping_id().alias("level"), F.count("*").alias("files"), F.count_if("is_valid").alias("passed"), F.sum("input_size").alias("input_bytes"), F.sum("output_size").alias("output_bytes"), F.sum("elapsed_ms").alias("elapsed_ms"), F.sum("video_ms").alias("video_ms")
    )
    speed = F.when(F.col("elapsed_ms") > 0, F.col("video_ms") / F.col("elapsed_ms")).otherwise(F.lit(0.0))
    return df.select("level", *LEVELS[0], "files", "passed", "input_bytes", "output_bytes", X.size_reduction(F.col("input_bytes"), F.col("output_bytes")).alias("reduction_pct"), F.coalesce(speed, F.lit(0.0)).alias("avg_speed"))


def write_results(results: DataFrame, root: str, name: str = "encode_results") -> dict[str, int]:
    """Write results as a table (tables.write_table) and return their sums, counted while they are written: successful,
    input_bytes, output_bytes, elapsed_ms, video_ms, passed. Nothing is read again."""
    seen = Observation()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias
    counted = results.observe(
        seen, F.count(F.lit(1)).alias("successful"), total("input_size")("input_bytes"), total("output_size")("output_bytes"), total("elapsed_ms")("elapsed_ms"), total("video_ms")("video_ms"), F.count_if("is_valid").alias("passed")
    )
    write_table(counted, root, name)
    return dict(seen.get)
