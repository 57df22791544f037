"""From crop samples to a crop that is safe for every one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import exprs as X

# Sample positions in half per cents of the duration, and the black limits.
FIRST_POSITION, LAST_POSITION, POSITIONS = 30, 170, 200
SAMPLES = LAST_POSITION - FIRST_POSITION + 1
SDR_LIMIT, HDR_LIMIT = 16, 100

U32 = 2**32 - 1
FILE = ["file_id", "width", "height"]


def sample_plan(probe: DataFrame) -> DataFrame:
    """Where to sample each file: file_id, sample_no (from 0), position, start_secs (two decimals), limit_value."""
    hdr = X.hdr_from_probe(F.col("color_primaries"), F.col("color_transfer"), F.col("color_space"))
    df = probe.withColumn("limit_value", F.when(hdr, HDR_LIMIT).otherwise(SDR_LIMIT))
    df = df.withColumn("i", F.explode(F.sequence(F.lit(FIRST_POSITION), F.lit(LAST_POSITION)))).withColumn("position", F.col("i") / F.lit(float(POSITIONS)))
    return df.select("file_id", (F.col("i") - FIRST_POSITION).alias("sample_no"), "position", X.fixed(F.col("duration_secs") * F.col("position"), 2).alias("start_secs"), "limit_value")


def crops_of_lines(lines: DataFrame) -> DataFrame:
    """The first crop that each detector line names: file_id, sample_no, crop. Lines without one, or with a number too large, go."""
    found = F.regexp_extract("line", r"crop=([0-9]+:[0-9]+:[0-9]+:[0-9]+)", 1)
    df = lines.select("file_id", "sample_no", found.alias("crop"))
    return df.where((F.col("crop") != "") & F.forall(F.split("crop", ":"), lambda p: X.uint(p, U32).isNotNull()))


def sample_modes(frames: DataFrame) -> DataFrame:
    """The most frequent crop of each sample's frames; of equally frequent ones the first in order."""
    votes = frames.groupBy("file_id", "sample_no", "crop").agg(F.count("*").alias("votes"))
    first = Window.partitionBy("file_id", "sample_no").orderBy(F.desc("votes"), "crop")
    return votes.withColumn("n", F.row_number().over(first)).where("n = 1").select("file_id", "sample_no", "crop", "votes")


def _counts(samples: DataFrame) -> DataFrame:
    """One row for each file and crop; samples without a crop don't count."""
    return samples.where("crop <> ''").groupBy(*FILE, "crop").agg(F.count("*").alias("cnt"))


def candidates(samples: DataFrame) -> DataFrame:
    """Every crop of a file, invalid ones included, by falling count: file_id, rank, crop, cnt, pct of the file's samples."""
    file = Window.partitionBy("file_id")
    df = _counts(samples).withColumn("rank", F.row_number().over(file.orderBy(F.desc("cnt"), "crop")))
    share = F.col("cnt") / F.sum("cnt").over(file) * F.lit(100.0)
    return df.select("file_id", "rank", "crop", "cnt", F.round(share, 6).alias("pct"))


def top_candidates(samples: DataFrame, most: int = 10) -> DataFrame:
    """The first candidates, and how many more there are; the remainder stands on the last row shown, also where it is 0."""
    n = F.count("*").over(Window.partitionBy("file_id"))
    df = candidates(samples).withColumn("n", n).where(F.col("rank") <= most)
    return df.select("file_id", "rank", "crop", "cnt", "pct", F.when(F.col("rank") == most, F.greatest(F.col("n") - most, F.lit(0))).alias("remainder"))


def _with_numbers(counts: DataFrame) -> DataFrame:
    """Adds w, h, x, y, the four numbers of each crop; all null if it isn't four numbers. A crop is matched and split once."""
    p = F.when(F.col("crop").rlike(r"\A0*[0-9]{1,10}(:0*[0-9]{1,10}){3}\z"), F.transform(F.split("crop", ":"), lambda x: x.cast("bigint")))
    df = counts.withColumn("p", p)
    return df.withColumns({name: F.when(F.get("p", F.lit(k)) <= U32, F.get("p", F.lit(k))) for k, name in enumerate("whxy")}).drop("p")


def _margins(counts: DataFrame) -> DataFrame:
    """Each file's smallest even margins t, b, l, r over its valid crops (null without one), with its sums.

    A file has at most as many crops as samples, so this is one aggregation on a key the counts are already dealt by.
    """
    width, height = F.col("width").cast("bigint"), F.col("height").cast("bigint")
    df = _with_numbers(counts)
    fits = (F.col("x") <= width) & (F.col("w") <= width - F.col("x")) & (F.col("y") <= height) & (F.col("h") <= height - F.col("y"))
    sides = {"t": F.col("y"), "b": height - F.col("y") - F.col("h"), "l": F.col("x"), "r": width - F.col("x") - F.col("w")}
    least = [F.min(F.when(fits, v - v % 2)).alias(k) for k, v in sides.items()]
    return df.groupBy(*FILE).agg(*least, F.sum("cnt").alias("total"), F.count("*").alias("distinct"))


def margins(samples: DataFrame) -> DataFrame:
    """file_id, t, b, l, r of files with a valid crop."""
    return _margins(_counts(samples)).where("t IS NOT NULL").select("file_id", "t", "b", "l", "r")


def decisions(samples: DataFrame) -> DataFrame:
    """The crop of each file with samples: file_id, crop_filter, required, multiple_ratios, message, total_samples.

    The crop leaves the margins that are black in every valid sample. It isn't usable if it leaves nothing or an odd
    width or height; it isn't required if it is the whole frame, and then several different crops mean several ratios.
    """
    width, height = F.col("width").cast("bigint"), F.col("height").cast("bigint")
    w, h = width - F.col("l") - F.col("r"), height - F.col("t") - F.col("b")
    df = _margins(_counts(samples)).withColumns({"w": w, "h": h})
    usable = F.coalesce((F.col("w") > 0) & (F.col("h") > 0) & (F.col("w") % 2 == 0) & (F.col("h") % 2 == 0), F.lit(False))
    whole = (F.col("w") == width) & (F.col("h") == height)
    df = df.withColumns({"required": usable & ~F.coalesce(whole, F.lit(True)), "multiple_ratios": usable & F.coalesce(whole, F.lit(False)) & (F.col("distinct") > 1)})
    message = F.when(F.col("required"), "Black bars detected").when(F.col("multiple_ratios"), "Multiple aspect ratios detected")
    message = message.otherwise(F.lit(f"Analyzed {SAMPLES} samples"))
    crop = F.when(F.col("required"), F.concat(F.lit("crop="), F.concat_ws(":", "w", "h", "l", "t"))).otherwise("")
    return df.select("file_id", crop.alias("crop_filter"), "required", "multiple_ratios", message.alias("message"), F.col("total").alias("total_samples"))


def decide_all(probe: DataFrame, samples: DataFrame, disabled: bool = False) -> DataFrame:
    """decisions for every probed file: those without samples, and all of them if detection is disabled, keep the whole frame."""
    none = [F.lit("").alias("crop_filter"), F.lit(False).alias("required"), F.lit(False).alias("multiple_ratios")]
    if disabled:
        return probe.select("file_id", *none, F.lit("Skipped").alias("message"), F.lit(0).cast("bigint").alias("total_samples"))
    df = probe.select("file_id").join(decisions(samples), "file_id", "left")
    return df.select(
        "file_id",
        F.coalesce("crop_filter", F.lit("")).alias("crop_filter"),
        F.coalesce("required", F.lit(False)).alias("required"),
        F.coalesce("multiple_ratios", F.lit(False)).alias("multiple_ratios"),
        F.coalesce("message", F.lit(f"Analyzed {SAMPLES} samples")).alias("message"),
        F.coalesce("total_samples", F.lit(SAMPLES)).cast("bigint").alias("total_samples"),
    )


def decide_from_lines(probe: DataFrame, lines: DataFrame, disabled: bool = False) -> DataFrame:
    """The whole way: detector lines to frames' crops, to a crop for each sample, to a decision for each file."""
    voted = sample_modes(crops_of_lines(lines)).join(probe.select("file_id", "width", "height"), "file_id")
    return decide_all(probe, voted, disabled)
