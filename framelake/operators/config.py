"""Encode settings: presets, requests that override them, and their audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import exprs as X
from framelake.sources.tables import computed_once

#: Preset, CRF for SD, HD and UHD, encoder preset, tune, AC bias, variance boost, its strength and octile.
PRESETS = [
    ("grain", 24, 26, 26, 6, 0, "0.1", False, 0, 0),
    ("clean", 27, 29, 29, 6, 0, "0.05", False, 0, 0),
    ("quick", 32, 35, 36, 8, 0, "0.1", False, 0, 0),
]
PRESET_COLUMNS = "preset string, crf_sd int, crf_hd int, crf_uhd int, encoder_preset int, tune int, ac_bias string, variance_boost boolean, boost_strength int, boost_octile int"
MAX_CRF, MAX_ENCODER_PRESET = 63, 13
#: Width bands, from including, to excluding.
BANDS = [("SD", 0, 1920), ("HD", 1920, 3840), ("UHD", 3840, 2**31 - 1)]


def presets(spark: SparkSession) -> DataFrame:
    return values_table(spark, PRESETS, PRESET_COLUMNS)


def values_table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A small table of fixed values as an inline table of the plan."""
    names, kinds = zip(*(c.split() for c in columns.split(", ")))
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else str(v)
    listed = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)
    return spark.sql(f"SELECT {', '.join(f'CAST({n} AS {k}) AS {n}' for n, k in zip(names, kinds))} FROM VALUES {listed} AS t({', '.join(names)})")


def band_table(spark: SparkSession, preset: str = "grain") -> DataFrame:
    """The CRF of each width band under a preset."""
    values = next((p for p in PRESETS if p[0] == preset), PRESETS[0])
    rows = [(name, low, high, crf) for (name, low, high), crf in zip(BANDS, values[1:4])]
    return values_table(spark, rows, "category string, low int, high int, crf int")


def crf_by_band(probe: DataFrame, bands: DataFrame) -> DataFrame:
    """Range join of widths with the bands, a table of three rows: file_id, width, category, crf."""
    return probe.join(F.broadcast(bands), (F.col("width") >= F.col("low")) & (F.col("width") < F.col("high"))).select("file_id", "width", "category", "crf")


def parse_crf(spec: Column) -> Column:
    """One value for all bands, or three for SD, HD and UHD, as a struct; null if the text is neither."""
    whole = X.trimmed(spec)
    p = F.split(whole, ",", -1)
    v = F.transform(p, lambda x: X.uint(X.trimmed(x), MAX_CRF).cast("int"))
    at = lambda k: F.get(v, F.lit(k))
    triple = lambda *k: F.struct(*[at(i).alias(n) for i, n in zip(k, ("sd", "hd", "uhd"))])
    good = (whole != "") & F.forall(v, lambda x: x.isNotNull())
    return F.when(good & (F.size(p) == 1), triple(0, 0, 0)).when(good & (F.size(p) == 3), triple(0, 1, 2))


def parse_requests(requests: DataFrame) -> DataFrame:
    """request_id, sd, hd, uhd, ok; no spec at all is not ok either."""
    df = requests.select("request_id", parse_crf(F.col("crf_spec")).alias("v"))
    return df.select("request_id", "v.sd", "v.hd", "v.uhd", F.col("v").isNotNull().alias("ok"))


def effective(requests: DataFrame, keep_defaults: bool = False) -> DataFrame:
    """What each request asks for once all is applied: defaults, preset, CRF, encoder preset, in that order.

    No preset leaves the defaults, which are those of grain; an unknown one is an error. A bad CRF is an error too, or,
    with keep_defaults, leaves the preset's. `error` is the first rule that fails, null if none does.
    """
    spark = requests.sparkSession
    named = F.lower(F.coalesce("preset_name", F.lit("grain")))
    p = presets(spark).select(*[F.col(c).alias("encoder_default" if c == "encoder_preset" else c) for c in presets(spark).columns])
    df = requests.withColumn("asked", named).join(F.broadcast(p), F.col("asked") == F.col("preset"), "left").withColumn("v", parse_crf(F.col("crf_spec")))
    df = df.select(
        "request_id",
        "preset",
        F.coalesce("v.sd", "crf_sd").alias("crf_sd"),
        F.coalesce("v.hd", "crf_hd").alias("crf_hd"),
        F.coalesce("v.uhd", "crf_uhd").alias("crf_uhd"),
        F.coalesce("encoder_preset", "encoder_default").alias("encoder_preset"),
        "tune",
        "ac_bias",
        "film_grain",
        "film_grain_denoise",
        (F.col("crf_spec").isNotNull() & F.col("v").isNull() & F.lit(not keep_defaults)).alias("bad_crf"),
    )
    return computed_once(df, "error", check(df)).drop("bad_crf")


def check(df: DataFrame) -> Column:
    """The first rule that fails."""
    crf = lambda c: ~F.col(c).between(0, MAX_CRF)
    return (
        F.when(F.col("preset").isNull(), "unknown_preset").when(F.col("bad_crf"), "bad_crf_spec").when(~F.col("encoder_preset").between(0, MAX_ENCODER_PRESET), "encoder_preset_range")
        .when(crf("crf_sd"), "crf_sd_range").when(crf("crf_hd"), "crf_hd_range").when(crf("crf_uhd"), "crf_uhd_range")
        .when(F.col("film_grain").isNull() & F.col("film_grain_denoise").isNotNull(), "denoise_without_grain")
    )


def resolved(requests: DataFrame) -> DataFrame:
    return effective(requests).where("error IS NULL").drop("error")


def audit(requests: DataFrame) -> DataFrame:
    """request_id, error_code of every request; ok where no rule fails."""
    return effective(requests).select("request_id", F.coalesce("error", F.lit("ok")).alias("error_code"))
