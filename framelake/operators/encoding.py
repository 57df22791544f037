"""Encode plans and the tasks they fall into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import exprs as X
from framelake.sources.tables import materialize

from . import audio as A
from . import config as C
from . import crop as K
from .options import EncodeOptions

# Encoder parameters that every plan has.
KEYINT, SCENE_CHANGE, SCREEN_MODE = "10s", "1", "0"
#: Requests, of one short row each, that are broadcast; among how many parts the files of a request are dealt beyond that.
BROADCAST_REQUESTS, SALTS = 200_000, 32


def encoder_params() -> Column:
    """The encoder's parameter text, keys in their fixed order."""
    flag = lambda c: F.when(F.col(c), "1").otherwise("0")
    pair = lambda k, v: F.concat(F.lit(f"{k}="), v)
    boosted = lambda k, c: F.when(F.col("variance_boost"), pair(k, X.text(F.col(c))))
    return F.concat_ws(
        ":",
        pair("ac-bias", F.col("ac_bias")),
        pair("enable-variance-boost", flag("variance_boost")),
        boosted("variance-boost-strength", "boost_strength"),
        boosted("variance-octile", "boost_octile"),
        pair("tune", X.text(F.col("tune"))),
        F.lit(f"keyint={KEYINT}"),
        F.lit(f"scd={SCENE_CHANGE}"),
        F.lit(f"scm={SCREEN_MODE}"),
        pair("film-grain", X.text(F.col("film_grain"))),
        F.when(F.col("film_grain").isNotNull() & F.col("film_grain_denoise").isNotNull(), pair("film-grain-denoise", flag("film_grain_denoise"))),
    )


def settings_text() -> Column:
    """The settings to show, in order, as key=value joined by commas; those that aren't set are left out."""
    denoise = F.when(F.col("film_grain_denoise"), "1").when(~F.col("film_grain_denoise"), "0").otherwise("-")
    boost = F.when(F.col("variance_boost"), F.concat(F.lit("enabled (strength "), X.text(F.col("boost_strength")), F.lit(", octile "), X.text(F.col("boost_octile")), F.lit(")"))).otherwise("disabled")
    return F.concat_ws(
        ", ",
        F.concat(F.lit("CRF="), X.text(F.col("crf"))),
        F.concat(F.lit("SVT preset="), X.text(F.col("encoder_preset"))),
        F.concat(F.lit("Tune="), X.text(F.col("tune"))),
        F.concat(F.lit("AC bias="), X.fixed(F.col("ac_bias").cast("double"), 2)),
        F.concat(F.lit("Variance boost="), boost),
        F.concat(F.lit("Denoise="), F.nullif(F.col("denoise_filter"), F.lit(""))),
        F.concat(F.lit("Film grain synth=film-grain "), X.text(F.col("film_grain")), F.lit(", denoise "), denoise),
    )


def filter_chain(crop: Column, denoise: Column) -> Column:
    return F.concat_ws(",", F.nullif(crop, F.lit("")), F.nullif(denoise, F.lit("")))


def matrix_choice(is_hdr: Column, source: Column) -> Column:
    return F.when(is_hdr, F.coalesce(F.nullif(source, F.lit("")), F.lit("bt2020nc"))).otherwise("bt709")


# What every plan encodes with.
ENCODER, VIDEO_CODEC, PIXEL_FORMAT, AUDIO_CODEC = "SVT-AV1", "libsvtav1", "yuv420p10le", "Opus"

PLAN = ["file_id", "category", "resolution", "duration", "crf", "is_hdr", "matrix", "crop_filter", "filter_chain", "svt_params", "settings", "audio_config", "out_width", "out_height"]


def described(probe: DataFrame, tracks: DataFrame, crops: DataFrame, audio: DataFrame, options: EncodeOptions = EncodeOptions(), settings: DataFrame | None = None) -> DataFrame:
    """The plan of each file, with what else is said of it: the preset's label, encoder_preset, tune, dynamic_range, the
    basic and results descriptions of the audio, the number of streams, and what crop detection found.

    All joins are on file_id, as are the aggregations below them. options: the settings of all files, unless there are
    `settings`; and whether crops are detected.
    """
    hdr = X.hdr_from_track(F.col("colour_primaries"), F.col("transfer_characteristics"), F.col("matrix_coefficients"))
    facts = tracks.select("file_id", hdr.alias("is_hdr"), F.col("matrix_coefficients").alias("source_matrix"))
    sounds = A.ordered_channels(audio)
    found = K.decide_all(probe, crops, disabled=not options.crop).select("file_id", "crop_filter", F.col("required").alias("crop_required"), F.col("message").alias("crop_message"), "total_samples")
    df = probe.select("file_id", "width", "height", "duration_secs").join(facts, "file_id").join(found, "file_id").join(sounds, "file_id", "left")
    if settings is None:
        kinds = dict(c.split() for c in C.PRESET_COLUMNS.split(", ")) | {"film_grain": "int", "film_grain_denoise": "boolean"}
        chosen = options.resolved(probe.sparkSession)
        df = df.withColumns({k: F.lit(chosen[k]).cast(t) for k, t in kinds.items()} | {"denoise_filter": F.lit("")})
    else:
        df = df.join(settings, "file_id")
    df = df.withColumn("ch", F.coalesce("ch", F.array().cast("array<bigint>")))
    df = df.withColumn("crf", F.when(F.col("width") >= X.UHD_WIDTH, F.col("crf_uhd")).when(F.col("width") >= X.HD_WIDTH, F.col("crf_hd")).otherwise(F.col("crf_sd")))
    w, h = X.output_dims(F.col("width"), F.col("height"), F.col("crop_filter"))
    return df.select(
        "file_id",
        X.band(F.col("width")).alias("category"),
        F.concat_ws("x", "width", "height").alias("resolution"),
        X.duration_text(F.col("duration_secs")).alias("duration"),
        "crf",
        "is_hdr",
        matrix_choice(F.col("is_hdr"), F.col("source_matrix")).alias("matrix"),
        "crop_filter",
        filter_chain(F.col("crop_filter"), F.col("denoise_filter")).alias("filter_chain"),
        encoder_params().alias("svt_params"),
        settings_text().alias("settings"),
        A.config_text(F.col("ch")).alias("audio_config"),
        w.alias("out_width"),
        h.alias("out_height"),
        X.preset_label(F.col("preset")).alias("preset_label"),
        "encoder_preset",
        "tune",
        X.dynamic_range(F.col("is_hdr")).alias("dynamic_range"),
        A.basic_text(F.col("ch")).alias("audio_description"),
        A.results_text(F.col("ch")).alias("audio_results"),
        F.size("ch").alias("n_streams"),
        "crop_required",
        "crop_message",
        "total_samples",
        F.lit(not options.crop).alias("crop_disabled"),
    )


def plan(probe: DataFrame, tracks: DataFrame, crops: DataFrame, audio: DataFrame, options: EncodeOptions = EncodeOptions(), settings: DataFrame | None = None) -> DataFrame:
    """One row for each file whose tracks can be read: what it is and how to encode it.

    settings: a row of file_settings for each file that is to be planned; without it all files have those of the options.
    """
    return described(probe, tracks, crops, audio, options, settings).select(*PLAN)


def file_settings(files: DataFrame, requests: DataFrame, tuning: DataFrame) -> DataFrame:
    """The settings of each file of (file_id, request_id) whose request is sound; files of others have no row.

    One request may have much of the catalogue: up to BROADCAST_REQUESTS requests go whole to every executor, so that files
    stay where they are; more are joined by request and salt. tuning: request_id, variance_boost, boost_strength, boost_octile, denoise_filter, which win over the preset where given.
    """
    boost = ["variance_boost", "boost_strength", "boost_octile"]
    base = C.presets(requests.sparkSession).select("preset", *[F.col(c).alias(f"p_{c}") for c in boost])
    asked = C.resolved(requests.repartition("request_id")).join(F.broadcast(base), "preset").join(tuning, "request_id", "left")
    asked = asked.select("request_id", "preset", "crf_sd", "crf_hd", "crf_uhd", "encoder_preset", "tune", "ac_bias", "film_grain", "film_grain_denoise", *[F.coalesce(c, f"p_{c}").alias(c) for c in boost], F.coalesce("denoise_filter", F.lit("")).alias("denoise_filter"))
    asked = materialize(asked, "requests")
    if asked.count() <= BROADCAST_REQUESTS:
        return files.join(F.broadcast(asked), "request_id").drop("request_id")
    salt = F.pmod(F.xxhash64("file_id"), F.lit(SALTS)).cast("int")
    salted = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return files.withColumn("salt", salt).join(salted, ["request_id", "salt"]).drop("request_id", "salt")


def tasks(plans: DataFrame, streams: DataFrame) -> DataFrame:
    """The tasks of each plan: the video, each audio stream, and the mux of them, which waits for all the others.

    Plans and streams are read once: each plan's tasks are made as one list.
    """
    none = F.lit(None)

    def task(no: Column, kind: str, index: Column, kbps: Column, disposition: Column, after: Column) -> Column:
        parts = {"task_no": no.cast("int"), "kind": F.lit(kind), "audio_index": index.cast("int"), "bitrate_kbps": kbps.cast("bigint"), "disposition": disposition.cast("string"), "depends_on": after}
        return F.struct(*[v.alias(k) for k, v in parts.items()])

    heard = streams.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("audio_index", "bitrate_kbps", "disposition"))).alias("s"))
    df = plans.select("file_id").join(heard, "file_id", "left")
    df = df.withColumn("s", F.coalesce("s", F.array().cast(dict(df.dtypes)["s"])))
    n = F.size("s")
    sound = F.transform("s", lambda x: task(x["audio_index"] + 1, "audio", x["audio_index"], x["bitrate_kbps"], x["disposition"], F.lit("")))
    waits = F.array_join(F.transform(F.sequence(F.lit(0), n), X.text), ",")
    each = F.concat(F.array(task(F.lit(0), "video", none, none, none, F.lit(""))), sound, F.array(task(n + 1, "mux", none, none, none, waits)))
    return df.select("file_id", F.explode(each).alias("t")).select("file_id", "t.*")
