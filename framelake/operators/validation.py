"""Whether outputs are what was expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import exprs as X
from framelake.sources.tables import computed_once

from . import audio as A

STEPS = ["Video codec", "Bit depth", "Crop detection", "Video duration", "HDR/SDR status", "Audio tracks", "Audio durations", "Audio/video sync"]


def _join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def hdr_check(expected: Column, actual: Column, readable: Column, available: Column) -> tuple[Column, Column]:
    """Without a detector all is well; an output that can't be read is not; without an expectation any range is."""
    e, a = X.dynamic_range(expected), X.dynamic_range(actual)
    same = expected == actual
    ok = F.when(expected.isNull() | ~available, F.lit(True)).when(~readable, F.lit(False)).otherwise(same)
    told = F.when(available & readable, _join("Output is ", a)).otherwise("")
    message = (
        F.when(expected.isNull(), told).when(~available, "HDR detection not available - validation skipped").when(~readable, "Failed to detect HDR status")
        .when(same, _join(a, " preserved")).otherwise(_join("Expected ", e, ", found ", a))
    )
    return ok, message


def check(expected: DataFrame, actual: DataFrame, streams: DataFrame, hdr_available: bool = True) -> DataFrame:
    """Every expected output against what was found of it: flags, is_valid, and `steps`, an array of (name, passed, details).

    expected: file_id, width, height, duration_secs, hdr, tracks, any of them null where nothing is expected.
    actual: file_id, width, height, duration_secs, codec (null if unreadable), bit_depth, track_depth, hdr (null if unreadable).
    streams: file_id and s, the output's audio streams in order; null s if they can't be read, no row for none at all.
    An output without a row could not be probed: it has the one failed step Validation.
    """
    e = expected.select("file_id", *[F.col(c).alias(f"e_{c}") for c in ("width", "height", "duration_secs", "hdr", "tracks")])
    a = actual.select("file_id", F.lit(True).alias("probed"), *[F.col(c).alias(f"a_{c}") for c in ("width", "height", "duration_secs", "codec", "bit_depth", "track_depth", "hdr")])
    df = e.join(a, "file_id", "left").join(streams.withColumn("listed", F.lit(True)), "file_id", "left")
    c = F.col
    df = df.withColumn("s", F.when(c("listed").isNull(), F.array().cast(dict(streams.dtypes)["s"])).otherwise(c("s")))

    codec = F.coalesce(c("a_codec"), F.lit(""))
    is_av1 = F.lower(codec).contains("av1") | F.lower(codec).contains("av01")
    codec_text = F.when(is_av1, _join("AV1 (", codec, ")")).when(codec != "", _join("Expected AV1, got ", codec)).otherwise("Unknown codec")
    depth = F.coalesce(c("a_bit_depth"), c("a_track_depth"), F.lit(X.REQUIRED_DEPTH))

    size = lambda w, h: _join(X.text(w), "x", X.text(h))
    sized = c("e_width").isNotNull() & c("e_height").isNotNull()
    same_size = (c("a_width") == c("e_width")) & (c("a_height") == c("e_height"))
    got, want = size(c("a_width"), c("a_height")), size(c("e_width"), c("e_height"))
    crop_text = F.when(~sized, "No crop validation required").when(same_size, _join("Dimensions match: ", got)).otherwise(_join("Dimension mismatch: got ", got, ", expected ", want))

    timed = c("e_duration_secs").isNotNull()
    off = F.abs(c("a_duration_secs") - c("e_duration_secs"))
    long = off <= X.DURATION_TOLERANCE_SECS
    d = lambda x: X.fixed(x, 1)
    duration_text = (
        F.when(~timed, "Duration validation skipped").when(long, _join("Duration matches input (", d(c("a_duration_secs")), "s)"))
        .otherwise(_join("Duration mismatch: got ", d(c("a_duration_secs")), "s, expected ", d(c("e_duration_secs")), "s (diff: ", d(off), "s)"))
    )
    drift = off * F.lit(1000.0)
    in_sync = drift <= X.MAX_DRIFT_MS
    sync_text = (
        F.when(~timed, "Sync validation skipped").when(in_sync, _join("Audio/video sync preserved (drift: ", d(drift), "ms)"))
        .otherwise(_join("Audio/video sync drift too large: ", d(drift), "ms (max: ", d(F.lit(X.MAX_DRIFT_MS)), "ms)"))
    )

    hdr_ok, hdr_text = hdr_check(c("e_hdr"), c("a_hdr"), c("a_hdr").isNotNull(), F.lit(hdr_available))
    opus, tracks, track_text = A.track_checks(c("s"), c("e_tracks"))
    audio_long, audio_text = A.duration_checks(c("s"), c("e_duration_secs"))
    unread = c("s").isNull()
    df = df.select(
        "file_id", F.coalesce("probed", F.lit(False)).alias("probed"),
        is_av1.alias("is_av1"), (depth >= X.REQUIRED_DEPTH).alias("is_10_bit"), (~sized | same_size).alias("is_crop_correct"), (~timed | long).alias("is_duration_correct"), hdr_ok.alias("is_hdr_correct"),
        (unread | opus).alias("is_audio_opus"), (unread | tracks).alias("is_track_count_correct"), (unread | audio_long).alias("is_audio_duration_correct"), (~timed | in_sync).alias("is_sync_preserved"),
        codec_text.alias("t1"), X.depth_label(depth).alias("t2"), crop_text.alias("t3"), duration_text.alias("t4"), hdr_text.alias("t5"),
        F.when(unread, "Failed to get audio info").otherwise(track_text).alias("t6"), F.when(unread, "Audio duration validation skipped").otherwise(audio_text).alias("t7"), sync_text.alias("t8"),
    )
    flags = ["is_av1", "is_10_bit", "is_crop_correct", "is_duration_correct", "is_hdr_correct", "is_audio_opus", "is_track_count_correct", "is_audio_duration_correct", "is_sync_preserved"]
    df = df.select("file_id", "probed", *[F.when(c("probed"), c(f)).otherwise(F.lit(False)).alias(f) for f in flags], *[f"t{k}" for k in range(1, 9)])
    valid = c(flags[0])
    for f in flags[1:]:
        valid = valid & c(f)
    passed = [c(f) for f in flags[:5]] + [c("is_audio_opus") & c("is_track_count_correct"), c("is_audio_duration_correct"), c("is_sync_preserved")]
    step = lambda name, ok, details: F.struct(F.lit(name).alias("name"), ok.alias("passed"), details.alias("details"))
    steps = F.when(c("probed"), F.array(*[step(n, p, c(f"t{k + 1}")) for k, (n, p) in enumerate(zip(STEPS, passed))]))
    steps = steps.otherwise(F.array(step("Validation", F.lit(False), F.lit("failed to get output video properties"))))
    return df.select("file_id", *flags, valid.alias("is_valid"), steps.alias("steps"))


def wide(checked: DataFrame) -> DataFrame:
    return checked.drop("steps")


def steps(checked: DataFrame) -> DataFrame:
    """file_id, step_no (from 1), name, passed, details."""
    df = checked.select("file_id", F.posexplode("steps").alias("pos", "step"))
    return df.select("file_id", (F.col("pos") + 1).alias("step_no"), "step.name", "step.passed", "step.details")


def failures(checked: DataFrame) -> DataFrame:
    """file_id, failures: name: details of each failed step, in order; files without one don't appear."""
    failed = F.filter("steps", lambda s: ~s["passed"])
    lines = F.array_join(F.transform("failed", lambda s: F.concat(s["name"], F.lit(": "), s["details"])), "; ")
    df = computed_once(checked.select("file_id", failed.alias("failed")), "n", F.size("failed"))
    return df.where("n > 0").select("file_id", lines.alias("failures"))
