"""Audio streams of files, in their order, and the texts that describe them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import exprs as X

ORDER = ["ord1", "ord2", "ord3", "ord4"]


def streams(audio: DataFrame) -> DataFrame:
    """Streams with channels, numbered from 0 in each file: file_id, audio_index, channels, codec_name, duration_secs, bitrate_kbps, disposition."""
    index = F.row_number().over(Window.partitionBy("file_id").orderBy(*ORDER)) - 1
    flags = {c[2:]: F.col(c) for c in audio.columns if c.startswith("d_")}
    return audio.where("channels > 0").select(
        "file_id", index.alias("audio_index"), "channels", "codec_name", "duration_secs", X.audio_kbps(F.col("channels")).alias("bitrate_kbps"), X.disposition_text(flags).alias("disposition")
    )


def ordered(audio: DataFrame) -> DataFrame:
    """(file_id, s): the streams with channels of each file as one array, in order."""
    kept = audio.where("channels > 0").groupBy("file_id")
    return kept.agg(F.sort_array(F.collect_list(F.struct(*ORDER, "channels", F.lower("codec_name").alias("codec"), "duration_secs"))).alias("s"))


def ordered_channels(audio: DataFrame) -> DataFrame:
    """(file_id, ch): only the channels of `ordered`; nothing else of a stream is dealt or collected."""
    kept = audio.where("channels > 0").groupBy("file_id")
    return kept.agg(F.sort_array(F.collect_list(F.struct(*ORDER, "channels"))).alias("s")).select("file_id", F.col("s.channels").alias("ch"))


def channel_lists(audio: DataFrame) -> DataFrame:
    """file_id, channels_text: the channels of each file's streams, empty for files whose streams have none."""
    return _with_channels(audio).select("file_id", F.array_join(F.transform("ch", X.text), ",").alias("channels_text"))


def basic_text(channels: Column) -> Column:
    """No audio, the channels of one stream, or a list of numbered streams."""
    many = F.array_join(F.transform(channels, lambda c, i: F.format_string("Stream %d (%dch)", i, c)), ", ")
    n = F.size(channels)
    return F.when(n == 0, "No audio").when(n == 1, F.format_string("%d channels", F.get(channels, F.lit(0)))).otherwise(F.concat(X.text(n), F.lit(" streams: "), many))


def config_text(channels: Column) -> Column:
    many = F.array_join(F.transform(channels, lambda c, i: F.format_string("Stream %d: %dch [%dkbps Opus]", i, c, X.audio_kbps(c))), ", ")
    only = F.get(channels, F.lit(0))
    n = F.size(channels)
    return F.when(n == 0, "No audio").when(n == 1, F.format_string("%d channels @ %dkbps Opus", only, X.audio_kbps(only))).otherwise(many)


def results_text(channels: Column) -> Column:
    many = F.array_join(F.transform(channels, lambda c: F.format_string("%dch@%dk", c, X.audio_kbps(c))), ", ")
    only = F.get(channels, F.lit(0))
    n = F.size(channels)
    return F.when(n == 0, "No audio").when(n == 1, F.format_string("Opus %dch @ %dkbps", only, X.audio_kbps(only))).otherwise(F.concat(F.lit("Opus ("), many, F.lit(")")))


def _with_channels(audio: DataFrame) -> DataFrame:
    """file_id, ch: the channels of each file's streams that have some, in order. One pass: streams without stand as null, which is not collected."""
    stream = F.when(F.col("channels") > 0, F.struct(*ORDER, F.col("channels").cast("bigint").alias("channels")))
    files = audio.groupBy("file_id").agg(F.array_sort(F.collect_list(stream)).alias("s"))
    return files.select("file_id", F.transform("s", lambda x: x["channels"]).alias("ch"))


def descriptions(audio: DataFrame) -> DataFrame:
    """file_id and its three descriptions: basic, for the config display, for the results."""
    return _with_channels(audio).select("file_id", basic_text(F.col("ch")).alias("basic"), config_text(F.col("ch")).alias("config"), results_text(F.col("ch")).alias("results"))


def duration_checks(s: Column, expected: Column) -> tuple[Column, Column]:
    """Whether streams are as long as the video, and what to say of it. Streams of unknown duration don't count."""
    numbered = F.transform(s, lambda x, i: F.struct(i.alias("i"), x["duration_secs"].alias("d")))
    checked = F.filter(numbered, lambda x: x["d"] > 0)
    off = F.get(F.filter(checked, lambda x: F.abs(x["d"] - expected) > X.AUDIO_TOLERANCE_SECS), F.lit(0))
    n = F.size(checked)
    wrong = F.concat(
        F.lit("Audio stream "), X.text(off["i"]), F.lit(" duration mismatch: got "), X.fixed(off["d"], 1), F.lit("s, expected "), X.fixed(expected, 1), F.lit("s (diff: "), X.fixed(F.abs(off["d"] - expected), 1), F.lit("s)")
    )
    right = F.when(n == 0, "Audio duration unavailable - validation skipped").when(n == 1, "Audio duration matches video").otherwise(F.concat(X.text(n), F.lit(" audio stream durations match video")))
    skipped = expected.isNull()
    return skipped | off.isNull(), F.when(skipped, "Audio duration validation skipped").when(off.isNull(), right).otherwise(wrong)


def track_checks(s: Column, expected: Column) -> tuple[Column, Column, Column]:
    """Whether all streams are Opus, whether there are as many as expected, and what to say of it."""
    codecs = s["codec"]
    opus = F.forall(codecs, lambda c: c == "opus")
    n = F.size(codecs)
    one = F.when(opus, "Audio track is Opus").otherwise(F.concat(F.lit("Audio track is "), F.get(codecs, F.lit(0)), F.lit(" (expected Opus)")))
    many = F.when(opus, F.concat(X.text(n), F.lit(" audio tracks, all Opus"))).otherwise(F.concat(X.text(n), F.lit(" audio tracks: "), F.array_join(codecs, ", ")))
    return opus, expected.isNull() | (n == expected), F.when(n == 0, "No audio tracks").when(n == 1, one).otherwise(many)
