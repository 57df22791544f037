"""Scalar rules of the media catalogue as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of video files.
VIDEO_EXTENSIONS = "mkv wmv ts avi mp4 m4v mpg mpeg mov webm flv m2ts ogv vob".split()
#: Flags of a stream's disposition, in their order.
DISPOSITIONS = "default dub original comment lyrics karaoke forced hearing_impaired visual_impaired clean_effects attached_pic timed_thumbnails".split()

# Limits of the validation rules.
REQUIRED_DEPTH = 10
DURATION_TOLERANCE_SECS = 1.0
AUDIO_TOLERANCE_SECS = 5.0
MAX_DRIFT_MS = 100.0

# Width bands.
UHD_WIDTH, HD_WIDTH = 3840, 1920


def fixed(x: Column, digits: int) -> Column:
    """x with so many decimals, rounded half to even on its exact binary value, as printf does."""
    return F.call_function("format_number", x.cast("double"), F.lit("0." + "0" * digits if digits else "0"))


def text(x: Column) -> Column:
    return x.cast("string")


def uint(c: Column, most: int) -> Column:
    """Decimal digits as an integer up to `most`; null for anything else, signs and blanks included."""
    n = F.when(c.rlike(r"\A0*[0-9]{1,10}\z"), c.try_cast("bigint"))
    return F.when(n <= most, n)


def number(c: Column) -> Column:
    """A decimal number as text to a double; null if it isn't one."""
    return F.when(c.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), c.try_cast("double"))


def trimmed(c: Column) -> Column:
    """c without white space at its ends, tabs and newlines included."""
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def has_any(c: Column, parts: list[str]) -> Column:
    """Whether c holds one of the parts, whatever their case; false for null."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for p in parts:
        out = out | low.contains(p.lower())
    return out


def hdr_from_probe(primaries: Column, transfer: Column, matrix: Column) -> Column:
    """HDR by the prober's vocabulary, which the crop threshold follows."""
    return has_any(primaries, ["bt2020", "bt.2020", "bt2100"]) | has_any(transfer, ["pq", "smpte2084", "hlg", "arib-std-b67"]) | has_any(matrix, ["bt2020", "bt.2020"])


def hdr_from_track(primaries: Column, transfer: Column, matrix: Column) -> Column:
    """HDR by the track reader's vocabulary, which plan and validation follow."""
    return has_any(primaries, ["BT.2020", "BT.2100"]) | has_any(transfer, ["PQ", "HLG", "SMPTE 2084"]) | has_any(matrix, ["BT.2020"])


def dynamic_range(is_hdr: Column) -> Column:
    return F.when(is_hdr, F.lit("HDR")).otherwise(F.lit("SDR"))


def band(width: Column) -> Column:
    return F.when(width >= UHD_WIDTH, "UHD").when(width >= HD_WIDTH, "HD").otherwise("SD")


def depth_label(depth: Column) -> Column:
    return F.when(depth.isin(8, 10, 12), F.concat(text(depth), F.lit("-bit"))).otherwise("")


def preset_label(preset: Column) -> Column:
    return F.when(preset.isin("grain", "clean", "quick"), F.initcap(preset)).otherwise("Default")


def bytes_text(n: Column) -> Column:
    """B, KiB, MiB or GiB, with two decimals from KiB on."""
    out = F.concat(text(n), F.lit(" B"))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB")):
        out = F.when(n >= 1024**power, F.concat(fixed(n / F.lit(float(1024**power)), 2), F.lit(f" {unit}"))).otherwise(out)
    return out


def bytes_readable(n: Column) -> Column:
    return F.concat(fixed(n / F.lit(1048576.0), 2), F.lit(" MB ("), fixed(n / F.lit(1073741824.0), 2), F.lit(" GB)"))


def clock_text(whole_secs: Column) -> Column:
    """HH:MM:SS of whole seconds; hours may exceed 99, and parts of a negative number are negative each."""
    s = whole_secs.cast("bigint")
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("bigint"), ((s % 3600) / 60).cast("bigint"), s % 60)


def duration_text(secs: Column) -> Column:
    """clock_text of truncated seconds; question marks for negative and missing numbers."""
    return F.when((secs < 0) | F.isnan(secs), "??:??:??").otherwise(clock_text(secs.cast("bigint")))


def clock_secs(c: Column) -> Column:
    """Hours, minutes and seconds as three numbers between colons to seconds, else null."""
    return clock_parts_secs(F.split(c, ":", -1))


def clock_parts_secs(p: Column) -> Column:
    """clock_secs of a text that has been split at its colons."""
    return F.when(F.size(p) == 3, number(p[0]) * 3600 + number(p[1]) * 60 + number(p[2]))


def stream_secs(duration: Column, tags: Column) -> Column:
    """A stream's duration: of its own field, tag DURATION and tag duration the first that is a number above 0 or a clock; else 0."""

    def usable(c: Column) -> Column:
        n = number(c)
        p = F.split(c, ":", -1)
        whole = lambda x: F.when(x.rlike(r"\A[+-]?[0-9]{1,9}\z"), x.try_cast("bigint"))
        clock = F.when(F.size(p) == 3, whole(p[0]) * 3600 + whole(p[1]) * 60 + number(p[2]))
        return F.when(n > 0, n).otherwise(F.when(n.isNull() & (clock > 0), clock))

    return F.coalesce(usable(duration), usable(F.try_element_at(tags, F.lit("DURATION"))), usable(F.try_element_at(tags, F.lit("duration"))), F.lit(0.0))


def size_reduction(before: Column, after: Column) -> Column:
    """Per cent saved; negative if the file grew; 0 if there was none."""
    return F.when(before == 0, F.lit(0.0)).otherwise((before - after) / before * F.lit(100.0))


def speed(video_secs: Column, elapsed_secs: Column) -> Column:
    return F.when(elapsed_secs > 0, video_secs / elapsed_secs).otherwise(F.lit(0.0))


def audio_kbps(channels: Column) -> Column:
    return F.when(channels == 1, 64).when(channels == 2, 128).when(channels == 6, 256).when(channels == 8, 384).otherwise(48 * channels).cast("bigint")


def disposition_text(flags: dict[str, Column]) -> Column:
    """Names of the flags that are set, joined by plus signs; 0 if none is."""
    names = F.concat_ws("+", *[F.when(flags[n] != 0, F.lit(n)) for n in DISPOSITIONS if n in flags])
    return F.coalesce(F.nullif(names, F.lit("")), F.lit("0"))


def output_dims(width: Column, height: Column, crop_filter: Column) -> tuple[Column, Column]:
    """Dimensions after a crop filter, with or without crop= in front; the source's if it has none that can be read."""
    p = F.split(F.regexp_replace(F.coalesce(crop_filter, F.lit("")), r"\Acrop=", ""), ":", -1)
    w, h = uint(F.get(p, F.lit(0)), 2**32 - 1), uint(F.get(p, F.lit(1)), 2**32 - 1)
    good = w.isNotNull() & h.isNotNull()
    return F.when(good, w).otherwise(width.cast("bigint")), F.when(good, h).otherwise(height.cast("bigint"))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*\z", "")


def extension(name: Column) -> Column:
    """Without the dot, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"\.([^./]*)\z", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*\z", "")


def percent_done(elapsed: Column, duration: Column) -> Column:
    """Up to 100; 0 if the duration isn't known; not held above 0."""
    return F.when(duration > 0, F.least(elapsed / duration * F.lit(100.0), F.lit(100.0))).otherwise(F.lit(0.0))


def eta_secs(elapsed: Column, duration: Column, rate: Column) -> Column:
    """Whole seconds left, truncated; 0 if speed or duration isn't known; may be negative."""
    return F.when((rate > 0) & (duration > 0), ((duration - elapsed) / rate).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
