"""Hashes that Spark and other SQL engines compute alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a hash taken from MD5: 13 hexadecimal digits, which a double still holds exactly.
HASH_BITS = 52


def hash52(*parts: Column) -> Column:
    """An integer from 0 to 2^52-1 out of the parts' text, joined with colons; a null part counts as the word null."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def unit(h: Column) -> Column:
    """A hash52 as a number strictly between 0 and 1."""
    return (h + F.lit(0.5)) / F.lit(float(1 << HASH_BITS))
