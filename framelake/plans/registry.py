"""All registered queries of the media catalogue, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalogue_encode, catalogue_events, catalogue_files, catalogue_media, catalogue_probe

MODULES = [catalogue_media, catalogue_files, catalogue_probe, catalogue_encode, catalogue_events]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, (_, text) in m.QUERIES.items() if text}
