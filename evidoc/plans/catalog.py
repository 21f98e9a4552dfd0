"""The registered queries of the document-evidence engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidoc.plans import exif_queries, pixel_queries, record_queries, sql_queries, stream_queries, visual_queries, zone_queries

_ALL = {**zone_queries.QUERIES, **visual_queries.QUERIES, **record_queries.QUERIES, **pixel_queries.QUERIES, **sql_queries.QUERIES, **exif_queries.QUERIES, **stream_queries.QUERIES}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in _ALL.items() if sql is not None}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machine-readable lines of all holders, built and parsed."""
    return zone_queries.td3_parse(spark, sf_dir)
