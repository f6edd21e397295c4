"""Single requests: newest first, by source, by period, by key.

A stored row is known by its hash. Equal timestamps are ordered by hash, so pages of a list never overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitledger.functions.predicates import Scope, between


def newest_first() -> list[Column]:
    return [F.desc("timestamp"), F.desc("request_hash")]


def newest(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    ordered = df.orderBy(*newest_first())
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def recent_requests(df: DataFrame, scope: Scope = Scope(hours=0), *, limit: int = 50, offset: int = 0) -> DataFrame:
    return newest(scope.apply(df), limit, offset)


def find_by_source(df: DataFrame, source_name: str, limit: int = 100) -> DataFrame:
    return newest(df.filter(F.col("source_name") == source_name), limit)


def find_by_time_range(df: DataFrame, start, end, limit: int = 100) -> DataFrame:
    return newest(between(df, start, end), limit)


def find_by_hash(df: DataFrame, request_hash: str, month: str | None = None) -> DataFrame:
    """The row with this key. ``month`` (``2024-01``), if known, spares the other months of the table."""
    rows = df.filter(F.col("request_hash") == request_hash)
    return rows.filter(F.col("partition_key") == month) if month else rows
