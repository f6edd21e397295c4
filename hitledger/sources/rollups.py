"""Stored hourly rollups, kept beside the request table.

A rollup folder is partitioned by month and day. After an append the hours it touched are made anew from the
stored requests and put among the other hours of their days, so the rollup equals the table whatever was retried
or came late. Only the row groups of those hours are read for that. The new days are written aside first and
replace the old ones as partitions, so a failure leaves the rollup as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitledger.functions.instants import bucket_key, utc
from hitledger.operators.cleaning import near
from hitledger.operators.rollup import SERVICE_KEYS, hourly_rollup
from hitledger.sources.sinks import delete_folders, folders_of, months_of, read_requests

#: Hours made anew by one write.
_AT_ONCE = 2_000


def _day(seconds: int) -> str:
    return datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%d")


def _write(made: DataFrame, rollup: str, overwrite: str) -> None:
    dated = made.withColumn("day", F.substring(F.date_format("hour", "yyyy-MM-dd"), 1, 10))
    dated.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", overwrite).partitionBy("partition_key", "day").parquet(rollup)


def refresh(spark: SparkSession, table: str, rollup: str, hours: Iterable[int] | None = None, keys: Sequence[str] = SERVICE_KEYS) -> None:
    """Make ``hours`` (their first seconds) of the rollup anew from the table; ``None`` makes all of it.

    A day of which no request is left keeps its old figures; :func:`retain` removes those.
    """
    if hours is None:
        return _write(hourly_rollup(read_requests(spark, table), keys), rollup, "static")
    wanted = sorted(set(hours))
    for at in range(0, len(wanted), _AT_ONCE):
        part = wanted[at : at + _AT_ONCE]
        days = sorted({_day(h) for h in part})
        months = sorted({d[:7] for d in days} & set(months_of(spark, table)))
        touched = bucket_key(F.col("timestamp"), "hour").isin(part)
        made = hourly_rollup(near(read_requests(spark, table, months), {h: [] for h in part}).filter(touched), keys)
        if months_of(spark, rollup):
            before = read_rollup(spark, rollup, months=months).filter(F.date_format("hour", "yyyy-MM-dd").isin(days))
            made = made.unionByName(before.filter(~F.unix_seconds("hour").isin(part)))
        aside = f"{rollup}/_new-{uuid.uuid4().hex[:12]}"
        made.write.parquet(aside)
        _write(spark.read.parquet(aside), rollup, "dynamic")
        delete_folders(spark, [aside])


def read_rollup(spark: SparkSession, rollup: str, months: Sequence[str] | None = None) -> DataFrame:
    """The stored rollup, or only some months of it; month partitions are text, as the filters expect."""
    known = months_of(spark, rollup)
    folders = [f"{rollup}/partition_key={m}" for m in known if months is None or m in months]
    columns = spark.read.option("basePath", rollup).parquet(*(folders or [f"{rollup}/partition_key={known[0]}"])).drop("day", "partition_key")
    schema = columns.schema.add("partition_key", "string").add("day", "string")
    read = spark.read.schema(schema).option("basePath", rollup).parquet(*(folders or [f"{rollup}/partition_key={known[0]}"])).drop("day")
    return read if folders else read.limit(0)


def retain(spark: SparkSession, table: str, rollup: str, *, as_of, days: int = 60, keys: Sequence[str] = SERVICE_KEYS) -> list[str]:
    """Follow the table's retention: drop the days before the cutoff's, and make that day anew from the table.

    Returns the days dropped.
    """
    if days <= 0:
        return []
    border = (utc(as_of) - timedelta(days=days)).strftime("%Y-%m-%d")
    gone = []
    for month in (m for m in months_of(spark, rollup) if m <= border[:7]):
        folder = f"{rollup}/partition_key={month}"
        old = [name for name in folders_of(spark, folder) if name.removeprefix("day=") <= border]
        delete_folders(spark, [f"{folder}/{name}" for name in old])
        gone += [name.removeprefix("day=") for name in old if name.removeprefix("day=") < border]
    start = int(utc(f"{border} 00:00:00").timestamp())
    refresh(spark, table, rollup, range(start, start + 86_400, 3_600), keys)
    return gone
