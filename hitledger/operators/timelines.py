"""Requests over time: adaptive timelines, heatmaps and profiles.

Groups are keyed by integers (bucket start, week number); labels are formatted per result row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitledger.functions import measures as m
from hitledger.functions.instants import (
    bucket_key,
    bucket_label,
    day_of_week,
    hour_of_day,
    status_unit,
    traffic_unit,
)
from hitledger.functions.predicates import Scope


def _ts() -> Column:
    return F.col("timestamp")


def by_bucket(df: DataFrame, unit: str, *measures: Column) -> DataFrame:
    grouped = df.groupBy(bucket_key(_ts(), unit).alias("_bucket")).agg(*measures)
    labelled = grouped.withColumn("hour", bucket_label(F.col("_bucket"), unit))
    names = [c for c in grouped.columns if c != "_bucket"]
    return labelled.orderBy("_bucket").select("hour", *names)


def timeline(df: DataFrame, scope: Scope) -> DataFrame:
    """Traffic per bucket; the mean response time counts unmeasured requests as 0."""
    measures = [m.hits("requests"), m.visitors(), m.bandwidth(), m.avg_time_all()]
    return by_bucket(scope.apply(df), traffic_unit(scope.hours), *measures)


def status_timeline(df: DataFrame, scope: Scope) -> DataFrame:
    return by_bucket(scope.apply(df), status_unit(scope.hours), *m.status_class_counts())


def records_timeline(df: DataFrame, *, as_of, days: int = 30) -> DataFrame:
    """Stored records per day."""
    rows = Scope(as_of).with_days(days).apply(df)
    return by_bucket(rows, "day", m.hits("requests"))


def widget_timeline(df: DataFrame, scope: Scope, *, points: int | None = None) -> DataFrame:
    """The timeline's newest ``points`` buckets, or all."""
    full = timeline(df, scope)
    newest = full.orderBy(F.desc("hour")).limit(points) if points else full
    return newest.select("hour", "requests", "bandwidth", "avg_response_time").orderBy("hour")


def heatmap_rows(df: DataFrame, *measures: Column) -> DataFrame:
    keys = [day_of_week(_ts()).alias("day_of_week"), hour_of_day(_ts()).alias("hour")]
    return df.groupBy(*keys).agg(*measures)


def traffic_heatmap(df: DataFrame, scope: Scope, *, days: int = 30) -> DataFrame:
    """Requests and mean response time per weekday (0 = Sunday) and hour."""
    rows = scope.with_days(days).apply(df)
    return heatmap_rows(rows, m.hits("requests"), m.avg_time()).orderBy("day_of_week", "hour")


def _profile(heatmap: DataFrame, column: str, slots: int) -> DataFrame:
    """Total per slot; slots without traffic are 0."""
    spark = heatmap.sparkSession
    frame = spark.range(slots).select(F.col("id").cast("int").alias(column))
    totals = heatmap.groupBy(column).agg(F.sum("requests").alias("requests"))
    filled = frame.join(totals, column, "left")
    return filled.select(column, F.coalesce("requests", F.lit(0)).alias("requests")).orderBy(column)


def hour_profile(df: DataFrame, scope: Scope, *, days: int = 30) -> DataFrame:
    return _profile(traffic_heatmap(df, scope, days=days), "hour", 24)


def weekday_profile(df: DataFrame, scope: Scope, *, days: int = 30) -> DataFrame:
    return _profile(traffic_heatmap(df, scope, days=days), "day_of_week", 7)


def peak_bucket(df: DataFrame, scope: Scope) -> DataFrame:
    """Busiest bucket of the timeline; the earliest one on a tie."""
    counts = by_bucket(scope.apply(df), traffic_unit(scope.hours), m.hits("requests"))
    return counts.filter(F.col("requests") > 0).orderBy(F.desc("requests"), "hour").limit(1)
