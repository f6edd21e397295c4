"""Whole-table figures: traffic summary, widgets, record counts and ages."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitledger.functions import measures as m
from hitledger.functions.instants import epoch_micros, instant, utc
from hitledger.functions.predicates import Scope

_HOUR_MICROS = 3_600 * 1_000_000


def summary_measures() -> list[Column]:
    """One pass of conditional counts; the three distinct counts share it through Expand."""
    return [
        m.hits("total_requests"),
        F.count_if(m.status_between(200, 400)).alias("valid_requests"),
        F.count_if(m.status_between(400)).alias("failed_requests"),
        m.visitors(),
        F.count_distinct("path").alias("unique_files"),
        F.count_distinct(F.when(F.col("status_code") == 404, F.col("path"))).alias("unique_404"),
        m.bandwidth("total_bandwidth"),
        m.avg_time(),
        F.count_if(F.col("status_code") == 404).alias("not_found"),
        F.count_if(m.status_between(500, 600)).alias("server_errors"),
    ]


def summary_rates(hours: Column) -> dict[str, Column]:
    total = F.col("total_requests")
    return {
        "success_rate": m.percent(F.col("valid_requests"), total),
        "not_found_rate": m.percent(F.col("not_found"), total),
        "server_error_rate": m.percent(F.col("server_errors"), total),
        "requests_per_hour": F.coalesce(total / hours, F.lit(0.0)),
    }


def summary(df: DataFrame, scope: Scope) -> DataFrame:
    """Totals, distinct counts, rates and requests per hour in one row.

    Over all time the rate uses the span between the first and last request, at least one hour.
    """
    span = (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / _HOUR_MICROS
    measured_hours = F.lit(float(scope.hours)) if scope.hours > 0 else F.greatest(span, F.lit(1.0))
    totals = scope.apply(df).agg(*summary_measures(), measured_hours.alias("_hours"))
    return totals.withColumns(summary_rates(F.col("_hours"))).drop("_hours", "not_found", "server_errors")


def health_widget(df: DataFrame, scope: Scope) -> DataFrame:
    """Last hour: per-minute traffic, error share (5xx and 404) and a traffic light."""
    last_hour = summary(df, Scope(scope.as_of, 1, scope.services, scope.exclude))
    errors = F.col("server_error_rate") + F.col("not_found_rate")
    return last_hour.select(
        m.traffic_health(errors).alias("status"),
        (F.col("total_requests") / 60).alias("requests_per_minute"),
        errors.alias("error_rate"),
        "avg_response_time",
        (F.col("total_bandwidth") / 60).alias("bandwidth_per_minute"),
        F.col("unique_visitors").alias("unique_ips"),
    )


def widget_summary(df: DataFrame, scope: Scope) -> DataFrame:
    """Compact summary of the scope's window."""
    totals = summary(df, scope)
    errors = F.col("server_error_rate") + F.col("not_found_rate")
    return totals.select(
        m.traffic_health(errors).alias("status"),
        "total_requests",
        F.col("requests_per_hour").alias("requests_per_hr"),
        errors.alias("error_rate"),
        F.col("avg_response_time").alias("avg_response_ms"),
        F.col("unique_visitors").alias("unique_ips"),
        (F.col("total_bandwidth") / (1024 * 1024)).alias("bandwidth_mb"),
    )


def record_time_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))


def count_records(df: DataFrame) -> DataFrame:
    return df.agg(m.hits("records"))


def count_by_source(df: DataFrame, source_name: str | None = None) -> DataFrame:
    if source_name is not None:
        df = df.filter(F.col("source_name") == source_name)
    return df.groupBy("source_name").agg(m.hits("records"))


def has_data(df: DataFrame) -> DataFrame:
    """One boolean; reads at most one row."""
    return df.select(F.lit(1).alias("one")).limit(1).agg((F.count("one") > 0).alias("has_data"))


def count_older_than(df: DataFrame, cutoff) -> DataFrame:
    df = df.filter(F.col("timestamp") < instant(cutoff))
    if "partition_key" in df.columns:
        df = df.filter(F.col("partition_key") <= utc(cutoff).strftime("%Y-%m"))
    return df.agg(m.hits("records"))


def system_stats(df: DataFrame, *, as_of, retention_days: int = 60) -> DataFrame:
    """Record count, records due for removal and ages of the oldest and newest record, in one scan."""
    now = F.lit(epoch_micros(as_of))
    cutoff = instant(utc(as_of) - timedelta(days=retention_days))
    due = F.count_if(F.col("timestamp") < cutoff) if retention_days > 0 else F.lit(0).cast("bigint")
    figures = df.agg(
        m.hits("total_records"),
        due.alias("records_to_cleanup"),
        F.min(F.unix_micros("timestamp")).alias("_oldest"),
        F.max(F.unix_micros("timestamp")).alias("_newest"),
    )

    def age(column: str) -> Column:
        return F.coalesce(m.age_text((now - F.col(column)) / 1_000_000), F.lit("No records"))

    return figures.select(
        "total_records",
        "records_to_cleanup",
        F.lit(retention_days).alias("retention_days"),
        age("_oldest").alias("oldest_record_age"),
        age("_newest").alias("newest_record_age"),
    )
