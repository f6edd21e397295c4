"""Backends and services: rankings, health and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitledger.functions import measures as m
from hitledger.functions.predicates import Scope, known


def _by_service(df: DataFrame, *measures: Column) -> DataFrame:
    """One pass over the service identity; rows without any service name are left out."""
    keyed = df.withColumns({"name": m.service_name(""), "service_type": m.service_type("")})
    return keyed.filter(F.col("name") != "").groupBy("name", "service_type").agg(*measures)


def _backend_url() -> Column:
    """URL of the group; host services have none by definition."""
    return F.when(F.col("service_type") == "host", "").otherwise(F.col("_url")).alias("backend_url")


def backend_stats(df: DataFrame, scope: Scope) -> DataFrame:
    """Every service with hits, bandwidth, server errors and mean response time."""
    grouped = _by_service(
        scope.apply(df),
        F.max("backend_url").alias("_url"),
        F.max("host").alias("host"),
        m.hits(),
        m.bandwidth(),
        F.count_if(m.status_between(500)).alias("error_count"),
        m.avg_time(),
    )
    return grouped.select(
        F.col("name").alias("backend_name"), _backend_url(), "host", "service_type",
        "hits", "bandwidth", "error_count", "avg_response_time",
    )


def top_backends(df: DataFrame, scope: Scope, limit: int = 10) -> DataFrame:
    ranked = backend_stats(df, scope).drop("avg_response_time")
    return ranked.orderBy(F.desc("hits"), "backend_name", "service_type").limit(limit)


def services(df: DataFrame) -> DataFrame:
    counts = _by_service(df, m.hits("count"))
    return counts.select("name", F.col("service_type").alias("type"), "count").orderBy(F.desc("count"), "name", "type")


def domains(df: DataFrame) -> DataFrame:
    """Requests per readable backend name; raw names are counted first, then merged."""
    raw = df.filter(known("backend_name")).groupBy("backend_name").agg(m.hits("count"))
    named = raw.select(m.display_name(F.col("backend_name")).alias("host"), "count").filter(F.col("host") != "")
    return named.groupBy("host").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "host")


def backend_health(df: DataFrame, scope: Scope) -> DataFrame:
    """Error percentage, status and a 0..100 score per service."""
    stats = backend_stats(df, scope)
    error_percent, time = m.percent(F.col("error_count"), F.col("hits")), F.col("avg_response_time")
    status = (
        F.when((error_percent > 10) | (time > 1_000), "critical")
        .when((error_percent > 5) | (time > 500), "degraded")
        .otherwise("healthy")
    )
    slowness = F.when(time > 1_000, 30.0).when(time > 500, 15.0).when(time > 200, 5.0).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - error_percent / 100 * 50 - slowness))
    return stats.select(
        "backend_name", "service_type", "hits", "bandwidth", "error_count", "avg_response_time",
        error_percent.alias("error_percent"), status.alias("status"), score.alias("health_score"),
    )


def backend_totals(df: DataFrame, scope: Scope) -> DataFrame:
    """Number of services, their requests, the mean of their means and the overall error percentage."""
    totals = backend_stats(df, scope).agg(
        m.hits("total_backends"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("total_requests"),
        F.coalesce(F.avg("avg_response_time"), F.lit(0.0)).alias("avg_response_time"),
        F.coalesce(F.sum("error_count"), F.lit(0)).alias("_errors"),
    )
    return totals.withColumn("error_percent", m.percent(F.col("_errors"), F.col("total_requests"))).drop("_errors")
