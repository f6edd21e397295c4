"""Realtime figures at a point in time, over a bounded table.

The streaming twin is ``hitledger.streaming.realtime``; both use the same windows: 5 s for rates,
15 s for clients, 60 s for the status mix. A row counts when it is strictly newer than the window's
start.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitledger.functions import measures as m
from hitledger.functions.instants import instant, utc
from hitledger.functions.predicates import Scope, host_contains
from hitledger.operators.rows import newest_first

RATE_SECONDS, CLIENT_SECONDS, MIX_SECONDS = 5, 15, 60
MIN_CLIENT_RATE = 0.05
TOP_CLIENTS, LATEST = 10, 20


def live_rows(df: DataFrame, scope: Scope, *, host: str = "", seconds: int = MIX_SECONDS) -> DataFrame:
    """Filtered rows of the last ``seconds`` before ``scope.as_of``."""
    now = utc(scope.as_of)
    rows = df.filter((F.col("timestamp") > instant(now - timedelta(seconds=seconds))) & (F.col("timestamp") <= instant(now)))
    if "partition_key" in df.columns:
        rows = rows.filter(F.col("partition_key").isin(*{(now - timedelta(seconds=s)).strftime("%Y-%m") for s in (0, seconds)}))
    if host:
        rows = rows.filter(host_contains(host))
    return scope.apply_who(rows)


def live_service_name() -> Column:
    """Readable backend name, else backend URL, else host."""
    return (
        F.when(F.col("backend_name") != "", m.display_name(F.col("backend_name")))
        .when(F.col("backend_url") != "", F.col("backend_url"))
        .otherwise(F.col("host"))
    )


def realtime_snapshot(df: DataFrame, scope: Scope, *, host: str = "") -> DataFrame:
    """Rates, mean response time and status mix in one row; an idle window resets all to zero."""
    rows = live_rows(df, scope, host=host)
    recent = F.col("timestamp") > instant(utc(scope.as_of) - timedelta(seconds=RATE_SECONDS))
    counts = rows.agg(
        F.count_if(recent).alias("_n"),
        F.count_if(recent & m.status_between(400)).alias("_errors"),
        F.coalesce(F.sum(F.when(recent, F.col("response_size"))), F.lit(0)).alias("_bytes"),
        F.coalesce(F.avg(F.when(recent, F.col("response_time_ms"))), F.lit(0.0)).alias("avg_response_time"),
        *(c for name, c in zip(("2xx", "3xx", "4xx", "5xx"), m.status_class_counts()) if name != "3xx"),
    )
    active = F.col("_n") > 0
    return counts.select(
        *((F.col(c) / RATE_SECONDS).alias(n) for c, n in (("_n", "request_rate"), ("_errors", "error_rate"), ("_bytes", "bandwidth_rate"))),
        "avg_response_time",
        *(F.when(active, F.col(c)).otherwise(0).alias(c) for c in ("status_2xx", "status_4xx", "status_5xx")),
    )


def client_measures_live() -> list[Column]:
    """Requests, bytes and the country of the earliest request that has one."""
    located = F.when(F.col("geo_country") != "", F.struct("timestamp", "geo_country"))
    return [m.hits("_n"), m.bandwidth(), F.coalesce(F.min(located)["geo_country"], F.lit("")).alias("country")]


def client_rates(grouped: DataFrame) -> DataFrame:
    rates = {"request_rate": F.col("_n") / CLIENT_SECONDS, "bandwidth_rate": F.col("bandwidth") / CLIENT_SECONDS}
    return grouped.withColumns(rates).filter(F.col("request_rate") > MIN_CLIENT_RATE).drop("_n")


def realtime_top_ips(df: DataFrame, scope: Scope, *, host: str = "", limit: int = TOP_CLIENTS) -> DataFrame:
    """Most active clients; empty once nothing arrived within the rate window."""
    rows = live_rows(df, scope, host=host, seconds=CLIENT_SECONDS)
    recent = F.col("timestamp") > instant(utc(scope.as_of) - timedelta(seconds=RATE_SECONDS))
    active = rows.agg((F.count_if(recent) > 0).alias("active")).scalar()
    grouped = client_rates(rows.groupBy(F.col("client_ip").alias("ip")).agg(*client_measures_live()))
    return grouped.filter(active).orderBy(F.desc("request_rate"), "ip").limit(limit)


def realtime_services(df: DataFrame, scope: Scope, *, host: str = "") -> DataFrame:
    rows = live_rows(df, scope, host=host, seconds=RATE_SECONDS)
    grouped = rows.groupBy(live_service_name().alias("service_name")).agg(m.hits("_n"), m.bandwidth("_bytes"))
    return grouped.filter(F.col("service_name") != "").select(
        "service_name", (F.col("_n") / RATE_SECONDS).alias("request_rate"), (F.col("_bytes") / RATE_SECONDS).alias("bandwidth_rate")
    )


def latest_requests(df: DataFrame, scope: Scope, *, host: str = "", limit: int = LATEST) -> DataFrame:
    rows = live_rows(df, scope, host=host)
    columns = ("request_hash", "timestamp", "method", "host", "backend_name", "path", "status_code", "response_time_ms", "geo_country", "client_ip")
    return rows.select(*columns).orderBy(*newest_first()).limit(limit)
