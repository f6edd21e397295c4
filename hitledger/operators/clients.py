"""Analytics per client address.

Each operator takes one address, a list of addresses, or ``None`` for every client, and keeps
``ip_address`` in the group key, so a whole set of clients costs one scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitledger.functions import measures as m
from hitledger.functions.instants import bucket_key, bucket_label, client_unit, day_of_week, hour_of_day
from hitledger.functions.predicates import Scope, known
from hitledger.operators.latency import RANKS, client_offset, exact_percentiles
from hitledger.operators.rankings import with_tags
from hitledger.operators.rows import newest_first

_IP = "ip_address"


def of_clients(df: DataFrame, ips: str | Sequence[str] | None, scope: Scope) -> DataFrame:
    rows = scope.apply(df)
    if ips is not None:
        rows = rows.filter(F.col("client_ip").isin([ips] if isinstance(ips, str) else list(ips)))
    return rows.withColumn(_IP, F.col("client_ip"))


def _ranked(grouped: DataFrame, ips, order: str, keys: Sequence[str], limit: int) -> DataFrame:
    """Best ``limit`` rows of every client; the limit is applied before rows are shuffled."""
    if limit > 0:
        best = Window.partitionBy(_IP).orderBy(F.desc(order), *keys)
        grouped = grouped.withColumn("_place", F.row_number().over(best)).filter(F.col("_place") <= limit).drop("_place")
    return _in_order(grouped, ips, _IP, F.desc(order), *keys)


def _in_order(rows: DataFrame, ips, *order) -> DataFrame:
    """Sorted if clients were named; reports on all clients are left to the caller to sort."""
    return rows if ips is None else rows.orderBy(*order)


def ip_stats(
    df: DataFrame, ips, scope: Scope, *, tags: DataFrame, most_backends: int | None = None, most_paths: int | None = None
) -> DataFrame:
    """Profile per client: totals, first and last request, place, rates, distinct backends and paths.

    ``most_backends`` and ``most_paths`` bound what the two distinct counts show.
    """
    grouped = of_clients(df, ips, scope).groupBy(_IP).agg(
        m.hits("total_requests"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        *(F.max(c).alias(c) for c in ("geo_country", "geo_city", "geo_lat", "geo_lon", "asn", "asn_org")),
        m.bandwidth("total_bandwidth"),
        m.avg_time(),
        F.count_if(m.status_between(200, 400)).alias("_ok"),
        F.count_if(m.status_between(400)).alias("_bad"),
        F.count_distinct(F.when(F.col("backend_name") != "", F.col("backend_name"))).alias("unique_backends"),
        F.count_distinct("path").alias("unique_paths"),
    )
    rates = {n: m.percent(F.col(c), F.col("total_requests")) for n, c in (("success_rate", "_ok"), ("error_rate", "_bad"))}
    for name, most in (("unique_backends", most_backends), ("unique_paths", most_paths)):
        if most is not None:
            rates[name] = F.least(name, F.lit(most))
    return with_tags(grouped.withColumns(rates).drop("_ok", "_bad"), tags)


def ip_timeline(df: DataFrame, ips, scope: Scope) -> DataFrame:
    """Traffic per bucket. ``unique_visitors`` counts distinct backend names, '' included."""
    unit = client_unit(scope.hours)
    grouped = of_clients(df, ips, scope).groupBy(_IP, bucket_key(F.col("timestamp"), unit).alias("_bucket")).agg(
        m.hits("requests"), F.count_distinct("backend_name").alias("unique_visitors"), m.bandwidth(), m.avg_time()
    )
    named = _in_order(grouped.withColumn("hour", bucket_label(F.col("_bucket"), unit)), ips, _IP, "_bucket")
    return named.select(_IP, "hour", "requests", "unique_visitors", "bandwidth", "avg_response_time")


def ip_heatmap(df: DataFrame, ips, scope: Scope, *, days: int = 30) -> DataFrame:
    """Weekday and hour profile; ``days=0`` covers all time. Unmeasured requests count as 0 ms."""
    ts = F.col("timestamp")
    grouped = of_clients(df, ips, scope.with_days(days)).groupBy(_IP, day_of_week(ts).alias("day_of_week"), hour_of_day(ts).alias("hour"))
    return _in_order(grouped.agg(m.hits("requests"), m.avg_time_all()), ips, _IP, "day_of_week", "hour")


def ip_top_paths(df: DataFrame, ips, scope: Scope, limit: int = 10) -> DataFrame:
    grouped = of_clients(df, ips, scope).groupBy(_IP, "path").agg(
        m.hits(),
        F.lit(1).alias("unique_visitors"),
        m.avg_time(),
        m.bandwidth("total_bandwidth"),
        *(F.max(c).alias(c) for c in ("host", "backend_name", "backend_url")),
    )
    return _ranked(grouped, ips, "hits", ["path"], limit)


def ip_top_backends(df: DataFrame, ips, scope: Scope, limit: int = 10) -> DataFrame:
    rows = of_clients(df, ips, scope).filter(known("backend_name"))
    grouped = rows.groupBy(_IP, "backend_name").agg(
        F.max("backend_url").alias("backend_url"), m.hits(), m.bandwidth(), m.avg_time_all(),
        F.count_if(m.status_between(500)).alias("error_count"),
    )
    return _ranked(grouped, ips, "hits", ["backend_name"], limit)


def ip_distribution(df: DataFrame, ips, scope: Scope, column: str, limit: int = 0) -> DataFrame:
    """Requests per status code, browser, operating system or device type."""
    rows = of_clients(df, ips, scope)
    if column != "status_code":
        rows = rows.filter(known(column) if column == "device_type" else known(column, "Unknown"))
    return _ranked(rows.groupBy(_IP, column).agg(m.hits("count")), ips, "count", [column], limit)


def ip_response_time_stats(df: DataFrame, ips, scope: Scope) -> DataFrame:
    rows = of_clients(df, ips, scope).filter(F.col("response_time_ms") > 0)
    figures = {"min": F.min, "max": F.max, "avg": F.avg}
    base = rows.groupBy(_IP).agg(*(f("response_time_ms").alias(n) for n, f in figures.items()))
    ranks = exact_percentiles(rows, "response_time_ms", client_offset, by=[_IP])
    return base.join(ranks, _IP).select(_IP, "min", "max", "avg", *RANKS)


def ip_recent_requests(df: DataFrame, ips, scope: Scope, limit: int = 50) -> DataFrame:
    rows = of_clients(df, ips, scope)
    newest = Window.partitionBy(_IP).orderBy(*newest_first())
    best = rows.withColumn("_place", F.row_number().over(newest)).filter(F.col("_place") <= limit)
    return _in_order(best.drop("_place"), ips, _IP, *newest_first())


def ip_bot_share(df: DataFrame, ips, scope: Scope) -> DataFrame:
    rows = of_clients(df, ips, scope).filter(known("device_type"))
    counts = rows.groupBy(_IP).agg(F.count_if(F.col("device_type") == "bot").alias("bot_requests"), m.hits("total_requests"))
    return counts.withColumn("bot_percent", m.percent(F.col("bot_requests"), F.col("total_requests")))


def threat_level(df: DataFrame, scope: Scope, ips=None) -> DataFrame:
    """Error rate of every client and its class: over 50 % High, over 20 % Medium, else Low."""
    counts = of_clients(df, ips, scope).groupBy(_IP).agg(
        m.hits("total_requests"), F.count_if(m.status_between(400)).alias("failed_requests")
    )
    rate = m.percent(F.col("failed_requests"), F.col("total_requests"))
    level = F.when(rate > 50, "High").when(rate > 20, "Medium").otherwise("Low")
    return counts.withColumns({"error_rate": rate, "threat_level": level})
