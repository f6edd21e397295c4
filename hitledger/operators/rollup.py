"""Hourly rollup of requests: sums, and sketches that merge over any window.

A rollup row has the figures of one hour for one value of its keys. Counts and sums add up exactly. Distinct
clients and paths are HyperLogLog sketches, response times a KLL sketch: unions of sketches over hours, services
or paths estimate what a scan of all requests would count. Reports on a rollup read no request.

A rollup is kept for a set of keys, by default the three service columns, so that service filters work on it.
Clients cannot be taken out of a sketch: reports refuse a scope with an exclusion. Windows are whole hours.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitledger.functions import measures as m
from hitledger.functions.instants import bucket_key, instant, month_key, status_unit, traffic_unit, utc
from hitledger.functions.predicates import Scope
from hitledger.operators.latency import RANKS
from hitledger.operators.summary import summary_rates
from hitledger.operators.timelines import by_bucket

SERVICE_KEYS = ("backend_name", "backend_url", "host")
#: HyperLogLog registers as a power of two: a relative standard error of about 1.04 / sqrt(2^12), 1.6 %.
HLL_BITS = 12
#: KLL size: a rank error of about 1.3 % for a single rank at 200, 0.4 % at 800.
KLL_SIZE = 800
#: Bounds that checks hold estimates to: five standard errors of the distinct counts, twice the usual rank error.
DISTINCT_ERROR, RANK_ERROR = 0.082, 0.01

_COUNTS = ("requests", "valid_requests", "failed_requests", "not_found", "server_errors", "status_2xx", "status_3xx", "status_4xx", "status_5xx", "bandwidth", "measured")
#: Columns of requests that the figures are made of.
_MEASURED = ("timestamp", "status_code", "response_size", "response_time_ms", "client_ip", "path")
_SKETCHES = ("clients", "paths", "missing_paths")


def hourly_rollup(requests: DataFrame, keys: Sequence[str] = SERVICE_KEYS) -> DataFrame:
    """One row for each hour and each value of ``keys``; ``hour`` is its first instant.

    The rows meet by their hour and keys before they are aggregated: most groups have a few rows in every task that
    reads them, and a sketch of a few rows is larger than they are.
    """
    hour = F.timestamp_seconds(bucket_key(F.col("timestamp"), "hour"))
    taken = F.when(F.col("response_time_ms") > 0, F.col("response_time_ms"))
    named = requests.select(hour.alias("hour"), *dict.fromkeys((*keys, *_MEASURED)))
    rows = named.repartition("hour", *keys).groupBy("hour", *keys).agg(
        m.hits("requests"),
        F.count_if(m.status_between(200, 400)).alias("valid_requests"),
        F.count_if(m.status_between(400)).alias("failed_requests"),
        F.count_if(F.col("status_code") == 404).alias("not_found"),
        F.count_if(m.status_between(500, 600)).alias("server_errors"),
        *m.status_class_counts(),
        m.bandwidth(),
        F.count(taken).alias("measured"),
        F.coalesce(F.sum("response_time_ms"), F.lit(0.0)).alias("time"),
        F.min(taken).alias("fastest"),
        F.max(taken).alias("slowest"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.hll_sketch_agg("client_ip", F.lit(HLL_BITS)).alias("clients"),
        F.hll_sketch_agg("path", F.lit(HLL_BITS)).alias("paths"),
        F.hll_sketch_agg(F.when(F.col("status_code") == 404, F.col("path")), F.lit(HLL_BITS)).alias("missing_paths"),
        F.kll_sketch_agg_double(taken, F.lit(KLL_SIZE)).alias("times"),
    )
    return rows.withColumn("partition_key", month_key(F.col("hour")))


def merge(rollup: DataFrame, *by: Column | str) -> DataFrame:
    """Figures of ``rollup`` for each value of ``by``, with the same columns."""
    return rollup.groupBy(*by).agg(
        *(F.sum(c).alias(c) for c in (*_COUNTS, "time")),
        F.min("fastest").alias("fastest"), F.max("slowest").alias("slowest"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        *(F.hll_union_agg(c).alias(c) for c in _SKETCHES),
        F.kll_merge_agg_double("times").alias("times"),
    )


def _window(rollup: DataFrame, scope: Scope) -> DataFrame:
    """The hours of a scope: those that begin at its lower bound or later."""
    if scope.exclude:
        raise ValueError("clients cannot be taken out of a rollup; use the requests")
    if scope.services and not set(SERVICE_KEYS) <= set(rollup.columns):
        raise ValueError("this rollup is not kept by service")
    if scope.hours > 0:
        start = utc(scope.as_of) - timedelta(hours=scope.hours)
        if start.minute or start.second or start.microsecond:
            raise ValueError("a rollup window begins at a whole hour")
        rollup = rollup.filter((F.col("hour") >= instant(start)) & (F.col("partition_key") >= start.strftime("%Y-%m")))
    return scope.apply_who(rollup)


def _distinct(sketch: str) -> Column:
    return F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0))


def _mean(total: str, n: str) -> Column:
    return F.coalesce(F.col(total) / F.when(F.col(n) > 0, F.col(n)), F.lit(0.0))


def summary_from_rollup(rollup: DataFrame, scope: Scope) -> DataFrame:
    """The traffic summary; the three distinct counts are estimates."""
    one = merge(_window(rollup, scope))
    counts = {c: F.coalesce(c, F.lit(0)) for c in _COUNTS}
    micros = F.unix_micros("last_seen") - F.unix_micros("first_seen")
    hours = F.lit(float(scope.hours)) if scope.hours > 0 else F.greatest(micros / 3_600_000_000, F.lit(1.0))
    named = one.withColumns(counts).withColumnRenamed("requests", "total_requests").withColumns(
        {
            "unique_visitors": _distinct("clients"), "unique_files": _distinct("paths"), "unique_404": _distinct("missing_paths"),
            "total_bandwidth": F.col("bandwidth"), "avg_response_time": _mean("time", "measured"), "_hours": hours,
        }
    )
    rated = named.withColumns(summary_rates(F.col("_hours")))
    return rated.select(
        "total_requests", "valid_requests", "failed_requests", "unique_visitors", "unique_files", "unique_404", "total_bandwidth",
        "avg_response_time", "success_rate", "not_found_rate", "server_error_rate", "requests_per_hour",
    )


def timeline_from_rollup(rollup: DataFrame, scope: Scope) -> DataFrame:
    """The traffic timeline; visitors are estimates, unmeasured requests count as 0 ms."""
    rows = _window(rollup, scope).withColumn("timestamp", F.col("hour"))
    measures = [
        F.sum("requests").alias("requests"), F.hll_sketch_estimate(F.hll_union_agg("clients")).alias("unique_visitors"),
        F.sum("bandwidth").alias("bandwidth"), (F.sum("time") / F.sum("requests")).alias("avg_response_time"),
    ]
    return by_bucket(rows.drop("hour"), traffic_unit(scope.hours), *measures)


def status_timeline_from_rollup(rollup: DataFrame, scope: Scope) -> DataFrame:
    rows = _window(rollup, scope).withColumn("timestamp", F.col("hour"))
    return by_bucket(rows.drop("hour"), status_unit(scope.hours), *(F.sum(c).alias(c) for c in ("status_2xx", "status_3xx", "status_4xx", "status_5xx")))


def top_from_rollup(rollup: DataFrame, scope: Scope, key: str, limit: int = 10) -> DataFrame:
    """Values of a key of the rollup by hits, ties by value; visitors are estimates. ``limit=0`` gives all."""
    grouped = merge(_window(rollup, scope), key).select(
        key, F.col("requests").alias("hits"), _distinct("clients").alias("unique_visitors"), _mean("time", "measured").alias("avg_response_time"),
        F.col("bandwidth").alias("total_bandwidth"),
    )
    ordered = grouped.orderBy(F.desc("hits"), key)
    return ordered.limit(limit) if limit > 0 else ordered


def response_times_from_rollup(rollup: DataFrame, scope: Scope, by: Sequence[str] = ()) -> DataFrame:
    """Least, greatest and mean response time, exact, and percentiles within the sketch's rank error; per value of ``by``.

    Zeros where nothing was measured.
    """
    merged = merge(_window(rollup, scope), *by)
    ranks = [F.when(F.col("measured") > 0, F.kll_sketch_get_quantile_double("times", F.lit(n / d))).alias(p) for p, (n, d) in RANKS.items()]
    found = merged.select(*by, F.col("fastest").alias("min"), F.col("slowest").alias("max"), _mean("time", "measured").alias("avg"), *ranks)
    return found.select(*by, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("min", "max", "avg", *RANKS)))
