"""Sliding-window figures on a stream of requests.

Input is a streaming DataFrame with the request columns; ``timestamp`` must be a timestamp with
time zone semantics (cast parquet's zone-less type first). Windows are labelled by their end. The
slide is a parameter: rows are added up per slide, and every sum enters ``width / slide`` windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitledger.functions import measures as m
from hitledger.functions.instants import traffic_unit
from hitledger.functions.predicates import Scope, host_contains
from hitledger.operators.rows import newest_first
from hitledger.operators.realtime import (
    CLIENT_SECONDS,
    LATEST,
    MIX_SECONDS,
    RATE_SECONDS,
    TOP_CLIENTS,
    client_rates,
    live_service_name,
)

WATERMARK = "60 seconds"


def live(stream: DataFrame, scope: Scope = Scope(hours=0), *, host: str = "", watermark: str = WATERMARK) -> DataFrame:
    """Filtered stream with its lateness bound; rows later than that are ignored by the windows."""
    rows = stream.filter(host_contains(host)) if host else stream
    return scope.apply_who(rows).withWatermark("timestamp", watermark)


def _windowed(rows: DataFrame, seconds: int, slide: int, keys: dict[str, Column], *sums: Column, first: Column | None = None) -> DataFrame:
    """Sums, and the least ``first``, per sliding window, in two steps.

    Rows are added up per slide first; only those sums, not the rows, are copied into the windows that hold
    them. ``seconds`` is a multiple of ``slide``.
    """
    if seconds % slide:
        raise ValueError("a window must be a multiple of its slide")
    least = [] if first is None else [F.min(first).alias("_first")]
    steps = rows.groupBy(F.window("timestamp", f"{slide} seconds").alias("_step"), *(c.alias(n) for n, c in keys.items())).agg(*sums, *least)
    names = [c for c in steps.columns if c not in ("_step", "_first", *keys)]
    span = F.window("_step", f"{seconds} seconds", f"{slide} seconds").alias("_window")
    least = [] if first is None else [F.min("_first").alias("_first")]
    grouped = steps.groupBy(span, *keys).agg(*(F.sum(n).alias(n) for n in names), *least)
    return grouped.withColumn("window_end", F.col("_window.end")).drop("_window")


def rates(rows: DataFrame, *, slide: int = 1) -> DataFrame:
    """Requests, errors and bytes per second and mean response time over 5 s."""
    grouped = _windowed(
        rows, RATE_SECONDS, slide, {},
        m.hits("_n"), F.count_if(m.status_between(400)).alias("_errors"), m.bandwidth("_bytes"), F.sum("response_time_ms").alias("_time"),
    )
    return grouped.select(
        "window_end",
        (F.col("_n") / RATE_SECONDS).alias("request_rate"),
        (F.col("_errors") / RATE_SECONDS).alias("error_rate"),
        (F.col("_bytes") / RATE_SECONDS).alias("bandwidth_rate"),
        (F.col("_time") / F.col("_n")).alias("avg_response_time"),
    )


def status_mix(rows: DataFrame, *, slide: int = 1) -> DataFrame:
    """2xx, 4xx and 5xx counts over 60 s."""
    counts = [c for n, c in zip("2345", m.status_class_counts()) if n != "3"]
    return _windowed(rows, MIX_SECONDS, slide, {}, *counts).select("window_end", "status_2xx", "status_4xx", "status_5xx")


def client_activity(rows: DataFrame, *, slide: int = 1) -> DataFrame:
    """Rate, bytes and country per client over 15 s; rank it per window in the sink."""
    located = F.when(F.col("geo_country") != "", F.struct("timestamp", "geo_country"))
    grouped = _windowed(rows, CLIENT_SECONDS, slide, {"ip": F.col("client_ip")}, m.hits("_n"), m.bandwidth(), first=located)
    return client_rates(grouped.withColumn("country", F.coalesce(F.col("_first")["geo_country"], F.lit(""))).drop("_first"))


def top_clients(batch: DataFrame, limit: int = TOP_CLIENTS) -> DataFrame:
    """Busiest clients of each window of a finished batch (for ``foreachBatch``)."""
    place = F.row_number().over(Window.partitionBy("window_end").orderBy(F.desc("request_rate"), "ip"))
    return batch.withColumn("place", place).filter(F.col("place") <= limit)


def service_rates(rows: DataFrame, *, slide: int = 1) -> DataFrame:
    grouped = _windowed(
        rows, RATE_SECONDS, slide, {"service_name": live_service_name()}, m.hits("_n"), m.bandwidth("_bytes")
    )
    return grouped.filter(F.col("service_name") != "").select(
        "window_end",
        "service_name",
        (F.col("_n") / RATE_SECONDS).alias("request_rate"),
        (F.col("_bytes") / RATE_SECONDS).alias("bandwidth_rate"),
    )


def merge_latest(batch: DataFrame, previous: DataFrame | None, limit: int = LATEST) -> DataFrame:
    """Newest requests of a batch and the previous newest ones (for ``foreachBatch``)."""
    rows = batch if previous is None else batch.unionByName(previous.select(*batch.columns))
    return rows.orderBy(*newest_first()).limit(limit)


_TUMBLING = {"hour": "1 hour", "6h": "6 hours", "day": "1 day"}


def stream_timeline(rows: DataFrame, hours: float = 168) -> DataFrame:
    """Timeline kept up to date by the stream: 1 h, 6 h or 1 day buckets.

    Visitors are an estimate: exact distinct counts are not available on streams.
    """
    width = _TUMBLING.get(traffic_unit(hours), "1 day")
    grouped = rows.groupBy(F.window("timestamp", width).alias("_window")).agg(
        m.hits("requests"), F.approx_count_distinct("client_ip").alias("unique_visitors"), m.bandwidth(), m.avg_time_all()
    )
    return grouped.select(F.col("_window.start").alias("bucket_start"), "requests", "unique_visitors", "bandwidth", "avg_response_time")


def run_to_table(windows: DataFrame, path: str, checkpoint: str, *, transform=None, interval: str | None = None):
    """Append finished windows to a parquet folder; ``transform`` post-processes each batch.

    The folder is partitioned by batch and each batch overwrites its own partition, so a retried
    batch leaves no copies.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    writer = windows.writeStream.outputMode("append").foreachBatch(store)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
