"""Aggregate and scalar expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hits(name: str = "hits") -> Column:
    return F.count(F.lit(1)).alias(name)


def visitors(name: str = "unique_visitors") -> Column:
    return F.count_distinct("client_ip").alias(name)


def bandwidth(name: str = "bandwidth") -> Column:
    return F.coalesce(F.sum("response_size"), F.lit(0)).alias(name)


def avg_time(name: str = "avg_response_time") -> Column:
    """Mean over measured requests only; unmeasured ones carry 0."""
    measured = F.when(F.col("response_time_ms") > 0, F.col("response_time_ms"))
    return F.coalesce(F.avg(measured), F.lit(0.0)).alias(name)


def avg_time_all(name: str = "avg_response_time") -> Column:
    """Mean with the zeros of unmeasured requests included."""
    return F.coalesce(F.avg("response_time_ms"), F.lit(0.0)).alias(name)


def status_between(low: int, high: int | None = None) -> Column:
    code = F.col("status_code")
    return (code >= low) if high is None else (code >= low) & (code < high)


def status_class_counts() -> list[Column]:
    """Server errors are open-ended upwards; the other classes are bounded."""
    bounds = {"status_2xx": (200, 300), "status_3xx": (300, 400), "status_4xx": (400, 500), "status_5xx": (500, None)}
    return [F.count_if(status_between(*b)).alias(name) for name, b in bounds.items()]


def status_class(code: Column) -> Column:
    digit = F.floor(code / 100)
    return F.when(digit.between(2, 4), F.concat(digit.cast("string"), F.lit("xx"))).when(code >= 500, "5xx").otherwise("")


def percent(part: Column, whole: Column) -> Column:
    """``part / whole`` in percent; 0 when there is nothing to divide by."""
    return F.when(whole > 0, part / whole * 100).otherwise(0.0)


def change_percent(before: Column, after: Column) -> Column:
    """Relative change; growth from nothing counts as 100."""
    return F.when(before != 0, (after - before) / before * 100).when(after > 0, 100.0).otherwise(0.0)


def traffic_health(error_percent: Column) -> Column:
    return F.when(error_percent > 5, "danger").when(error_percent > 1, "warning").otherwise("healthy")


def service_name(fallback: str = "unknown") -> Column:
    """Service identity: first non-empty of backend name, backend URL and host."""
    parts = [F.when(F.col(c) != "", F.col(c)) for c in ("backend_name", "backend_url", "host")]
    return F.coalesce(*parts, F.lit(fallback))


def service_type(fallback: str = "unknown") -> Column:
    kind = F.lit(fallback)
    for column in ("host", "backend_url", "backend_name"):
        kind = F.when(F.col(column) != "", column).otherwise(kind)
    return kind


def display_name(backend: Column) -> Column:
    """Readable backend name: ``7-shop-api-service@docker`` reads ``shop api``.

    Provider and ``-service`` endings go, then the leading id; the remaining parts are joined by blanks.
    """
    core = F.regexp_replace(F.substring_index(backend, "@", 1), "-service$", "")
    parts = F.split(core, "-")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, F.size(parts)), " ")).otherwise(core)


def referrer_domain(referer: Column) -> Column:
    """Host part of a referrer.

    Scheme and path go first, then every ``www.`` as written, then upper case, then the port. A value
    holding ``@`` before the port is cut yields null, as does an empty host.
    """
    host = F.substring_index(F.regexp_replace(referer, "^(?i:https?:)?//", ""), "/", 1)
    host = F.lower(F.replace(host, F.lit("www."), F.lit("")))
    return F.when((host != "") & ~F.contains(host, F.lit("@")), F.substring_index(host, ":", 1))


def age_text(seconds: Column) -> Column:
    """Two largest units of a duration, e.g. ``3 days, 4 hours``."""
    total = F.abs(seconds).cast("long")

    def amount(value: Column, unit: str) -> Column:
        return F.concat(value.cast("string"), F.lit(f" {unit}"), F.when(value == 1, "").otherwise("s"))

    def pair(big: Column, big_unit: str, small: Column, small_unit: str) -> Column:
        return F.concat(amount(big, big_unit), F.when(small > 0, F.concat(F.lit(", "), amount(small, small_unit))).otherwise(""))

    days = F.floor(total / 86_400)
    hours = F.pmod(F.floor(total / 3_600), F.lit(24))
    minutes = F.pmod(F.floor(total / 60), F.lit(60))
    secs = F.pmod(total, F.lit(60))
    return (
        F.when(days > 0, pair(days, "day", hours, "hour"))
        .when(hours > 0, pair(hours, "hour", minutes, "minute"))
        .when(minutes > 0, pair(minutes, "minute", secs, "second"))
        .otherwise(amount(secs, "second"))
    )
