"""Row filters shared by every operator."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitledger.functions.instants import day_of_week, hour_of_day, instant, utc


@dataclass(frozen=True)
class Service:
    """A service by backend name, backend URL or host.

    ``auto`` follows the service identity (first non-empty of the three); ``auto_loose`` accepts a
    match in any of them. Any other type behaves like ``auto``.
    """

    name: str
    type: str = "auto"

    def matches(self) -> Column:
        name, url, host = (F.col(c) for c in ("backend_name", "backend_url", "host"))
        if self.type in ("backend_name", "backend_url", "host"):
            return F.col(self.type) == self.name
        if self.type == "auto_loose":
            return (name == self.name) | (url == self.name) | (host == self.name)
        return (
            (name == self.name)
            | ((name == "") & (url == self.name))
            | ((name == "") & (url == "") & (host == self.name))
        )


def any_service(services: Sequence[Service]) -> Column:
    return reduce(or_, (s.matches() for s in services))


@dataclass(frozen=True)
class Exclusion:
    """Clients to leave out, everywhere or only on the listed services.

    ``client_ips`` is a list of addresses, or a DataFrame with a ``client_ip`` column when the list
    is long; the latter becomes an anti join.
    """

    client_ips: Sequence[str] | DataFrame
    services: Sequence[Service] = ()

    def apply(self, df: DataFrame) -> DataFrame:
        if isinstance(self.client_ips, DataFrame):
            blocked = self.client_ips.select(F.col("client_ip").alias("_blocked_ip"))
            on = F.col("client_ip") == F.col("_blocked_ip")
            if self.services:
                on = on & any_service(self.services)
            return df.join(blocked, on, "left_anti")
        if not self.client_ips:
            return df
        hit = F.col("client_ip").isin(list(self.client_ips))
        if self.services:
            hit = hit & any_service(self.services)
        return df.filter(~hit)


@dataclass(frozen=True)
class Scope:
    """What a report covers: a look-back window, services to keep and clients to leave out.

    ``hours=0`` means all time, any other window is taken as it is; a negative one is an error. The
    lower bound is exclusive.
    """

    as_of: object = None
    hours: float = 168
    services: Sequence[Service] = ()
    exclude: Exclusion | None = field(default=None)

    def __post_init__(self) -> None:
        if self.hours < 0:
            raise ValueError("a window cannot be negative")

    def with_days(self, days: int) -> "Scope":
        """The same scope over ``days``; 0 covers all time."""
        return Scope(self.as_of, days * 24, self.services, self.exclude)

    def apply(self, df: DataFrame) -> DataFrame:
        if self.hours > 0:
            df = since(df, self.as_of, self.hours)
        return self.apply_who(df)

    def apply_who(self, df: DataFrame) -> DataFrame:
        if self.services:
            df = df.filter(any_service(self.services))
        return self.exclude.apply(df) if self.exclude else df


def since(df: DataFrame, as_of, hours: float) -> DataFrame:
    """Rows strictly newer than ``as_of - hours``; prunes month partitions when the table has them."""
    start = utc(as_of) - timedelta(hours=hours)
    df = df.filter(F.col("timestamp") > instant(start))
    if "partition_key" in df.columns:
        df = df.filter(F.col("partition_key") >= start.strftime("%Y-%m"))
    return df


def between(df: DataFrame, start, end) -> DataFrame:
    """Rows of an absolute period, both ends included."""
    first, last = utc(start), utc(end)
    df = df.filter(F.col("timestamp").between(instant(first), instant(last)))
    if "partition_key" in df.columns:
        df = df.filter(F.col("partition_key").between(first.strftime("%Y-%m"), last.strftime("%Y-%m")))
    return df


@dataclass(frozen=True)
class DrillDown:
    """Extra equality filters for client rankings."""

    country: str = ""
    device_type: str = ""
    asn: int = 0
    day_of_week: int | None = None
    hour: int | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        if self.country:
            df = df.filter(F.col("geo_country") == self.country)
        if self.device_type:
            df = df.filter(F.lower("device_type") == self.device_type.lower())
        if self.asn > 0:
            df = df.filter(F.col("asn") == self.asn)
        if self.day_of_week is not None:
            df = df.filter(day_of_week(F.col("timestamp")) == self.day_of_week)
        if self.hour is not None:
            df = df.filter(hour_of_day(F.col("timestamp")) == self.hour)
        return df


def contains_ci(column: Column, text: str) -> Column:
    """Substring test ignoring ASCII case."""
    return F.contains(F.lower(column), F.lit(text.lower()))


def host_contains(display_name: str) -> Column:
    """Backends whose raw name contains a display name (blanks stand for dashes)."""
    return F.contains(F.col("backend_name"), F.lit(display_name.replace(" ", "-")))


def known(column: str, *unknown: str) -> Column:
    """Non-empty and not one of the ``unknown`` markers."""
    test = F.col(column) != ""
    for marker in unknown:
        test = test & (F.col(column) != marker)
    return test
