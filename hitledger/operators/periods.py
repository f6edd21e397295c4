"""Period comparison: 2 to 4 absolute periods, all reports from one scan each.

Every request is copied once per period it falls into (periods may overlap) by exploding a literal
list, so no join is needed; the period number then leads every group key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitledger.functions import measures as m
from hitledger.functions.instants import (
    bucket_key,
    bucket_label,
    day_of_week,
    hour_of_day,
    instant,
    period_unit,
    utc,
)
from hitledger.functions.predicates import Scope, known
from hitledger.operators.rankings import client_measures, with_tags
from hitledger.operators.summary import summary_measures, summary_rates

PERIOD = "period"


@dataclass(frozen=True)
class Period:
    label: str
    start: datetime
    end: datetime

    @property
    def hours(self) -> float:
        return (self.end - self.start).total_seconds() / 3_600


def periods_of(*given: tuple) -> list[Period]:
    """Build and check 2 to 4 periods from (label, start, end); empty labels are numbered."""
    if not 2 <= len(given) <= 4:
        raise ValueError("a comparison needs 2 to 4 periods")
    built = [Period(label or f"Period {n}", utc(start), utc(end)) for n, (label, start, end) in enumerate(given, 1)]
    for p in built:
        if p.end <= p.start:
            raise ValueError(f"period {p.label!r} ends before it starts")
    return built


def preset_periods(name: str, *, as_of) -> list[Period]:
    """Common comparisons ending at ``as_of``; the current period comes first."""
    now = utc(as_of)
    rolling = {"24v24": (24, "Last 24h"), "7v7": (7 * 24, "Last 7d"), "30v30": (30 * 24, "Last 30d")}
    if name in rolling:
        hours, label = rolling[name]
        middle = now - timedelta(hours=hours)
        return periods_of((label, middle, now), (f"Previous {hours}h", middle - timedelta(hours=hours), middle))
    if name == "same-hour-week":
        midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
        week = timedelta(days=7)
        return periods_of(("Today so far", midnight, now), ("Same hours last week", midnight - week, now - week))
    raise ValueError(f"unknown preset: {name}")


def in_periods(df: DataFrame, periods: Sequence[Period], scope: Scope = Scope(hours=0)) -> DataFrame:
    """Requests of the periods with their ``period`` number, counted from 1.

    The scan gets the periods joined by OR, with their months: what lies between them is not read.
    """
    ts = F.col("timestamp")
    rows = df.filter(reduce(or_, (ts.between(instant(p.start), instant(p.end)) for p in periods)))
    if "partition_key" in df.columns:
        month = F.col("partition_key")
        rows = rows.filter(reduce(or_, (month.between(p.start.strftime("%Y-%m"), p.end.strftime("%Y-%m")) for p in periods)))
    rows = scope.apply_who(rows)
    member = [F.when(ts.between(instant(p.start), instant(p.end)), F.lit(n)) for n, p in enumerate(periods, 1)]
    return rows.withColumn(PERIOD, F.explode(F.array_compact(F.array(*member))))


def _case(periods: Sequence[Period], value) -> Column:
    """Per-period value as a CASE on the period number."""
    picked = None
    for n, p in enumerate(periods, 1):
        v = value(p)
        v = v if isinstance(v, Column) else F.lit(v)
        test = F.col(PERIOD) == n
        picked = F.when(test, v) if picked is None else picked.when(test, v)
    return picked


def period_labels(periods: Sequence[Period]) -> Column:
    return _case(periods, lambda p: p.label)


def period_summary(rows: DataFrame, periods: Sequence[Period]) -> DataFrame:
    """Summary per period; the hourly rate uses the period's length, at least one hour."""
    hours = _case(periods, lambda p: max(p.hours, 1.0))
    totals = rows.groupBy(PERIOD).agg(*summary_measures())
    return totals.withColumns(summary_rates(hours)).drop("not_found", "server_errors").orderBy(PERIOD)


def _bucketed(rows: DataFrame, periods: Sequence[Period], keys: list[Column], names: list[str], *measures: Column) -> DataFrame:
    ts = F.col("timestamp")
    bucket = _case(periods, lambda p: bucket_key(ts, period_unit(p.hours)))
    grouped = rows.groupBy(PERIOD, *keys, bucket.alias("_bucket")).agg(*measures)
    label = _case(periods, lambda p: bucket_label(F.col("_bucket"), period_unit(p.hours)))
    values = [c for c in grouped.columns if c not in (PERIOD, *names, "_bucket")]
    return grouped.withColumn("hour", label).orderBy(PERIOD, *names, "_bucket").select(PERIOD, *names, "hour", *values)


def period_timeline(rows: DataFrame, periods: Sequence[Period]) -> DataFrame:
    measures = [m.hits("requests"), m.visitors(), m.bandwidth(), m.avg_time()]
    return _bucketed(rows, periods, [], [], *measures)


def period_service_timeline(rows: DataFrame, periods: Sequence[Period]) -> DataFrame:
    keys = [m.service_name().alias("service_name"), m.service_type().alias("service_type")]
    measures = [m.hits("requests"), m.bandwidth(), m.avg_time(), F.count_if(m.status_between(400)).alias("errors")]
    return _bucketed(rows, periods, keys, ["service_name", "service_type"], *measures)


def period_status_timeline(rows: DataFrame, periods: Sequence[Period]) -> DataFrame:
    return _bucketed(rows, periods, [], [], *m.status_class_counts())


def period_heatmap(rows: DataFrame) -> DataFrame:
    ts = F.col("timestamp")
    keys = [PERIOD, day_of_week(ts).alias("day_of_week"), hour_of_day(ts).alias("hour")]
    return rows.groupBy(*keys).agg(m.hits("requests"), m.avg_time()).orderBy(PERIOD, "day_of_week", "hour")


def _best(grouped: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    if limit < 1:
        raise ValueError("a top list needs a limit of 1 or more")
    place = F.row_number().over(Window.partitionBy(PERIOD).orderBy(F.desc("hits"), *keys))
    return grouped.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place").orderBy(PERIOD, F.desc("hits"), *keys)


def period_top_paths(rows: DataFrame, limit: int = 10) -> DataFrame:
    grouped = rows.groupBy(PERIOD, "path").agg(m.hits(), m.visitors(), m.avg_time(), m.bandwidth("total_bandwidth"))
    return _best(grouped, ["path"], limit)


def period_top_ips(rows: DataFrame, tags: DataFrame, limit: int = 10) -> DataFrame:
    grouped = rows.groupBy(PERIOD, F.col("client_ip").alias("ip_address")).agg(*client_measures())
    best = _best(grouped, ["ip_address"], limit)
    return with_tags(best, tags).orderBy(PERIOD, F.desc("hits"), "ip_address")


def period_top_countries(rows: DataFrame, limit: int = 10) -> DataFrame:
    keyed = rows.filter(known("geo_country")).groupBy(PERIOD, F.col("geo_country").alias("country"))
    return _best(keyed.agg(m.hits(), m.visitors(), m.bandwidth()), ["country"], limit)


def _service_rows(rows: DataFrame, fallback: str, errors_from: int) -> DataFrame:
    keys = [m.service_name(fallback).alias("backend_name"), m.service_type(fallback or "host").alias("service_type")]
    return rows.groupBy(PERIOD, *keys).agg(
        F.max("backend_url").alias("backend_url"), F.max("host").alias("host"), m.hits(), m.bandwidth(),
        m.avg_time(), F.count_if(m.status_between(errors_from)).alias("error_count"),
    )


def period_top_backends(rows: DataFrame, limit: int = 10) -> DataFrame:
    return _best(_service_rows(rows, "", 500), ["backend_name", "service_type"], limit)


def period_services(rows: DataFrame) -> DataFrame:
    """Every service per period; errors start at 400 here."""
    return _service_rows(rows, "unknown", 400).orderBy(PERIOD, F.desc("hits"), "backend_name", "service_type")


def period_status_codes(rows: DataFrame) -> DataFrame:
    return rows.groupBy(PERIOD, "status_code").agg(m.hits("count")).orderBy(PERIOD, F.desc("count"), "status_code")


def period_devices(rows: DataFrame) -> DataFrame:
    device = F.when(known("device_type"), F.col("device_type")).otherwise("unknown").alias("device_type")
    return rows.groupBy(PERIOD, device).agg(m.hits("count")).orderBy(PERIOD, F.desc("count"), "device_type")


def compare(df: DataFrame, periods: Sequence[Period], scope: Scope = Scope(hours=0), *, tags: DataFrame, limit: int = 10) -> dict[str, DataFrame]:
    """All comparison reports, lazily; each is one scan over all periods together."""
    rows = in_periods(df, periods, scope)
    return {
        "summary": period_summary(rows, periods),
        "timeline": period_timeline(rows, periods),
        "service_timeline": period_service_timeline(rows, periods),
        "status_code_timeline": period_status_timeline(rows, periods),
        "heatmap": period_heatmap(rows),
        "top_paths": period_top_paths(rows, limit),
        "top_ips": period_top_ips(rows, tags, limit),
        "top_countries": period_top_countries(rows, limit),
        "top_backends": period_top_backends(rows, limit),
        "service_breakdown": period_services(rows),
        "status_code_distribution": period_status_codes(rows),
        "device_types": period_devices(rows),
    }


# --- derived from the reports above -------------------------------------------------------------

KPI_METRICS = ("total_requests", "total_bandwidth", "avg_response_time", "server_error_rate")
_LOWER_IS_BETTER = ("avg_response_time", "server_error_rate")


def _first_last(summaries: DataFrame, count: int) -> DataFrame:
    """One row per metric with its value in the first and in the last period."""

    def pick(metric: str, period: int) -> Column:
        value = F.max(F.when(F.col(PERIOD) == period, F.col(metric).cast("double")))
        return F.coalesce(value, F.lit(0.0)).alias(f"_{metric}_{period}")

    wide = summaries.agg(*(pick(metric, p) for metric in KPI_METRICS for p in (1, count)))
    return wide.select(
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.lit(metric).alias("metric"), F.col(f"_{metric}_1").alias("before"), F.col(f"_{metric}_{count}").alias("after")
                    )
                    for metric in KPI_METRICS
                )
            )
        )
    )


def kpi_deltas(summaries: DataFrame, count: int) -> DataFrame:
    """Change of the headline figures from the first to the last period; 0 when the base is 0."""
    delta = F.when(F.col("before") != 0, (F.col("after") - F.col("before")) / F.col("before") * 100).otherwise(0.0)
    inverse = F.col("metric").isin(*_LOWER_IS_BETTER)
    tone = F.when(delta == 0, "neutral").when((delta > 0) != inverse, "positive").otherwise("negative")
    return _first_last(summaries, count).withColumns({"delta_percent": delta, "tone": tone})


def metric_insights(summaries: DataFrame, count: int) -> DataFrame:
    """Headline figures that moved by 20 % or 50 units, with severity and score."""
    delta = F.col("after") - F.col("before")
    change = m.change_percent(F.col("before"), F.col("after"))
    size = F.abs("change_percent")
    inverse = F.col("metric").isin(*_LOWER_IS_BETTER)
    moved = _first_last(summaries, count).withColumns({"delta": delta, "change_percent": change})
    return moved.filter((size >= 20) | (F.abs("delta") >= 50)).select(
        "metric", "before", "after", "change_percent",
        F.when(size >= 100, "high").when(size >= 40, "medium").otherwise("low").alias("severity"),
        F.when(inverse, F.col("delta") > 0).otherwise(F.col("delta") < 0).alias("is_bad"),
        (size + F.log10(F.abs("delta") + 1)).alias("score"),
    ).orderBy(F.desc("score"), "metric")


def entity_counts(rows: DataFrame, column: str, entity: str, listed: DataFrame | None = None) -> DataFrame:
    """Hits per period of the values of ``column``, named ``entity``: of all, or of those that ``listed`` has in any period.

    A value's figures are its own in every period, whether or not it is in that period's list.
    """
    counts = rows.groupBy(PERIOD, F.col(column).alias(entity)).agg(m.hits())
    return counts if listed is None else counts.join(listed.select(entity).distinct(), entity, "left_semi")


def entity_matrix(report: DataFrame, entity: str, count: int, *, value: str = "hits", limit: int | None = None) -> DataFrame:
    """One row per entity with its value in each period; a period without requests of it counts 0.

    ``report`` must hold every period's value of its entities (``entity_counts``, or a report without a
    limit). ``max_delta`` is the range, ``last_delta`` the change from first to last period. The entities
    with the widest range come first; ``limit`` keeps that many.
    """
    named = F.when(F.col(entity) != "", F.col(entity)).otherwise("Unknown").alias("name")
    cell = [F.sum(F.when(F.col(PERIOD) == p, F.col(value)).otherwise(0)).alias(f"p{p}") for p in range(1, count + 1)]
    cells = [F.col(f"p{p}") for p in range(1, count + 1)]
    wide = report.groupBy(named).agg(*cell)
    out = wide.withColumns(
        {
            "max_delta": F.greatest(*cells) - F.least(*cells),
            "last_delta": cells[-1] - cells[0],
            "last_delta_percent": m.change_percent(cells[0], cells[-1]),
        }
    )
    ranked = out.withColumn("trend", trend_class()).orderBy(F.desc("max_delta"), "name")
    return ranked if limit is None else ranked.limit(limit)


def trend_class() -> Column:
    change = F.col("last_delta_percent")
    stable = (F.col("max_delta") == 0) | (F.abs(change) < 5)
    return F.when(stable, "Stable").when(change > 0, "Increasing").when(change < 0, "Decreasing").otherwise("Variable")


def entity_insights(matrix: DataFrame, kind: str, *, considered: int | None = None) -> DataFrame:
    """Entities that changed by 30 % or 25 units, among the ``considered`` of the widest range or among all."""
    size, delta = F.abs("last_delta_percent"), F.abs("last_delta")
    widest = matrix if considered is None else matrix.orderBy(F.desc("max_delta"), "name").limit(considered)
    return widest.filter((size >= 30) | (delta >= 25)).select(
        F.lit(kind).alias("kind"), "name", F.col("p1").alias("before"),
        (F.col("p1") + F.col("last_delta")).alias("after"), "last_delta_percent",
        F.when(size >= 150, "high").when(size >= 75, "medium").otherwise("low").alias("severity"),
        (size + delta).alias("score"), "trend",
    ).orderBy(F.desc("score"), "name")


# Report, its entity column, the request column behind it and the kind shown, for each list that feeds the change analysis.
INSIGHT_SOURCES = [
    ("service_breakdown", "backend_name", None, "Service"),
    ("top_paths", "path", "path", "Path"),
    ("top_ips", "ip_address", "client_ip", "IP"),
    ("top_countries", "country", "geo_country", "Country"),
]


def all_entity_insights(rows: DataFrame, reports: dict[str, DataFrame], count: int, *, considered: int | None = None) -> DataFrame:
    """Insights on the entities of the reports; ``rows`` are the requests of the periods, for their whole figures."""
    found = None
    for report, entity, column, kind in INSIGHT_SOURCES:
        listed = reports[report]
        counts = listed if column is None else entity_counts(rows, column, entity, listed)
        part = entity_insights(entity_matrix(counts, entity, count), kind, considered=considered)
        found = part if found is None else found.unionByName(part)
    return found.orderBy(F.desc("score"), "kind", "name")


def trend_description(values: Column) -> Column:
    """Shape of a series of period values in words: class and, where it applies, the period number."""
    n = F.size(values)
    active = F.transform(values, lambda v: v > 0)
    first = F.array_position(active, True)
    last = n + 1 - F.array_position(F.reverse(active), True)
    steps = F.zip_with(F.slice(values, 2, n - 1), F.slice(values, 1, n - 1), lambda b, a: b - a)
    rising, falling = F.forall(steps, lambda s: s > 0), F.forall(steps, lambda s: s < 0)
    peak, dip = F.array_position(values, F.array_max(values)), F.array_position(values, F.array_min(values))
    inner = lambda c: (c > 1) & (c < n)
    at = lambda word, c: F.concat(F.lit(f"{word}:"), c.cast("string"))
    return (
        F.when(n < 2, "")
        .when(first == 0, "none")
        .when(first > 1, at("appeared", first))
        .when(last < n, at("disappeared", last + 1))
        .when(rising, "up")
        .when(falling, "down")
        .when(inner(peak), at("peak", peak))
        .when(inner(dip), at("dip", dip))
        .otherwise("mixed")
    )


def describe_trends(matrix: DataFrame, count: int) -> DataFrame:
    values = F.array(*(F.col(f"p{p}") for p in range(1, count + 1)))
    return matrix.select("name", *(f"p{p}" for p in range(1, count + 1)), trend_description(values).alias("trend"))


def period_steps(summaries: DataFrame, metric: str = "total_requests") -> DataFrame:
    """Change of a figure from each period to the next. At most four rows, so one window is fine."""
    previous = F.lag(metric).over(Window.orderBy(PERIOD))
    rows = summaries.select(PERIOD, F.col(metric).alias("value"), previous.alias("previous"))
    change = F.when(F.col("previous").isNotNull(), m.change_percent(F.col("previous"), F.col("value")))
    return rows.withColumns({"delta": F.col("value") - F.col("previous"), "change_percent": change})


def align_timelines(points: DataFrame, count: int, *, value: str = "requests") -> DataFrame:
    """Timelines side by side by position: first bucket with first bucket, and so on."""
    place = F.row_number().over(Window.partitionBy(PERIOD).orderBy("hour"))
    numbered = points.select(PERIOD, place.alias("bucket"), F.col(value).alias("_v"))
    cells = [F.max(F.when(F.col(PERIOD) == p, F.col("_v"))).alias(f"p{p}") for p in range(1, count + 1)]
    return numbered.groupBy("bucket").agg(*cells).orderBy("bucket")


def period_matrix(report: DataFrame, column: str, count: int) -> DataFrame:
    """Counts per value and period, zero filled (status codes, devices)."""
    cells = [F.sum(F.when(F.col(PERIOD) == p, F.col("count")).otherwise(0)).alias(f"p{p}") for p in range(1, count + 1)]
    return report.groupBy(column).agg(*cells).orderBy(column)
