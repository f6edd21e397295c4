"""Queries comparing absolute periods; the third and fourth period overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from hitledger.functions.predicates import Exclusion, Scope, Service
from hitledger.operators import periods as pd
from hitledger.plans.catalog import query
from hitledger.plans.report_queries import SHOP
from hitledger.plans.sample import AS_OF
from hitledger.plans.sample_sql import (
    AVG, BYTES, DAY, DOW, HITS, HOUR, HOUR_NO, MONTH, SERVICE, SERVICE_TYPE, SIX, STATUS_CLASSES, TOTAL_BYTES, VISITORS,
    base, pct,
)

_GIVEN = [
    ("One day", "2024-01-10 00:00:00", "2024-01-11 00:00:00"),
    ("Five days", "2024-01-12 06:00:00", "2024-01-17 06:00:00"),
    ("", "2024-01-08 00:00:00", "2024-01-22 00:00:00"),
    ("Whole month", "2024-01-01 00:00:00", "2024-02-01 00:00:00"),
]
COUNT = len(_GIVEN)


def _periods() -> list[pd.Period]:
    return pd.periods_of(*_GIVEN)


_IN = base(
    "periods(period, s, e) AS (VALUES "
    + ", ".join(f"(CAST({n} AS BIGINT), TIMESTAMP '{s}', TIMESTAMP '{e}')" for n, (_, s, e) in enumerate(_GIVEN, 1))
    + ")",
    'r AS (SELECT period, s, e, h.* FROM http_requests h JOIN periods ON h."timestamp" BETWEEN s AND e)',
).rstrip()
_BUCKET = f"CASE period WHEN 1 THEN {HOUR} WHEN 2 THEN {SIX} WHEN 3 THEN {DAY} ELSE {MONTH} END"


def _sql(body: str, *more: str) -> str:
    return ",\n".join([_IN, *more]) + "\n" + body


def _best(select: str, where: str, group: str, order: str, limit: int) -> str:
    return f"""SELECT period, {select} FROM r WHERE {where} GROUP BY period, {group}
QUALIFY row_number() OVER (PARTITION BY period ORDER BY count(*) DESC, {order}) <= {limit}"""


_OK = "count(*) FILTER (status_code >= 200 AND status_code < 400)"
_SUMMARY = f"""SELECT period, count(*) AS total_requests, {_OK} AS valid_requests, count(*) FILTER (status_code >= 400) AS failed_requests,
  {VISITORS}, count(DISTINCT path) AS unique_files, count(DISTINCT CASE WHEN status_code = 404 THEN path END) AS unique_404,
  {TOTAL_BYTES}, {AVG}, {pct(_OK)} AS success_rate, {pct("count(*) FILTER (status_code = 404)")} AS not_found_rate,
  {pct("count(*) FILTER (status_code BETWEEN 500 AND 599)")} AS server_error_rate,
  round(count(*) / greatest(epoch(max(e)) - epoch(max(s)), 3600)::DOUBLE * 3600, 6) AS requests_per_hour
FROM r GROUP BY period"""
_TIMELINE = f"SELECT period, {_BUCKET} AS hour, count(*) AS requests, {VISITORS}, {BYTES}, {AVG} FROM r GROUP BY 1, 2"
_PATHS = _best(f"path, {HITS}, {VISITORS}, {AVG}, {TOTAL_BYTES}", "true", "path", "path", 10)
_IPS = _best(
    f"""client_ip AS ip_address, max(geo_country) AS country, max(geo_city) AS city, max(geo_lat) AS latitude, max(geo_lon) AS longitude,
  {HITS}, {BYTES}""",
    "true", "client_ip", "client_ip", 10,
)
_COUNTRIES = _best(f"geo_country AS country, {HITS}, {VISITORS}, {BYTES}", "geo_country <> ''", "geo_country", "geo_country", 10)


def _service_rows(errors: int) -> str:
    return f"""{SERVICE} AS backend_name, {SERVICE_TYPE} AS service_type, max(backend_url) AS backend_url, max(host) AS host,
  {HITS}, {BYTES}, {AVG}, count(*) FILTER (status_code >= {errors}) AS error_count"""


_SERVICES = f"SELECT period, {_service_rows(400)} FROM r GROUP BY period, {SERVICE}, {SERVICE_TYPE}"
_STATUS = "SELECT period, status_code, count(*) AS count FROM r GROUP BY 1, 2"
_DEVICES = "SELECT period, coalesce(nullif(device_type, ''), 'unknown') AS device_type, count(*) AS count FROM r GROUP BY 1, 2"


def _rows(s):
    return pd.in_periods(s.placed, _periods())


_BUILD = {
    "timeline": lambda s: pd.period_timeline(_rows(s), _periods()),
    "service_timeline": lambda s: pd.period_service_timeline(_rows(s), _periods()),
    "status_code_timeline": lambda s: pd.period_status_timeline(_rows(s), _periods()),
    "heatmap": lambda s: pd.period_heatmap(_rows(s)),
    "top_paths": lambda s: pd.period_top_paths(_rows(s)),
    "top_ips": lambda s: pd.period_top_ips(_rows(s), s.tags),
    "top_countries": lambda s: pd.period_top_countries(_rows(s)),
    "top_backends": lambda s: pd.period_top_backends(_rows(s)),
    "service_breakdown": lambda s: pd.period_services(_rows(s)),
    "status_code_distribution": lambda s: pd.period_status_codes(_rows(s)),
    "device_types": lambda s: pd.period_devices(_rows(s)),
}


query("compare_summary", lambda s: pd.period_summary(pd.in_periods(s.plain, _periods()), _periods()), _sql(_SUMMARY))
query("compare_timeline", _BUILD["timeline"], _sql(_TIMELINE))
query(
    "compare_service_timeline",
    _BUILD["service_timeline"],
    _sql(f"""SELECT period, {SERVICE} AS service_name, {SERVICE_TYPE} AS service_type, {_BUCKET} AS hour, count(*) AS requests,
  {BYTES}, {AVG}, count(*) FILTER (status_code >= 400) AS errors FROM r GROUP BY 1, 2, 3, 4"""),
)
query(
    "compare_status_timeline",
    _BUILD["status_code_timeline"],
    _sql(f"SELECT period, {_BUCKET} AS hour, {STATUS_CLASSES} FROM r GROUP BY 1, 2"),
)
query(
    "compare_heatmap",
    _BUILD["heatmap"],
    _sql(f"SELECT period, {DOW} AS day_of_week, {HOUR_NO} AS hour, count(*) AS requests, {AVG} FROM r GROUP BY 1, 2, 3"),
)
query("compare_top_paths", _BUILD["top_paths"], _sql(_PATHS))
query(
    "compare_top_ips",
    _BUILD["top_ips"],
    _sql(
        """SELECT i.*, coalesce(t.friendly_name, '') AS friendly_name, coalesce(t.tags, '') AS tags
FROM ips i LEFT JOIN ip_tags t USING (ip_address)""",
        f"ips AS ({_IPS})",
    ),
)
query("compare_top_countries", _BUILD["top_countries"], _sql(_COUNTRIES))
query(
    "compare_top_backends",
    _BUILD["top_backends"],
    _sql(_best(_service_rows(500), "true", f"{SERVICE}, {SERVICE_TYPE}", f"{SERVICE}, {SERVICE_TYPE}", 10)),
)
query("compare_services", _BUILD["service_breakdown"], _sql(_SERVICES))
query("compare_status_codes", _BUILD["status_code_distribution"], _sql(_STATUS))
query("compare_devices", _BUILD["device_types"], _sql(_DEVICES))
query(
    "compare_filtered",
    lambda s: pd.period_summary(
        pd.in_periods(
            s.plain,
            _periods(),
            Scope(hours=0, services=(Service(SHOP), Service("site2.example.com", "host")), exclude=Exclusion(("10.0.0.2",))),
        ),
        _periods(),
    ),
    _sql(_SUMMARY.replace("FROM r", f"FROM r WHERE (backend_name = '{SHOP}' OR host = 'site2.example.com') AND client_ip <> '10.0.0.2'")),
)
query(
    "compare_preset_weeks",
    lambda s: pd.period_summary(
        pd.in_periods(s.plain, pd.preset_periods("7v7", as_of=AS_OF)), pd.preset_periods("7v7", as_of=AS_OF)
    ).select("period", "total_requests", "unique_visitors"),
    base() + f"""SELECT CAST(1 AS BIGINT) AS period, count(*) AS total_requests, {VISITORS} FROM http_requests
WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-24' AND TIMESTAMP '2024-01-31'
UNION ALL SELECT 2, count(*), count(DISTINCT client_ip) FROM http_requests
WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-17' AND TIMESTAMP '2024-01-24'""",
)
for _name, _as_of, _spans in (
    ("24v24", AS_OF, (("2024-01-30", "2024-01-31"), ("2024-01-29", "2024-01-30"))),
    ("30v30", AS_OF, (("2024-01-01", "2024-01-31"), ("2023-12-02", "2024-01-01"))),
    ("same-hour-week", "2024-01-30 12:00:00", (("2024-01-30", "2024-01-30 12:00:00"), ("2024-01-23", "2024-01-23 12:00:00"))),
):
    query(
        f"compare_preset_{_name.replace('-', '_')}",
        lambda s, name=_name, as_of=_as_of: pd.period_summary(
            pd.in_periods(s.plain, pd.preset_periods(name, as_of=as_of)), pd.preset_periods(name, as_of=as_of)
        ).select("period", "total_requests", "failed_requests", "unique_visitors", "unique_files", "total_bandwidth"),
        base() + "\nUNION ALL\n".join(
            f"""SELECT * FROM (SELECT CAST({n} AS BIGINT) AS period, count(*) AS total_requests, count(*) FILTER (status_code >= 400) AS failed_requests,
  {VISITORS}, count(DISTINCT path) AS unique_files, {TOTAL_BYTES} FROM http_requests
  WHERE "timestamp" BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}') WHERE total_requests > 0"""
            for n, (a, b) in enumerate(_spans, 1)
        ),
    )
query(
    "compare_labels",
    lambda s: pd.in_periods(s.plain, _periods()).groupBy(pd.period_labels(_periods()).alias("label")).agg(F.count(F.lit(1)).alias("requests")),
    _sql("SELECT CASE period WHEN 1 THEN 'One day' WHEN 2 THEN 'Five days' WHEN 3 THEN 'Period 3' ELSE 'Whole month' END AS label, count(*) AS requests FROM r GROUP BY 1"),
)

# --- derived reports ---

_KPI = f"""kpi AS (
  SELECT period, count(*)::DOUBLE AS total_requests, coalesce(sum(response_size), 0)::DOUBLE AS total_bandwidth,
    coalesce(avg(CASE WHEN response_time_ms > 0 THEN response_time_ms END), 0) AS avg_response_time,
    count(*) FILTER (status_code BETWEEN 500 AND 599) * 100.0::DOUBLE / count(*) AS server_error_rate
  FROM r GROUP BY period)"""
_MOVES = f"""moves AS (
  SELECT a.metric, a.v AS before, b.v AS after,
    CASE WHEN a.v <> 0 THEN (b.v - a.v) / a.v * 100 WHEN b.v > 0 THEN 100 ELSE 0 END AS change
  FROM (UNPIVOT kpi ON total_requests, total_bandwidth, avg_response_time, server_error_rate INTO NAME metric VALUE v) a
  JOIN (UNPIVOT kpi ON total_requests, total_bandwidth, avg_response_time, server_error_rate INTO NAME metric VALUE v) b
  ON a.metric = b.metric AND a.period = 1 AND b.period = {COUNT})"""
_INVERSE = "metric IN ('avg_response_time', 'server_error_rate')"


def _summary_of(s):
    return pd.period_summary(pd.in_periods(s.plain, _periods()), _periods())


query(
    "compare_kpi_deltas",
    lambda s: pd.kpi_deltas(_summary_of(s), COUNT),
    _sql(
        f"""SELECT metric, round(before, 6) AS before, round(after, 6) AS after, round(change, 6) AS delta_percent,
  CASE WHEN change = 0 THEN 'neutral' WHEN (change > 0) <> {_INVERSE} THEN 'positive' ELSE 'negative' END AS tone FROM moves""",
        _KPI, _MOVES,
    ),
)
query(
    "compare_metric_insights",
    lambda s: pd.metric_insights(_summary_of(s), COUNT),
    _sql(
        f"""SELECT metric, round(before, 6) AS before, round(after, 6) AS after, round(change, 6) AS change_percent,
  CASE WHEN abs(change) >= 100 THEN 'high' WHEN abs(change) >= 40 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN {_INVERSE} THEN after > before ELSE after < before END AS is_bad,
  round(abs(change) + log10(abs(after - before) + 1), 6) AS score
FROM moves WHERE abs(change) >= 20 OR abs(after - before) >= 50""",
        _KPI, _MOVES,
    ),
)

_P = [f"p{n}" for n in range(1, COUNT + 1)]


def _cells(source: str, entity: str, value: str = "hits") -> str:
    cells = ", ".join(f"CAST(coalesce(sum({value}) FILTER (period = {n}), 0) AS BIGINT) AS p{n}" for n in range(1, COUNT + 1))
    return f"SELECT {entity} AS name, {cells} FROM ({source}) GROUP BY 1"


def _matrix(source: str, entity: str, value: str = "hits") -> str:
    change = f"CASE WHEN p1 <> 0 THEN (p{COUNT} - p1)::DOUBLE / p1 * 100 WHEN p{COUNT} > 0 THEN 100 ELSE 0 END"
    ranges = f"SELECT *, greatest({', '.join(_P)}) - least({', '.join(_P)}) AS max_delta, p{COUNT} - p1 AS last_delta, {change} AS pct FROM ({_cells(source, entity, value)})"
    return f"""SELECT *, CASE WHEN max_delta = 0 OR abs(pct) < 5 THEN 'Stable' WHEN pct > 0 THEN 'Increasing' WHEN pct < 0 THEN 'Decreasing' ELSE 'Variable' END AS trend
FROM ({ranges})"""


def _whole(best: str, column: str, entity: str) -> str:
    """Hits per period of all values of a column that the list ``best`` names in any period."""
    return f"SELECT period, {column} AS {entity}, {HITS} FROM r WHERE {column} IN (SELECT {entity} FROM ({best})) GROUP BY 1, 2"


_ALL_PATHS, _ALL_IPS = _whole(_PATHS, "path", "path"), _whole(_IPS, "client_ip", "ip_address")
_ALL_COUNTRIES = _whole(_COUNTRIES, "geo_country", "country")


def _counts(s, report: str, column: str, entity: str):
    return pd.entity_counts(_rows(s), column, entity, _BUILD[report](s))


for _report, _column, _entity, _source, _value in (
    ("top_paths", "path", "path", _ALL_PATHS, "hits"),
    ("top_ips", "client_ip", "ip_address", _ALL_IPS, "hits"),
    ("top_countries", "geo_country", "country", _ALL_COUNTRIES, "hits"),
    ("service_breakdown", None, "backend_name", _SERVICES, "hits"),
    ("device_types", None, "device_type", _DEVICES, "count"),
):
    query(
        f"compare_matrix_{_report}",
        lambda s, report=_report, column=_column, entity=_entity, value=_value: pd.entity_matrix(
            _counts(s, report, column, entity) if column else _BUILD[report](s), entity, COUNT, value=value
        ),
        _sql(f"SELECT * EXCLUDE (pct), round(pct, 6) AS last_delta_percent FROM ({_matrix(_source, _entity, _value)})"),
    )

_INSIGHT_PARTS = "\nUNION ALL\n".join(
    f"SELECT '{kind}' AS kind, * FROM ({_matrix(source, entity)})"
    for kind, entity, source in (
        ("Service", "backend_name", _SERVICES), ("Path", "path", _ALL_PATHS), ("IP", "ip_address", _ALL_IPS), ("Country", "country", _ALL_COUNTRIES),
    )
)
query(
    "compare_entity_insights",
    lambda s: pd.all_entity_insights(_rows(s), pd.compare(s.placed, _periods(), tags=s.tags), COUNT),
    _sql(f"""SELECT kind, name, p1 AS before, p{COUNT} AS after, round(pct, 6) AS last_delta_percent,
  CASE WHEN abs(pct) >= 150 THEN 'high' WHEN abs(pct) >= 75 THEN 'medium' ELSE 'low' END AS severity,
  round(abs(pct) + abs(last_delta), 6) AS score, trend
FROM ({_INSIGHT_PARTS}) WHERE abs(pct) >= 30 OR abs(last_delta) >= 25"""),
)
_DESCRIPTION = """CASE
  WHEN p1 = 0 AND p2 = 0 AND p3 = 0 AND p4 = 0 THEN 'none'
  WHEN p1 = 0 AND p2 > 0 THEN 'appeared:2' WHEN p1 = 0 AND p3 > 0 THEN 'appeared:3' WHEN p1 = 0 THEN 'appeared:4'
  WHEN p4 = 0 AND p3 > 0 THEN 'disappeared:4' WHEN p4 = 0 AND p2 > 0 THEN 'disappeared:3' WHEN p4 = 0 THEN 'disappeared:2'
  WHEN p1 < p2 AND p2 < p3 AND p3 < p4 THEN 'up' WHEN p1 > p2 AND p2 > p3 AND p3 > p4 THEN 'down'
  WHEN greatest(p1, p2, p3, p4) = p1 THEN CASE WHEN least(p1, p2, p3, p4) = p1 THEN 'mixed' WHEN least(p1, p2, p3, p4) = p2 THEN 'dip:2'
    WHEN least(p1, p2, p3, p4) = p3 THEN 'dip:3' ELSE 'mixed' END
  WHEN greatest(p1, p2, p3, p4) = p2 THEN 'peak:2' WHEN greatest(p1, p2, p3, p4) = p3 THEN 'peak:3'
  WHEN least(p1, p2, p3, p4) = p1 THEN 'mixed' WHEN least(p1, p2, p3, p4) = p2 THEN 'dip:2' WHEN least(p1, p2, p3, p4) = p3 THEN 'dip:3'
  ELSE 'mixed' END"""
query(
    "compare_trend_descriptions",
    lambda s: pd.describe_trends(pd.entity_matrix(_counts(s, "top_paths", "path", "path"), "path", COUNT), COUNT),
    _sql(f"SELECT name, {', '.join(_P)}, {_DESCRIPTION} AS trend FROM ({_matrix(_ALL_PATHS, 'path')})"),
)
query(
    "compare_steps",
    lambda s: pd.period_steps(_summary_of(s)),
    _sql("""SELECT period, value, previous, value - previous AS delta,
  CASE WHEN previous IS NOT NULL THEN round((value - previous)::DOUBLE / previous * 100, 6) END AS change_percent
FROM (SELECT period, count(*) AS value, lag(count(*)) OVER (ORDER BY period) AS previous FROM r GROUP BY period)"""),
)
query(
    "compare_aligned_timelines",
    lambda s: pd.align_timelines(pd.period_timeline(pd.in_periods(s.plain, _periods()), _periods()), COUNT),
    _sql(f"""SELECT bucket, {', '.join(f'max(requests) FILTER (period = {n}) AS p{n}' for n in range(1, COUNT + 1))}
FROM (SELECT period, requests, row_number() OVER (PARTITION BY period ORDER BY hour) AS bucket FROM ({_TIMELINE})) GROUP BY bucket"""),
)
for _report, _column, _source in (("status_code_distribution", "status_code", _STATUS), ("device_types", "device_type", _DEVICES)):
    query(
        f"compare_grid_{_column}",
        lambda s, report=_report, column=_column: pd.period_matrix(_BUILD[report](s), column, COUNT),
        _sql(_cells(_source, _column, "count").replace(" AS name", "")),
    )
