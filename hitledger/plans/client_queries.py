"""Queries per client address, over all clients unless the name says otherwise."""

from __future__ import annotations

from hitledger.functions.predicates import Scope
from hitledger.operators import clients
from hitledger.plans.catalog import query
from hitledger.plans.report_queries import ALL, DAY_SCOPE, FILTERED, FILTERED_SQL, MONTH_SCOPE, WEEK
from hitledger.plans.sample import AS_OF
from hitledger.plans.sample_sql import (
    AVG, AVG_ALL, BYTES, DAY, DOW, HASH, HITS, HOUR, HOUR_NO, SIX, TOTAL_BYTES, WEEK as WEEK_LABEL, base, last, pct, stamp,
)

_OK, _BAD = "count(*) FILTER (status_code BETWEEN 200 AND 399)", "count(*) FILTER (status_code >= 400)"


def _profile_sql(where: str, backends: str = "{}", paths: str = "{}") -> str:
    profile = f"""profile AS (SELECT client_ip AS ip_address, count(*) AS total_requests,
  {stamp('min("timestamp")')} AS first_seen, {stamp('max("timestamp")')} AS last_seen, max(geo_country) AS geo_country,
  max(geo_city) AS geo_city, max(geo_lat) AS geo_lat, max(geo_lon) AS geo_lon, max(asn) AS asn, max(asn_org) AS asn_org,
  {TOTAL_BYTES}, {AVG}, {pct(_OK)} AS success_rate, {pct(_BAD)} AS error_rate,
  {backends.format("count(DISTINCT CASE WHEN backend_name <> '' THEN backend_name END)")} AS unique_backends,
  {paths.format("count(DISTINCT path)")} AS unique_paths
  FROM http_requests WHERE {where} GROUP BY client_ip)"""
    return base(profile) + """SELECT p.*, coalesce(t.friendly_name, '') AS friendly_name, coalesce(t.tags, '') AS tags
FROM profile p LEFT JOIN ip_tags t USING (ip_address)"""


query("ip_stats", lambda s: clients.ip_stats(s.placed, None, WEEK, tags=s.tags), _profile_sql(last(168)))
query(
    "ip_stats_one",
    lambda s: clients.ip_stats(s.placed, "10.0.0.10", ALL, tags=s.tags),
    _profile_sql("client_ip = '10.0.0.10'"),
)
query(
    "ip_stats_capped",
    lambda s: clients.ip_stats(s.placed, None, ALL, tags=s.tags, most_backends=100, most_paths=500),
    _profile_sql("true", "least({}, 100)", "least({}, 500)"),
)
for _label, _scope, _unit, _where in (
    ("day", DAY_SCOPE, HOUR, last(24)),
    ("week", WEEK, SIX, last(168)),
    ("month", MONTH_SCOPE, DAY, last(720)),
    ("all_time", ALL, WEEK_LABEL, "true"),
):
    query(
        f"ip_timeline_{_label}",
        lambda s, scope=_scope: clients.ip_timeline(s.plain, None, scope),
        base() + f"""SELECT client_ip AS ip_address, {_unit} AS hour, count(*) AS requests,
  count(DISTINCT backend_name) AS unique_visitors, {BYTES}, {AVG} FROM http_requests WHERE {_where} GROUP BY 1, 2""",
    )
query(
    "ip_heatmap",
    lambda s: clients.ip_heatmap(s.plain, None, ALL, days=0),
    base() + f"""SELECT client_ip AS ip_address, {DOW} AS day_of_week, {HOUR_NO} AS hour, count(*) AS requests, {AVG_ALL}
FROM http_requests GROUP BY 1, 2, 3""",
)


def _ranked_sql(select: str, where: str, group: str, order: str, limit: int | None) -> str:
    best = f" QUALIFY row_number() OVER (PARTITION BY client_ip ORDER BY {order}) <= {limit}" if limit else ""
    return base() + f"SELECT client_ip AS ip_address, {select} FROM http_requests WHERE {where} GROUP BY client_ip, {group}{best}"


query(
    "ip_top_paths",
    lambda s: clients.ip_top_paths(s.plain, None, WEEK, 5),
    _ranked_sql(
        f"""path, {HITS}, CAST(1 AS BIGINT) AS unique_visitors, {AVG}, {TOTAL_BYTES}, max(host) AS host,
  max(backend_name) AS backend_name, max(backend_url) AS backend_url""",
        last(168), "path", "count(*) DESC, path", 5,
    ),
)
query(
    "ip_top_backends",
    lambda s: clients.ip_top_backends(s.plain, None, ALL, 3),
    _ranked_sql(
        f"backend_name, max(backend_url) AS backend_url, {HITS}, {BYTES}, {AVG_ALL}, count(*) FILTER (status_code >= 500) AS error_count",
        "backend_name <> ''", "backend_name", "count(*) DESC, backend_name", 3,
    ),
)
for _name, _column, _test, _limit in (
    ("ip_status_distribution", "status_code", "true", None),
    ("ip_top_browsers", "browser", "browser NOT IN ('', 'Unknown')", 3),
    ("ip_top_operating_systems", "os", "os NOT IN ('', 'Unknown')", 3),
    ("ip_device_distribution", "device_type", "device_type <> ''", None),
):
    query(
        _name,
        lambda s, column=_column, limit=_limit: clients.ip_distribution(s.plain, None, FILTERED, column, limit or 0),
        _ranked_sql(f"{_column}, count(*) AS count", f"{FILTERED_SQL} AND {_test}", _column, f"count(*) DESC, {_column}", _limit),
    )

_RANKED = ", ".join(
    f"list_sort(list(response_time_ms))[CAST(count(*) * {p} // 100 AS BIGINT) + 1] AS p{p}" for p in (50, 95, 99)
)
query(
    "ip_response_time_stats",
    lambda s: clients.ip_response_time_stats(s.plain, None, ALL),
    base() + f"""SELECT client_ip AS ip_address, min(response_time_ms) AS min, max(response_time_ms) AS max,
  round(avg(response_time_ms), 6) AS avg, {_RANKED} FROM http_requests WHERE response_time_ms > 0 GROUP BY client_ip""",
)
query(
    "ip_recent_requests",
    lambda s: clients.ip_recent_requests(s.identified, None, WEEK, 5).select("ip_address", "request_hash", "timestamp", "path", "status_code"),
    base() + f"""SELECT client_ip AS ip_address, {HASH} AS request_hash, {stamp('"timestamp"')} AS "timestamp", path, status_code FROM http_requests
WHERE {last(168)} QUALIFY row_number() OVER (PARTITION BY client_ip ORDER BY http_requests."timestamp" DESC, {HASH} DESC) <= 5""".replace(
        'WHERE "timestamp"', 'WHERE http_requests."timestamp"'
    ),
)
query(
    "ip_bot_share",
    lambda s: clients.ip_bot_share(s.plain, None, ALL),
    base() + f"""SELECT client_ip AS ip_address, count(*) FILTER (device_type = 'bot') AS bot_requests, count(*) AS total_requests,
  {pct("count(*) FILTER (device_type = 'bot')")} AS bot_percent FROM http_requests WHERE device_type <> '' GROUP BY 1""",
)
query(
    "threat_level",
    lambda s: clients.threat_level(s.plain, Scope(AS_OF, 48)),
    base() + f"""SELECT client_ip AS ip_address, count(*) AS total_requests, {_BAD} AS failed_requests, {pct(_BAD)} AS error_rate,
  CASE WHEN {pct(_BAD)} > 50 THEN 'High' WHEN {pct(_BAD)} > 20 THEN 'Medium' ELSE 'Low' END AS threat_level
FROM http_requests WHERE {last(48)} GROUP BY 1""",
)
