"""The tables of ``sample.py`` as DuckDB common table expressions."""

from __future__ import annotations

from hitledger.plans.sample import USER_AGENTS

_AGENTS = ", ".join("'" + a.replace("'", "''") + "'" for a in USER_AGENTS)


def _by_turn(*values: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "][event_id % 8 + 1]"


# Expected classification of the eight agents, written out by hand.
_BROWSER = _by_turn("Chrome", "Edge", "Safari", "Firefox", "Safari", "Chrome", "Googlebot", "cURL")
_BROWSER_VERSION = _by_turn("120.0", "120.0", "17.1", "121.0", "17.0", "120.0", "", "")
_OS = _by_turn("Windows", "Windows", "macOS", "Linux", "iOS", "Linux", "Bot", "Bot")
_OS_VERSION = _by_turn("10.0", "10.0", "10.15", "", "17.0", "", "", "")
_DEVICE = _by_turn("desktop", "desktop", "desktop", "desktop", "mobile", "mobile", "bot", "bot")

REQUESTS = f"""
country_dim AS (
  SELECT n_nationkey AS nation_id, 'N' || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', n_nationkey + 1, 1) AS code,
         n_name AS name, r_name AS continent
  FROM nation JOIN region ON n_regionkey = r_regionkey
),
http_requests AS (
  SELECT event_id AS id, e.ts AS "timestamp", user_id,
    '10.' || (user_id // 65536 % 256) || '.' || (user_id // 256 % 256) || '.' || (user_id % 256) AS client_ip,
    CASE event_type WHEN 'purchase' THEN 'POST' WHEN 'signup' THEN 'PUT' ELSE 'GET' END AS method,
    CAST(CASE event_type WHEN 'error' THEN [404, 500, 503, 403][event_id % 4 + 1]
      WHEN 'click' THEN 302 WHEN 'purchase' THEN 201 ELSE 200 END AS BIGINT) AS status_code,
    (event_id * 37) % 5000 AS response_size,
    CASE WHEN event_id % 10 = 0 THEN 0.0::DOUBLE ELSE value END AS response_time_ms,
    CASE WHEN event_id % 10 = 0 THEN 0 ELSE CAST(round(value * 1000000) AS BIGINT) END AS duration,
    strftime(e.ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS start_utc,
    event_id % 1000 AS requests_total,
    '/' || event_type || '/' || (event_id % 40) AS path,
    'page=' || (event_id % 7) AS query_string,
    'site' || (user_id % 5) || '.example.com' AS host,
    CASE WHEN event_id % 5 < 3 THEN (event_id % 7) || '-app-' || (user_id % 3) || '-service@docker' ELSE '' END AS backend_name,
    CASE WHEN event_id % 5 = 3 THEN 'http://10.1.0.' || (user_id % 4) || ':8080' ELSE '' END AS backend_url,
    CASE WHEN event_id % 3 = 0 THEN coalesce(p.url, '') ELSE '' END AS referer,
    [{_AGENTS}][event_id % 8 + 1] AS user_agent,
    {_BROWSER} AS browser, {_BROWSER_VERSION} AS browser_version, {_OS} AS os, {_OS_VERSION} AS os_version,
    {_DEVICE} AS device_type,
    CASE WHEN user_id % 11 = 0 THEN '' ELSE coalesce(c.code, '') END AS geo_country,
    'City' || (user_id % 20) AS geo_city,
    CAST(user_id % 180 - 90 AS DOUBLE) AS geo_lat, CAST(user_id % 360 - 180 AS DOUBLE) AS geo_lon,
    CASE WHEN user_id % 6 = 0 THEN 0 ELSE 64500 + user_id % 6 END AS asn,
    'ORG' || (CASE WHEN user_id % 6 = 0 THEN 0 ELSE 64500 + user_id % 6 END) AS asn_org,
    ['', 'HTTP/1.1', 'HTTP/2.0'][event_id % 3 + 1] AS protocol,
    ['', '1.2', '1.3'][event_id % 3 + 1] AS tls_version,
    CASE WHEN event_id % 3 = 0 THEN 'http' ELSE 'https' END AS request_scheme,
    'traefik-' || (event_id % 2) AS source_name
  FROM events e
  LEFT JOIN country_dim c ON c.nation_id = e.user_id % 25
  LEFT JOIN pages p ON p.page_id = e.event_id % 50
),
ip_tags AS (
  SELECT DISTINCT client_ip AS ip_address, 'user ' || user_id AS friendly_name,
    CASE WHEN user_id % 20 = 0 THEN '["vip","office"]' ELSE '["vip"]' END AS tags
  FROM http_requests WHERE user_id % 10 = 0
)"""


def base(*more: str) -> str:
    """``WITH`` clause with the request table and further expressions."""
    return "WITH " + ",\n".join([REQUESTS.strip(), *more]) + "\n"


def last(hours: int) -> str:
    return f"\"timestamp\" > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL {hours} HOUR"


AVG = "round(coalesce(avg(CASE WHEN response_time_ms > 0 THEN response_time_ms END), 0), 6) AS avg_response_time"
AVG_ALL = "round(coalesce(avg(response_time_ms), 0), 6) AS avg_response_time"
HITS = "count(*) AS hits"
VISITORS = "count(DISTINCT client_ip) AS unique_visitors"
BYTES = "CAST(coalesce(sum(response_size), 0) AS BIGINT) AS bandwidth"
TOTAL_BYTES = "CAST(coalesce(sum(response_size), 0) AS BIGINT) AS total_bandwidth"
STATUS_CLASSES = """count(*) FILTER (status_code BETWEEN 200 AND 299) AS status_2xx,
  count(*) FILTER (status_code BETWEEN 300 AND 399) AS status_3xx,
  count(*) FILTER (status_code BETWEEN 400 AND 499) AS status_4xx, count(*) FILTER (status_code >= 500) AS status_5xx"""
SERVICE = "coalesce(nullif(backend_name, ''), nullif(backend_url, ''), nullif(host, ''), 'unknown')"
SERVICE_TYPE = "CASE WHEN backend_name <> '' THEN 'backend_name' WHEN backend_url <> '' THEN 'backend_url' WHEN host <> '' THEN 'host' ELSE 'unknown' END"

HOUR = "strftime(\"timestamp\", '%Y-%m-%dT%H:00:00Z')"
SIX = "strftime(\"timestamp\", '%Y-%m-%dT') || lpad(CAST(hour(\"timestamp\") // 6 * 6 AS VARCHAR), 2, '0') || ':00:00Z'"
DAY = "strftime(\"timestamp\", '%Y-%m-%dT00:00:00Z')"
MONTH = "strftime(\"timestamp\", '%Y-%m')"
WEEK = "strftime(\"timestamp\", '%Y-W%W')"
DOW = "CAST(dayofweek(\"timestamp\") AS BIGINT)"
HOUR_NO = "CAST(hour(\"timestamp\") AS BIGINT)"


HASH = """sha256(concat_ws('|', epoch_us("timestamp") // 1000000, client_ip, method, host, path, query_string, status_code, duration, start_utc, requests_total))"""


def stamp(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def pct(part: str, whole: str = "count(*)") -> str:
    return f"round(CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / {whole} * 100 ELSE 0 END, 6)"
