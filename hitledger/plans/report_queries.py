"""Queries for summaries, rankings, distributions, services, places and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from hitledger.functions.predicates import DrillDown, Exclusion, Scope, Service
from hitledger.operators import cleaning, clients, geo, latency, rankings, rows, services, summary, timelines
from hitledger.plans.catalog import query
from hitledger.plans.sample import AS_OF
from hitledger.plans.sample_sql import (
    AVG, AVG_ALL, BYTES, DAY, DOW, HITS, HOUR, HOUR_NO, MONTH, SERVICE, SERVICE_TYPE, SIX, STATUS_CLASSES,
    HASH, TOTAL_BYTES, VISITORS, base, last, pct, stamp,
)
from hitledger.schema import conform
from hitledger.session import shared_dir
from hitledger.sources import sinks

ALL = Scope(AS_OF, 0)
DAY_SCOPE, WEEK, MONTH_SCOPE = Scope(AS_OF, 24), Scope(AS_OF, 168), Scope(AS_OF, 720)

SHOP = "2-app-1-service@docker"
FILTERED = Scope(
    AS_OF,
    168,
    services=(Service(SHOP, "backend_name"), Service("http://10.1.0.2:8080", "backend_url"), Service("site3.example.com")),
    exclude=Exclusion(("10.0.0.7", "10.0.0.13"), (Service("site3.example.com", "host"),)),
)
_AUTO = "(backend_name = 'site3.example.com' OR (backend_name = '' AND backend_url = 'site3.example.com') OR (backend_name = '' AND backend_url = '' AND host = 'site3.example.com'))"
FILTERED_SQL = f"""{last(168)} AND (backend_name = '{SHOP}' OR backend_url = 'http://10.1.0.2:8080' OR {_AUTO})
  AND NOT (client_ip IN ('10.0.0.7', '10.0.0.13') AND host = 'site3.example.com')"""
BLOCKED = Scope(AS_OF, 168, exclude=Exclusion(("10.0.0.1", "10.0.0.2", "10.0.0.3")))
BLOCKED_SQL = f"{last(168)} AND client_ip NOT IN ('10.0.0.1', '10.0.0.2', '10.0.0.3')"


# --- whole-table figures ---

def _summary_sql(where: str, hours: str) -> str:
    return base() + f"""SELECT count(*) AS total_requests,
  count(*) FILTER (status_code >= 200 AND status_code < 400) AS valid_requests,
  count(*) FILTER (status_code >= 400) AS failed_requests, {VISITORS}, count(DISTINCT path) AS unique_files,
  count(DISTINCT CASE WHEN status_code = 404 THEN path END) AS unique_404, {TOTAL_BYTES}, {AVG},
  {pct("count(*) FILTER (status_code >= 200 AND status_code < 400)")} AS success_rate,
  {pct("count(*) FILTER (status_code = 404)")} AS not_found_rate,
  {pct("count(*) FILTER (status_code >= 500 AND status_code < 600)")} AS server_error_rate,
  round(count(*) / CAST({hours} AS DOUBLE), 6) AS requests_per_hour
FROM http_requests WHERE {where}"""


_SPAN = "greatest((epoch_us(max(\"timestamp\")) - epoch_us(min(\"timestamp\"))) / 3600000000.0, 1)"
query("summary_week", lambda s: summary.summary(s.plain, WEEK), _summary_sql(last(168), "168"))
query("summary_all_time", lambda s: summary.summary(s.plain, ALL), _summary_sql("true", _SPAN))
query("summary_filtered", lambda s: summary.summary(s.plain, FILTERED), _summary_sql(FILTERED_SQL, "168"))
query("summary_without_clients", lambda s: summary.summary(s.plain, BLOCKED), _summary_sql(BLOCKED_SQL, "168"))
query(
    "summary_excluding_table",
    lambda s: summary.summary(s.plain, Scope(AS_OF, 168, exclude=Exclusion(s.tags.selectExpr("ip_address AS client_ip")))),
    _summary_sql(f"{last(168)} AND client_ip NOT IN (SELECT ip_address FROM ip_tags)", "168"),
)

_BAD = "count(*) FILTER (status_code = 404 OR (status_code >= 500 AND status_code < 600))"
_LIGHT = f"CASE WHEN {pct(_BAD)} > 5 THEN 'danger' WHEN {pct(_BAD)} > 1 THEN 'warning' ELSE 'healthy' END AS status"
query(
    "health_widget",
    lambda s: summary.health_widget(s.plain, ALL),
    base() + f"""SELECT {_LIGHT}, round(count(*) / 60.0, 6) AS requests_per_minute, {pct(_BAD)} AS error_rate, {AVG},
  round(coalesce(sum(response_size), 0) / 60.0, 6) AS bandwidth_per_minute, count(DISTINCT client_ip) AS unique_ips
FROM http_requests WHERE {last(1)}""",
)
query(
    "widget_summary",
    lambda s: summary.widget_summary(s.plain, MONTH_SCOPE),
    base() + f"""SELECT {_LIGHT}, count(*) AS total_requests, round(count(*) / 720.0::DOUBLE, 6) AS requests_per_hr,
  {pct(_BAD)} AS error_rate, {AVG.replace("avg_response_time", "avg_response_ms")}, count(DISTINCT client_ip) AS unique_ips,
  round(coalesce(sum(response_size), 0) / 1048576.0::DOUBLE, 6) AS bandwidth_mb
FROM http_requests WHERE {last(720)}""",
)
query(
    "record_time_range",
    lambda s: summary.record_time_range(s.plain),
    base() + f"SELECT {stamp('min(\"timestamp\")')} AS oldest, {stamp('max(\"timestamp\")')} AS newest FROM http_requests",
)
query("count_records", lambda s: summary.count_records(s.plain), base() + "SELECT count(*) AS records FROM http_requests")
query(
    "count_by_source",
    lambda s: summary.count_by_source(s.plain),
    base() + "SELECT source_name, count(*) AS records FROM http_requests GROUP BY 1",
)
query(
    "count_of_source",
    lambda s: summary.count_by_source(s.plain, "traefik-1"),
    base() + "SELECT source_name, count(*) AS records FROM http_requests WHERE source_name = 'traefik-1' GROUP BY 1",
)
query("has_data", lambda s: summary.has_data(s.plain), base() + "SELECT count(*) > 0 AS has_data FROM http_requests")
query(
    "count_older_than",
    lambda s: summary.count_older_than(s.plain, "2024-01-10 06:00:00"),
    base() + "SELECT count(*) AS records FROM http_requests WHERE \"timestamp\" < TIMESTAMP '2024-01-10 06:00:00'",
)


def _age_sql(moment: str) -> str:
    def unit(value: str, name: str) -> str:
        return f"({value}) || ' {name}' || CASE WHEN ({value}) = 1 THEN '' ELSE 's' END"

    def pair(a: str, an: str, b: str, bn: str) -> str:
        return f"{unit(a, an)} || CASE WHEN ({b}) > 0 THEN ', ' || {unit(b, bn)} ELSE '' END"

    secs = f"((1706659200000000 - epoch_us({moment})) // 1000000)"
    d, h, m, sec = f"{secs} // 86400", f"{secs} // 3600 % 24", f"{secs} // 60 % 60", f"{secs} % 60"
    return f"""CASE WHEN {d} > 0 THEN {pair(d, 'day', h, 'hour')} WHEN {h} > 0 THEN {pair(h, 'hour', m, 'minute')}
  WHEN {m} > 0 THEN {pair(m, 'minute', sec, 'second')} ELSE {unit(sec, 'second')} END"""


query(
    "system_stats",
    lambda s: summary.system_stats(s.plain, as_of=AS_OF, retention_days=14),
    base() + f"""SELECT count(*) AS total_records,
  count(*) FILTER ("timestamp" < TIMESTAMP '2024-01-17 00:00:00') AS records_to_cleanup, CAST(14 AS BIGINT) AS retention_days,
  {_age_sql('min("timestamp")')} AS oldest_record_age, {_age_sql('max("timestamp")')} AS newest_record_age
FROM http_requests""",
)

# --- rankings ---


def _grouped(select: str, where: str, group: str, order: str, limit: int | None) -> str:
    tail = f" LIMIT {limit}" if limit else ""
    return base() + f"SELECT {select} FROM http_requests WHERE {where} GROUP BY {group} ORDER BY {order}{tail}"


for _name, _scope, _where in (("top_paths", ALL, "true"), ("top_paths_filtered", FILTERED, FILTERED_SQL)):
    query(
        _name,
        lambda s, scope=_scope: rankings.top_paths(s.plain, scope, 20),
        _grouped(f"path, {HITS}, {VISITORS}, {AVG}, {TOTAL_BYTES}", _where, "path", "hits DESC, path", 20),
    )
for _name, _slowest, _dir in (("slow_paths", True, "DESC"), ("fast_paths", False, "ASC")):
    query(
        _name,
        lambda s, slowest=_slowest: rankings.path_times(s.plain, ALL, slowest=slowest),
        _grouped(
            f"path, {HITS}, {AVG}, {TOTAL_BYTES}", "true", "path",
            f"coalesce(avg(CASE WHEN response_time_ms > 0 THEN response_time_ms END), 0) {_dir}, path", 10,
        ),
    )
query(
    "top_countries",
    lambda s: rankings.top_countries(s.placed, WEEK, 10),
    _grouped(f"geo_country AS country, {HITS}, {VISITORS}, {BYTES}", f"{last(168)} AND geo_country <> ''", "1", "hits DESC, country", 10),
)
query(
    "all_countries",
    lambda s: rankings.top_countries(s.placed, ALL, 0),
    _grouped(f"geo_country AS country, {HITS}, {VISITORS}, {BYTES}", "geo_country <> ''", "1", "hits DESC, country", None),
)

_IP_COLS = f"""client_ip AS ip_address, max(geo_country) AS country, max(geo_city) AS city, max(geo_lat) AS latitude,
  max(geo_lon) AS longitude, {HITS}, {BYTES}"""


def _top_ips_sql(where: str, order: str, limit: int) -> str:
    ranked = f"ranked AS (SELECT {_IP_COLS} FROM http_requests WHERE {where} GROUP BY client_ip ORDER BY {order} DESC, ip_address LIMIT {limit})"
    return base(ranked) + """SELECT r.*, coalesce(t.friendly_name, '') AS friendly_name, coalesce(t.tags, '') AS tags
FROM ranked r LEFT JOIN ip_tags t USING (ip_address)"""


query("top_ips", lambda s: rankings.top_ips(s.placed, ALL, 25, tags=s.tags), _top_ips_sql("true", "hits", 25))
query(
    "top_ips_by_bandwidth",
    lambda s: rankings.top_ips(s.placed, WEEK, 25, tags=s.tags, sort="bandwidth"),
    _top_ips_sql(last(168), "bandwidth", 25),
)
query(
    "top_ips_tagged",
    lambda s: rankings.top_ips(s.placed, ALL, 25, tags=s.tags, tag="OFFICE"),
    _top_ips_sql("client_ip IN (SELECT ip_address FROM ip_tags WHERE lower(tags) LIKE '%office%')", "hits", 25),
)
query(
    "top_ips_drill_down",
    lambda s: rankings.top_ips(s.placed, ALL, 25, tags=s.tags, drill=DrillDown(country="NC", device_type="DESKTOP", day_of_week=3)),
    _top_ips_sql(f"geo_country = 'NC' AND device_type = 'desktop' AND {DOW} = 3", "hits", 25),
)
query(
    "top_ips_network_hour",
    lambda s: rankings.top_ips(s.placed, ALL, 25, tags=s.tags, drill=DrillDown(asn=64502, hour=13)),
    _top_ips_sql(f"asn = 64502 AND {HOUR_NO} = 13", "hits", 25),
)
query(
    "search_ips",
    lambda s: rankings.search_ips(s.placed, "0.1", as_of=AS_OF, limit=50),
    _grouped(
        f"client_ip AS ip_address, {HITS}, max(geo_country) AS country, max(geo_city) AS city, {stamp('max(\"timestamp\")')} AS last_seen",
        f"{last(168)} AND client_ip LIKE '%0.1%'", "client_ip", "hits DESC, ip_address", 50,
    ),
)
query(
    "hot_ips",
    lambda s: rankings.hot_ips(s.plain, as_of=AS_OF, limit=1_000),
    base() + f"""SELECT client_ip, count(*) AS repetition FROM http_requests WHERE {last(168)}
GROUP BY 1 HAVING count(*) > 5 ORDER BY repetition DESC, client_ip LIMIT 1000""",
)

for _name, _column, _test, _limit in (
    ("status_code_distribution", "status_code", "true", None),
    ("method_distribution", "method", "true", None),
    ("protocol_distribution", "protocol", "protocol <> ''", None),
    ("tls_version_distribution", "tls_version", "tls_version <> ''", None),
    ("device_type_distribution", "device_type", "device_type <> ''", None),
    ("top_user_agents", "user_agent", "user_agent <> ''", 5),
    ("top_browsers", "browser", "browser NOT IN ('', 'Unknown')", 5),
    ("top_operating_systems", "os", "os NOT IN ('', 'Unknown')", 5),
):
    query(
        _name,
        lambda s, column=_column, limit=_limit: rankings.distribution(s.plain, WEEK, column, limit or 0),
        _grouped(f"{_column}, count(*) AS count", f"{last(168)} AND {_test}", _column, f"count DESC, {_column}", _limit),
    )
query(
    "top_asns",
    lambda s: rankings.top_asns(s.placed, ALL, 10),
    _grouped(f"asn, max(asn_org) AS asn_org, {HITS}, {BYTES}, max(geo_country) AS country", "asn > 0", "asn", "hits DESC, asn", 10),
)
query(
    "top_referrers",
    lambda s: rankings.top_referrers(s.referred, ALL, 15),
    _grouped(f"referer AS referrer, {HITS}, {VISITORS}", "referer <> ''", "1", "hits DESC, referrer", 15),
)
_DOMAIN = """hosts AS (
  SELECT client_ip, lower(replace(split_part(
    CASE WHEN referer ILIKE 'http://%' THEN substr(referer, 8) WHEN referer ILIKE 'https://%' THEN substr(referer, 9)
         WHEN referer LIKE '//%' THEN substr(referer, 3) ELSE referer END, '/', 1), 'www.', '')) AS h
  FROM http_requests WHERE referer <> '' AND referer NOT ILIKE 'file:%')"""
query(
    "top_referrer_domains",
    lambda s: rankings.top_referrer_domains(s.referred, ALL, 15),
    base(_DOMAIN) + f"""SELECT split_part(h, ':', 1) AS domain, {HITS}, {VISITORS} FROM hosts
WHERE h <> '' AND h NOT LIKE '%@%' GROUP BY 1 ORDER BY hits DESC, domain LIMIT 15""",
)
query(
    "method_share",
    lambda s: rankings.with_share(rankings.distribution(s.plain, ALL, "method"), "count"),
    base() + """SELECT method, count(*) AS count, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM http_requests), 6) AS share
FROM http_requests GROUP BY method""",
)
query(
    "country_engagement",
    lambda s: rankings.country_engagement(s.placed, ALL),
    base(f"by_country AS (SELECT geo_country AS country, {VISITORS}, {HITS} FROM http_requests WHERE geo_country <> '' GROUP BY 1)")
    + """SELECT country, unique_visitors, hits, round(hits / unique_visitors::DOUBLE, 6) AS avg_hits,
  round(unique_visitors * 100.0::DOUBLE / (SELECT sum(unique_visitors) FROM by_country), 6) AS visitor_share FROM by_country""",
)
query(
    "referral_share",
    lambda s: rankings.referral_share(s.referred, ALL),
    base() + f"""SELECT count(*) FILTER (referer <> '') AS referrals, count(*) AS total_requests,
  {pct("count(*) FILTER (referer <> '')")} AS referral_share FROM http_requests""",
)
_HUMAN, _BOT = "count(*) FILTER (device_type IN ('desktop', 'mobile', 'tablet'))", "count(*) FILTER (device_type = 'bot')"
query(
    "bot_share",
    lambda s: rankings.bot_share(s.plain, ALL),
    base() + f"""SELECT {_HUMAN} AS human_requests, {_BOT} AS bot_requests, count(*) - {_HUMAN} - {_BOT} AS unknown_requests,
  {pct(_HUMAN)} AS human_percent, {pct(_BOT)} AS bot_percent, {pct(f"(count(*) - {_HUMAN} - {_BOT})")} AS unknown_percent
FROM http_requests WHERE device_type <> ''""",
)
query(
    "platform_share",
    lambda s: rankings.platform_share(s.plain, ALL),
    base() + "SELECT " + ", ".join(f"{pct(f'count(*) FILTER (device_type = {k!r})', _HUMAN)} AS {k}_percent" for k in ("desktop", "mobile", "tablet"))
    + " FROM http_requests",
)

# --- services ---

_BACKENDS = f"""backends AS (
  SELECT {SERVICE} AS backend_name, CASE WHEN {SERVICE_TYPE} = 'host' THEN '' ELSE max(backend_url) END AS backend_url,
    max(host) AS host, {SERVICE_TYPE} AS service_type, {HITS}, {BYTES}, count(*) FILTER (status_code >= 500) AS error_count,
    coalesce(avg(CASE WHEN response_time_ms > 0 THEN response_time_ms END), 0) AS art
  FROM http_requests GROUP BY {SERVICE}, {SERVICE_TYPE})"""
_ERR = "(error_count * 100.0::DOUBLE / hits)"
query(
    "top_backends",
    lambda s: services.top_backends(s.plain, ALL, 15),
    base(_BACKENDS) + "SELECT * EXCLUDE (art) FROM backends ORDER BY hits DESC, backend_name, service_type LIMIT 15",
)
query(
    "services",
    lambda s: services.services(s.plain),
    base(_BACKENDS) + "SELECT backend_name AS name, service_type AS type, hits AS count FROM backends",
)
query(
    "domains",
    lambda s: services.domains(s.plain),
    base() + """SELECT 'app ' || (user_id % 3) AS host, count(*) AS count FROM http_requests WHERE backend_name <> '' GROUP BY 1""",
)
query(
    "backend_health",
    lambda s: services.backend_health(s.plain, ALL),
    base(_BACKENDS) + f"""SELECT backend_name, service_type, hits, bandwidth, error_count, round(art, 6) AS avg_response_time,
  round({_ERR}, 6) AS error_percent,
  CASE WHEN {_ERR} > 10 OR art > 1000 THEN 'critical' WHEN {_ERR} > 5 OR art > 500 THEN 'degraded' ELSE 'healthy' END AS status,
  round(greatest(0, least(100, 100 - {_ERR} / 100 * 50 - CASE WHEN art > 1000 THEN 30 WHEN art > 500 THEN 15 WHEN art > 200 THEN 5 ELSE 0 END)), 6) AS health_score
FROM backends""",
)
query(
    "backend_totals",
    lambda s: services.backend_totals(s.plain, ALL),
    base(_BACKENDS) + """SELECT count(*) AS total_backends, CAST(sum(hits) AS BIGINT) AS total_requests, round(avg(art), 6) AS avg_response_time,
  round(sum(error_count) * 100.0::DOUBLE / sum(hits), 6) AS error_percent FROM backends""",
)

# --- places ---

query(
    "top_cities",
    lambda s: geo.top_cities(s.placed, ALL, 50),
    base() + f"""SELECT geo_city AS city, geo_country AS country, arg_min(geo_lat, client_ip) AS latitude, arg_min(geo_lon, client_ip) AS longitude,
  {HITS}, {BYTES} FROM http_requests WHERE geo_city <> '' AND geo_lat <> 0 AND geo_lon <> 0
GROUP BY 1, 2 ORDER BY hits DESC, city, country LIMIT 50""",
)
query(
    "continent_distribution",
    lambda s: geo.continent_distribution(s.placed, ALL, s.countries),
    base() + """SELECT coalesce(continent, 'Other') AS continent, count(*) AS hits
FROM http_requests LEFT JOIN country_dim ON code = geo_country WHERE geo_country <> '' GROUP BY 1""",
)
_N = "count(DISTINCT geo_country) FILTER (geo_country <> '')"
query(
    "geo_insights",
    lambda s: geo.geo_insights(s.placed, ALL, s.countries),
    base() + f"""SELECT {_N} AS countries, count(DISTINCT continent) AS continents,
  count(DISTINCT geo_city || '-' || geo_country) FILTER (geo_city <> '') AS cities, round({_N} / 195.0::DOUBLE * 100, 6) AS world_percent,
  CASE WHEN {_N} > 50 THEN 'Global' WHEN {_N} > 20 THEN 'Continental' WHEN {_N} > 5 THEN 'Multi-Regional' ELSE 'Regional' END AS spread
FROM http_requests LEFT JOIN country_dim ON code = geo_country""",
)
query(
    "country_names",
    lambda s: geo.with_country_names(rankings.top_countries(s.placed, WEEK, 0), s.countries),
    base() + f"""SELECT geo_country AS country, {HITS}, {VISITORS}, {BYTES}, max(name) AS country_name, max(continent) AS continent
FROM http_requests JOIN country_dim ON code = geo_country WHERE {last(168)} GROUP BY 1""",
)

# --- time ---

_POINT = f"count(*) AS requests, {VISITORS}, {BYTES}, {AVG_ALL}"
for _label, _scope, _unit, _where in (
    ("day", DAY_SCOPE, HOUR, last(24)),
    ("week", WEEK, SIX, last(168)),
    ("month", MONTH_SCOPE, DAY, last(720)),
    ("all_time", ALL, MONTH, "true"),
):
    query(
        f"timeline_{_label}",
        lambda s, scope=_scope: timelines.timeline(s.plain, scope),
        base() + f"SELECT {_unit} AS hour, {_POINT} FROM http_requests WHERE {_where} GROUP BY 1",
    )
    query(
        f"status_timeline_{_label}",
        lambda s, scope=_scope: timelines.status_timeline(s.plain, scope),
        base() + f"SELECT {DAY if _label == 'week' else _unit} AS hour, {STATUS_CLASSES} FROM http_requests WHERE {_where} GROUP BY 1",
    )
query(
    "traffic_heatmap",
    lambda s: timelines.traffic_heatmap(s.plain, ALL, days=30),
    base() + f"SELECT {DOW} AS day_of_week, {HOUR_NO} AS hour, count(*) AS requests, {AVG} FROM http_requests WHERE {last(720)} GROUP BY 1, 2",
)
query(
    "records_timeline",
    lambda s: timelines.records_timeline(s.plain, as_of=AS_OF, days=20),
    base() + f"SELECT {DAY} AS hour, count(*) AS requests FROM http_requests WHERE {last(480)} GROUP BY 1",
)
query(
    "hour_profile",
    lambda s: timelines.hour_profile(s.plain, ALL, days=7),
    base() + f"""SELECT range AS hour, (SELECT count(*) FROM http_requests WHERE {last(168)} AND {HOUR_NO} = range) AS requests FROM range(24)""",
)
query(
    "weekday_profile",
    lambda s: timelines.weekday_profile(s.plain, ALL, days=5),
    base() + f"""SELECT range AS day_of_week, (SELECT count(*) FROM http_requests WHERE {last(120)} AND {DOW} = range) AS requests FROM range(7)""",
)
query(
    "peak_bucket",
    lambda s: timelines.peak_bucket(s.plain, WEEK),
    base() + f"SELECT {SIX} AS hour, count(*) AS requests FROM http_requests WHERE {last(168)} GROUP BY 1 ORDER BY requests DESC, hour LIMIT 1",
)
query(
    "widget_timeline",
    lambda s: timelines.widget_timeline(s.plain, WEEK, points=50),
    base() + f"SELECT {SIX} AS hour, count(*) AS requests, {BYTES}, {AVG_ALL} FROM http_requests WHERE {last(168)} GROUP BY 1 ORDER BY 1 DESC LIMIT 50",
)

# --- response times ---


def _rank(p: float, offset: str) -> str:
    return f"list_sort(list(response_time_ms))[CAST(floor({offset.format(p=p)}) AS BIGINT) + 1]"


_OVERALL = "(count(*) - 1) * {p}::DOUBLE"
_PERCENTILES = ", ".join(f"{_rank(p, _OVERALL)} AS p{int(p * 100)}" for p in (0.5, 0.95, 0.99))
for _name, _scope, _where in (("response_time_stats", ALL, "true"), ("response_time_stats_filtered", FILTERED, FILTERED_SQL)):
    query(
        _name,
        lambda s, scope=_scope: latency.response_time_stats(s.plain, scope),
        base() + f"""SELECT min(response_time_ms) AS min, max(response_time_ms) AS max, round(avg(response_time_ms), 6) AS avg, {_PERCENTILES}
FROM http_requests WHERE response_time_ms > 0 AND {_where}""",
    )
query("response_time_stats_approximate", lambda s: latency.response_time_stats(s.plain, ALL, approximate=True))


def _rank_errors(s):
    """Whether each approximate percentile stands within one percent of the rows of its rank."""
    sketch = latency.response_time_stats(s.plain, ALL, approximate=True)
    n, t = F.count(F.lit(1)), F.col("response_time_ms")
    within = []
    for name, rank in (("p50", 0.50), ("p95", 0.95), ("p99", 0.99)):
        value = sketch.select(name).scalar()
        within.append(((F.count_if(t < value) <= (rank + 0.01) * n) & (F.count_if(t <= value) >= (rank - 0.01) * n)).alias(f"{name}_within"))
    return s.plain.filter("response_time_ms > 0").agg(*within)


query("response_time_rank_errors", _rank_errors, "SELECT true AS p50_within, true AS p95_within, true AS p99_within")


def _bucket_sql(source: str) -> str:
    def w(test: str) -> str:
        return f"CAST(coalesce(sum(w) FILTER ({test}), 0) AS BIGINT)"

    goals = ", ".join(f"round({w(f't < {g}')} * 100.0::DOUBLE / sum(w), 6) AS goal_{g}_percent" for g in (100, 500, 1000))
    return base(f"points AS ({source})") + f"""SELECT {w('t < 100')} AS fast_requests, {w('t >= 100 AND t < 1000')} AS moderate_requests,
  {w('t >= 1000 AND t < 2000')} AS slow_requests, {w('t >= 2000')} AS very_slow_requests, CAST(sum(w) AS BIGINT) AS total_requests, {goals} FROM points"""


query(
    "latency_buckets",
    lambda s: latency.latency_buckets(s.plain, ALL),
    _bucket_sql("SELECT response_time_ms AS t, 1 AS w FROM http_requests WHERE response_time_ms > 0").replace(
        " FROM points", ", (SELECT count(*) FROM http_requests WHERE response_time_ms <= 0) AS unmeasured_requests FROM points"
    ),
)
query(
    "latency_buckets_of_timeline",
    lambda s: latency.latency_buckets(s.plain, WEEK, from_timeline=True),
    _bucket_sql(f"SELECT avg(response_time_ms) AS t, count(*) AS w FROM http_requests WHERE {last(168)} GROUP BY {SIX}").replace(
        " FROM points", ", CAST(0 AS BIGINT) AS unmeasured_requests FROM points"
    ),
)

# --- single rows ---

_ROW = ["request_hash", "timestamp", "client_ip", "method", "path", "status_code", "response_size", "source_name"]
_ROW_SQL = f"{HASH} AS request_hash, {stamp('\"timestamp\"')} AS \"timestamp\", client_ip, method, path, status_code, response_size, source_name"
_NEWEST = 'ORDER BY http_requests."timestamp" DESC, ' + HASH + " DESC"
query(
    "recent_requests",
    lambda s: rows.recent_requests(s.identified.select(*_ROW, "backend_name", "backend_url", "host"), FILTERED, limit=50, offset=5).select(*_ROW),
    base() + f"SELECT {_ROW_SQL} FROM http_requests WHERE {FILTERED_SQL} {_NEWEST} LIMIT 50 OFFSET 5",
)
query(
    "find_by_source",
    lambda s: rows.find_by_source(s.identified.select(*_ROW), "traefik-0", 40),
    base() + f"SELECT {_ROW_SQL} FROM http_requests WHERE source_name = 'traefik-0' {_NEWEST} LIMIT 40",
)
query(
    "find_by_time_range",
    lambda s: rows.find_by_time_range(s.identified.select(*_ROW), "2024-01-08", "2024-01-09 12:00:00", 100),
    base() + f"""SELECT {_ROW_SQL} FROM http_requests
WHERE http_requests."timestamp" BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-09 12:00:00' {_NEWEST} LIMIT 100""",
)


def _some_hash(s) -> str:
    return s.identified.filter("id = 421").first()["request_hash"]


query(
    "find_by_hash",
    lambda s: rows.find_by_hash(s.identified.select(*_ROW), _some_hash(s)),
    base() + f"SELECT {_ROW_SQL} FROM http_requests WHERE id = 421",
)

# --- the same on the stored table, every column that the sample sets ---

_STORED = [
    "request_hash", "timestamp", "partition_key", "source_name", "client_ip", "method", "protocol", "host", "path", "query_string", "request_scheme",
    "status_code", "response_size", "response_time_ms", "duration", "start_utc", "requests_total", "user_agent", "browser", "browser_version", "os",
    "os_version", "device_type", "backend_name", "backend_url", "tls_version", "geo_country", "geo_city", "geo_lat", "geo_lon", "asn", "asn_org",
]
_STORED_SQL = ", ".join(
    {
        "request_hash": f"{HASH} AS request_hash",
        "timestamp": f"{stamp('\"timestamp\"')} AS \"timestamp\"",
        "partition_key": "strftime(\"timestamp\", '%Y-%m') AS partition_key",
        "response_time_ms": "round(response_time_ms, 6) AS response_time_ms",
    }.get(c, c)
    for c in _STORED
)


def _stored_requests(s):
    path = shared_dir(s.spark, "stored")
    sinks.append_requests(conform(cleaning.with_identity(s.placed)), path, initial=True)
    return sinks.read_requests(s.spark, path)


query(
    "stored_recent_requests",
    lambda s: rows.recent_requests(_stored_requests(s), FILTERED, limit=50, offset=5).select(*_STORED),
    base() + f"SELECT {_STORED_SQL} FROM http_requests WHERE {FILTERED_SQL} {_NEWEST} LIMIT 50 OFFSET 5",
)
query(
    "stored_by_source",
    lambda s: rows.find_by_source(_stored_requests(s), "traefik-0", 40).select(*_STORED),
    base() + f"SELECT {_STORED_SQL} FROM http_requests WHERE source_name = 'traefik-0' {_NEWEST} LIMIT 40",
)
query(
    "stored_by_time_range",
    lambda s: rows.find_by_time_range(_stored_requests(s), "2024-01-08", "2024-01-09 12:00:00", 100).select(*_STORED),
    base() + f"""SELECT {_STORED_SQL} FROM http_requests
WHERE http_requests."timestamp" BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-09 12:00:00' {_NEWEST} LIMIT 100""",
)
query(
    "stored_by_hash",
    lambda s: rows.find_by_hash(_stored_requests(s), _some_hash(s), "2024-01").select(*_STORED),
    base() + f"SELECT {_STORED_SQL} FROM http_requests WHERE id = 421 AND strftime(\"timestamp\", '%Y-%m') = '2024-01'",
)
query(
    "stored_ip_recent_requests",
    lambda s: clients.ip_recent_requests(_stored_requests(s), None, WEEK, 3).select("ip_address", *_STORED),
    base() + f"""SELECT client_ip AS ip_address, {_STORED_SQL} FROM http_requests WHERE http_requests.{last(168)}
QUALIFY row_number() OVER (PARTITION BY client_ip {_NEWEST}) <= 3""",
)
query("stored_requests", lambda s: _stored_requests(s).select(*_STORED), base() + f"SELECT {_STORED_SQL} FROM http_requests")

# --- windows beyond a year ---


def _spread(s):
    """The requests over three years: every third one 400 days earlier, every third one 800."""
    return s.plain.withColumn("timestamp", F.col("timestamp") - F.make_interval(days=(F.col("id") % 3 * 400).cast("int")))


_SPREAD = base('spread AS (SELECT * REPLACE ("timestamp" - to_days(CAST(id % 3 * 400 AS INTEGER)) AS "timestamp") FROM http_requests)')
query(
    "summary_two_years",
    lambda s: summary.summary(_spread(s), Scope(AS_OF, 17_520)),
    _summary_sql(last(17_520), "17520").replace(base(), _SPREAD).replace("FROM http_requests WHERE", "FROM spread WHERE"),
)
query(
    "ip_heatmap_long",
    lambda s: clients.ip_heatmap(_spread(s), None, Scope(AS_OF, 0), days=500),
    _SPREAD + f"""SELECT client_ip AS ip_address, {DOW} AS day_of_week, {HOUR_NO} AS hour, count(*) AS requests, {AVG_ALL}
FROM spread WHERE {last(12_000)} GROUP BY 1, 2, 3""",
)
query(
    "records_timeline_long",
    lambda s: timelines.records_timeline(_spread(s), as_of=AS_OF, days=500),
    _SPREAD + f"SELECT {DAY} AS hour, count(*) AS requests FROM spread WHERE {last(12_000)} GROUP BY 1",
)
