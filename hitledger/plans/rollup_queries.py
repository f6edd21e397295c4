"""Queries on stored hourly rollups: the requests are stored in two appends, the rollups follow them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitledger.functions.predicates import Scope, Service
from hitledger.operators import cleaning, rollup
from hitledger.operators.latency import RANKS
from hitledger.plans.catalog import query
from hitledger.plans.report_queries import ALL, DAY_SCOPE, MONTH_SCOPE, SHOP, WEEK
from hitledger.plans.sample import Sample
from hitledger.plans.sample_sql import AVG, AVG_ALL, BYTES, HOUR, SIX, STATUS_CLASSES, TOTAL_BYTES, base, pct
from hitledger.schema import conform
from hitledger.session import shared_dir
from hitledger.sources import rollups, sinks

#: Rollups of a session's data folders, by keys.
_MADE: dict[tuple[str, str], dict[tuple[str, ...], str]] = {}


def _stored(s: Sample, keys: tuple[str, ...] = rollup.SERVICE_KEYS) -> DataFrame:
    """The rollup of the requests: two thirds of them stored at once, then half of all, late ones and repeats."""
    name = (s.spark.sparkContext.applicationId, s.sf_dir)
    if name not in _MADE:
        root = shared_dir(s.spark, "rollups")
        rows = conform(cleaning.with_identity(s.placed.withColumn("timestamp_defaulted", F.lit(False))).withColumn("requests_total", F.col("id").cast("int")))
        paths = {k: f"{root}/{'-'.join(k)}" for k in (rollup.SERVICE_KEYS, ("path",))}
        for part in ("requests_total % 3 > 0", "requests_total % 2 = 0 OR requests_total % 3 = 0"):
            hours = sinks.append_requests(rows.filter(part), f"{root}/requests")
            for k, path in paths.items():
                rollups.refresh(s.spark, f"{root}/requests", path, hours, k)
        _MADE[name] = paths
    return rollups.read_rollup(s.spark, _MADE[name][keys])


def _from(hours: int) -> str:
    return f"\"timestamp\" >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL {hours} HOUR"


def _summary_sql(where: str, hours: str) -> str:
    return base() + f"""SELECT count(*) AS total_requests,
  count(*) FILTER (status_code >= 200 AND status_code < 400) AS valid_requests,
  count(*) FILTER (status_code >= 400) AS failed_requests, {TOTAL_BYTES}, {AVG},
  {pct("count(*) FILTER (status_code >= 200 AND status_code < 400)")} AS success_rate,
  {pct("count(*) FILTER (status_code = 404)")} AS not_found_rate,
  {pct("count(*) FILTER (status_code >= 500 AND status_code < 600)")} AS server_error_rate,
  round(count(*) / CAST({hours} AS DOUBLE), 6) AS requests_per_hour
FROM http_requests WHERE {where}"""


_ESTIMATES = ("unique_visitors", "unique_files", "unique_404")
_SPAN = "greatest((epoch_us(max(\"timestamp\")) - epoch_us(min(\"timestamp\"))) / 3600000000.0, 1)"
_TWO = Scope(WEEK.as_of, 168, services=(Service(SHOP), Service("site3.example.com")))
_TWO_SQL = f"(backend_name = '{SHOP}' OR (backend_name = '' AND backend_url = '' AND host = 'site3.example.com'))"

query("rollup_summary_week", lambda s: rollup.summary_from_rollup(_stored(s), WEEK).drop(*_ESTIMATES), _summary_sql(_from(168), "168"))
query("rollup_summary_all_time", lambda s: rollup.summary_from_rollup(_stored(s), ALL).drop(*_ESTIMATES), _summary_sql("true", _SPAN))
query("rollup_summary_services", lambda s: rollup.summary_from_rollup(_stored(s), _TWO).drop(*_ESTIMATES), _summary_sql(f"{_from(168)} AND {_TWO_SQL}", "168"))


def _near(estimate: str, exact: str) -> F.Column:
    return F.abs(F.col(estimate) - F.col(exact)) <= F.col(exact) * rollup.DISTINCT_ERROR + 0.5


def _summary_errors(s: Sample) -> DataFrame:
    """Whether the estimated distinct counts of three windows are within their bound."""
    found = None
    for scope in (WEEK, MONTH_SCOPE, ALL):
        rows = s.placed if scope is ALL else s.placed.filter(F.col("timestamp") >= F.expr(f"timestamp '{scope.as_of}Z' - INTERVAL {int(scope.hours)} HOURS"))
        missing = F.when(F.col("status_code") == 404, F.col("path"))
        exact = rows.agg(F.count_distinct("client_ip").alias("c"), F.count_distinct("path").alias("p"), F.count_distinct(missing).alias("m"))
        both = rollup.summary_from_rollup(_stored(s), scope).crossJoin(exact)  # one row each
        one = both.select(F.lit(int(scope.hours)).alias("hours"), *(_near(e, x).alias(e) for e, x in zip(_ESTIMATES, "cpm")))
        found = one if found is None else found.unionByName(one)
    return found


query("rollup_distinct_errors", _summary_errors, "SELECT CAST(unnest([168, 720, 0]) AS BIGINT) AS hours, true AS unique_visitors, true AS unique_files, true AS unique_404 FROM (SELECT 1 FROM events LIMIT 1)")

for _name, _scope, _label in (("day", DAY_SCOPE, HOUR), ("week", WEEK, SIX)):
    query(
        f"rollup_timeline_{_name}",
        lambda s, scope=_scope: rollup.timeline_from_rollup(_stored(s), scope).drop("unique_visitors"),
        base() + f"SELECT {_label} AS hour, count(*) AS requests, {BYTES}, {AVG_ALL} FROM http_requests WHERE {_from(int(_scope.hours))} GROUP BY 1",
    )


def _timeline_errors(s: Sample) -> DataFrame:
    bucket = F.date_format(F.timestamp_seconds(F.floor(F.unix_seconds("timestamp") / 21_600) * 21_600), "yyyy-MM-dd'T'HH:00:00'Z'").alias("hour")
    exact = s.placed.groupBy(bucket).agg(F.count_distinct("client_ip").alias("exact"))
    return rollup.timeline_from_rollup(_stored(s), WEEK).join(exact, "hour").select("hour", _near("unique_visitors", "exact").alias("near"))


query("rollup_timeline_visitors", _timeline_errors, base() + f"SELECT DISTINCT {SIX} AS hour, true AS near FROM http_requests WHERE {_from(168)}")
query(
    "rollup_status_timeline",
    lambda s: rollup.status_timeline_from_rollup(_stored(s), DAY_SCOPE),
    base() + f"SELECT {HOUR} AS hour, {STATUS_CLASSES} FROM http_requests WHERE {_from(24)} GROUP BY 1",
)
query(
    "rollup_top_paths",
    lambda s: rollup.top_from_rollup(_stored(s, ("path",)), WEEK, "path", 20).drop("unique_visitors"),
    base() + f"SELECT path, count(*) AS hits, {AVG}, {TOTAL_BYTES} FROM http_requests WHERE {_from(168)} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
)
query(
    "rollup_top_hosts",
    lambda s: rollup.top_from_rollup(_stored(s), MONTH_SCOPE, "host", 0).drop("unique_visitors"),
    base() + f"SELECT host, count(*) AS hits, {AVG}, {TOTAL_BYTES} FROM http_requests WHERE {_from(720)} GROUP BY 1",
)
_MEASURED = "response_time_ms > 0"
query(
    "rollup_response_times",
    lambda s: rollup.response_times_from_rollup(_stored(s), WEEK, ["host"]).drop(*RANKS),
    base() + f"""SELECT host, min(response_time_ms) AS "min", max(response_time_ms) AS "max", round(avg(response_time_ms), 6) AS "avg" FROM http_requests WHERE {_from(168)} AND {_MEASURED} GROUP BY 1""",
)


def _rank_errors(s: Sample) -> DataFrame:
    """Whether the ranks of the merged sketches' percentiles are within their bound, per host over the week."""
    found = rollup.response_times_from_rollup(_stored(s), WEEK, ["host"])
    rows = s.placed.filter((F.col("timestamp") >= F.expr(f"timestamp '{WEEK.as_of}Z' - INTERVAL 168 HOURS")) & (F.col("response_time_ms") > 0))
    tests = []
    for p, (num, den) in RANKS.items():
        # equal values take up a span of ranks; the wanted rank must be near it
        below, upto = F.avg((F.col("response_time_ms") < F.col(p)).cast("int")), F.avg((F.col("response_time_ms") <= F.col(p)).cast("int"))
        tests.append(((below - rollup.RANK_ERROR <= num / den) & (upto + rollup.RANK_ERROR >= num / den)).alias(p))
    return rows.select("host", "response_time_ms").join(found.select("host", *RANKS), "host").groupBy("host").agg(*tests)


query("rollup_rank_errors", _rank_errors, base() + f"SELECT DISTINCT host, true AS p50, true AS p95, true AS p99 FROM http_requests WHERE {_from(168)} AND {_MEASURED}")
