"""Queries for realtime figures: point-in-time snapshots and their streaming twins.

The month of requests is replayed faster, so that the short windows hold many rows: within one
minute for the snapshots, within ten minutes for the streams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitledger.functions import measures as m
from hitledger.functions.predicates import Exclusion, Scope, Service
from hitledger.operators import cleaning, realtime
from hitledger.plans.catalog import query
from hitledger.plans.report_queries import SHOP
from hitledger.plans.sample import Sample
from hitledger.plans.sample_sql import AVG_ALL, BYTES, HASH, base, stamp
from hitledger.session import shared_dir
from hitledger.sources import logs, sinks
from hitledger.streaming import ingest as stream_ingest
from hitledger.streaming import realtime as stream

_MINUTE, _TEN_MINUTES = 43_200, 4_320
NOW = Scope("2024-02-01 00:00:58", 0)
SOME = Scope(
    "2024-02-01 00:00:58", 0, services=(Service(SHOP, "auto_loose"), Service("site1.example.com", "host")), exclude=Exclusion(("10.0.0.6",))
)
SOME_SQL = f"(backend_name = '{SHOP}' OR backend_url = '{SHOP}' OR host = '{SHOP}' OR host = 'site1.example.com') AND client_ip <> '10.0.0.6'"


def _fast(factor: int) -> str:
    return f"""fast AS (SELECT * REPLACE (make_timestamp(1706745600000000 + (epoch_us("timestamp") - 1704067200000000) // {factor}) AS "timestamp")
  FROM http_requests)"""


_ENDED = "TIMESTAMP '2024-02-01 00:00:58'"


def _live(seconds: int, where: str = "true") -> str:
    return f"""SELECT * FROM fast WHERE "timestamp" > {_ENDED} - INTERVAL {seconds} SECOND AND "timestamp" <= {_ENDED} AND {where}"""


def _snapshot_sql(where: str) -> str:
    recent = f'"timestamp" > {_ENDED} - INTERVAL 5 SECOND'
    mix = ", ".join(
        f"CASE WHEN count(*) FILTER ({recent}) > 0 THEN count(*) FILTER ({test}) ELSE 0 END AS status_{name}"
        for name, test in (("2xx", "status_code BETWEEN 200 AND 299"), ("4xx", "status_code BETWEEN 400 AND 499"), ("5xx", "status_code >= 500"))
    )
    return base(_fast(_MINUTE)) + f"""SELECT count(*) FILTER ({recent}) / 5.0::DOUBLE AS request_rate,
  count(*) FILTER ({recent} AND status_code >= 400) / 5.0::DOUBLE AS error_rate,
  coalesce(sum(response_size) FILTER ({recent}), 0) / 5.0::DOUBLE AS bandwidth_rate,
  round(coalesce(avg(response_time_ms) FILTER ({recent}), 0), 6) AS avg_response_time, {mix} FROM ({_live(60, where)})"""


query("realtime_snapshot", lambda s: realtime.realtime_snapshot(s.squeezed(_MINUTE), NOW), _snapshot_sql("true"))
query("realtime_snapshot_filtered", lambda s: realtime.realtime_snapshot(s.squeezed(_MINUTE), SOME), _snapshot_sql(SOME_SQL))
query(
    "realtime_snapshot_host",
    lambda s: realtime.realtime_snapshot(s.squeezed(_MINUTE), NOW, host="app 2"),
    _snapshot_sql("contains(backend_name, 'app-2')"),
)
query(
    "realtime_snapshot_idle",
    lambda s: realtime.realtime_snapshot(s.squeezed(_MINUTE), Scope("2024-02-01 00:01:20", 0)),
    base(_fast(_MINUTE)) + """SELECT 0.0::DOUBLE AS request_rate, 0.0::DOUBLE AS error_rate, 0.0::DOUBLE AS bandwidth_rate,
  0.0::DOUBLE AS avg_response_time, CAST(0 AS BIGINT) AS status_2xx, CAST(0 AS BIGINT) AS status_4xx, CAST(0 AS BIGINT) AS status_5xx
WHERE EXISTS (SELECT 1 FROM fast)""",
)
query(
    "realtime_top_ips",
    lambda s: realtime.realtime_top_ips(s.squeezed(_MINUTE), NOW),
    base(_fast(_MINUTE)) + f"""SELECT client_ip AS ip, {BYTES}, coalesce(arg_min(geo_country, "timestamp") FILTER (geo_country <> ''), '') AS country,
  round(count(*) / 15.0::DOUBLE, 6) AS request_rate, round(coalesce(sum(response_size), 0) / 15.0::DOUBLE, 6) AS bandwidth_rate
FROM ({_live(15)}) GROUP BY 1 HAVING count(*) / 15.0 > 0.05 ORDER BY count(*) DESC, ip LIMIT 10""",
)
_SERVICE_NAME = """CASE WHEN backend_name <> '' THEN 'app ' || (user_id % 3) WHEN backend_url <> '' THEN backend_url ELSE host END"""
query(
    "realtime_services",
    lambda s: realtime.realtime_services(s.squeezed(_MINUTE), NOW),
    base(_fast(_MINUTE)) + f"""SELECT {_SERVICE_NAME} AS service_name, count(*) / 5.0::DOUBLE AS request_rate, sum(response_size) / 5.0::DOUBLE AS bandwidth_rate
FROM ({_live(5)}) GROUP BY 1""",
)
query(
    "realtime_latest",
    lambda s: realtime.latest_requests(cleaning.with_identity(s.squeezed(_MINUTE)), SOME),
    base(_fast(_MINUTE)) + f"""SELECT {HASH} AS request_hash, {stamp('"timestamp"')} AS "timestamp", method, host, backend_name, path, status_code, response_time_ms, geo_country, client_ip
FROM ({_live(60, SOME_SQL)}) l ORDER BY l."timestamp" DESC, {HASH} DESC LIMIT 20""",
)


# --- streams: the replayed table lands in a folder and is read to its end ---


def _landed(s: Sample, rows: DataFrame) -> DataFrame:
    path = shared_dir(s.spark, "landing")
    rows.write.parquet(path)
    return s.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1_000).parquet(path)


def _streamed(s: Sample, windows: Callable[[DataFrame], DataFrame], rows: DataFrame | None = None, transform=None) -> DataFrame:
    source = _landed(s, s.squeezed(_TEN_MINUTES) if rows is None else rows)
    work = shared_dir(s.spark, "windows")
    query_ = stream.run_to_table(windows(source), f"{work}/out", f"{work}/checkpoint", transform=transform)
    query_.awaitTermination()
    return s.spark.read.parquet(f"{work}/out").drop("batch")


def _windows_sql(select: str, seconds: int, group: str = "", having: str = "") -> str:
    """Sliding windows that end at least the 60 s of lateness before the newest row."""
    slides = f"""slid AS (SELECT f.*, make_timestamp((epoch_us(f."timestamp") // 1000000 + 1 + k) * 1000000) AS window_end
  FROM fast f, range({seconds}) r(k)),
newest AS (SELECT max("timestamp") - INTERVAL 60 SECOND AS mark FROM fast)"""
    keys = f", {group}" if group else ""
    return base(_fast(_TEN_MINUTES), slides) + f"""SELECT {stamp('window_end')} AS window_end, {select} FROM slid, newest
WHERE window_end <= date_trunc('millisecond', mark) GROUP BY slid.window_end{keys} {having}"""


query(
    "stream_rates",
    lambda s: _streamed(s, lambda r: stream.rates(stream.live(r))),
    _windows_sql(
        f"""count(*) / 5.0::DOUBLE AS request_rate, count(*) FILTER (status_code >= 400) / 5.0::DOUBLE AS error_rate,
  sum(response_size) / 5.0::DOUBLE AS bandwidth_rate, {AVG_ALL}""",
        5,
    ),
)
query(
    "stream_status_mix",
    lambda s: _streamed(s, lambda r: stream.status_mix(stream.live(r))),
    _windows_sql(
        """count(*) FILTER (status_code BETWEEN 200 AND 299) AS status_2xx, count(*) FILTER (status_code BETWEEN 400 AND 499) AS status_4xx,
  count(*) FILTER (status_code >= 500) AS status_5xx""",
        60,
    ),
)
query(
    "stream_top_clients",
    lambda s: _streamed(s, lambda r: stream.client_activity(stream.live(r), slide=5), transform=stream.top_clients),
    base(
        _fast(_TEN_MINUTES),
        """slid AS (SELECT f.*, make_timestamp((epoch_us(f."timestamp") // 5000000 + 1 + k) * 5000000) AS window_end FROM fast f, range(3) r(k)),
newest AS (SELECT max("timestamp") - INTERVAL 60 SECOND AS mark FROM fast)""",
    )
    + f"""SELECT {stamp('window_end')} AS window_end, client_ip AS ip, {BYTES},
  coalesce(arg_min(geo_country, slid."timestamp") FILTER (geo_country <> ''), '') AS country, round(count(*) / 15.0::DOUBLE, 6) AS request_rate,
  round(sum(response_size) / 15.0::DOUBLE, 6) AS bandwidth_rate,
  row_number() OVER (PARTITION BY slid.window_end ORDER BY count(*) DESC, client_ip) AS place
FROM slid, newest WHERE slid.window_end <= date_trunc('millisecond', mark) GROUP BY slid.window_end, client_ip
QUALIFY row_number() OVER (PARTITION BY slid.window_end ORDER BY count(*) DESC, client_ip) <= 10""",
)
query(
    "stream_service_rates",
    lambda s: _streamed(s, lambda r: stream.service_rates(stream.live(r))),
    _windows_sql(
        f"{_SERVICE_NAME} AS service_name, count(*) / 5.0::DOUBLE AS request_rate, sum(response_size) / 5.0::DOUBLE AS bandwidth_rate", 5, "2"
    ),
)
query(
    "stream_rates_filtered",
    lambda s: _streamed(s, lambda r: stream.rates(stream.live(r, SOME, host="app 1"))),
    _windows_sql(
        f"""count(*) / 5.0::DOUBLE AS request_rate, count(*) FILTER (status_code >= 400) / 5.0::DOUBLE AS error_rate,
  sum(response_size) / 5.0::DOUBLE AS bandwidth_rate, {AVG_ALL}""",
        5,
    ).replace("FROM slid, newest\nWHERE", f"FROM slid, newest\nWHERE {SOME_SQL} AND contains(backend_name, 'app-1') AND").replace(
        "max(\"timestamp\") - INTERVAL 60 SECOND AS mark FROM fast",
        f"max(\"timestamp\") - INTERVAL 60 SECOND AS mark FROM fast WHERE {SOME_SQL} AND contains(backend_name, 'app-1')",
    ),
)
query(
    "stream_timeline",
    lambda s: _streamed(s, lambda r: stream.stream_timeline(stream.live(r), 24), rows=s.placed).drop("unique_visitors"),
    base() + f"""SELECT {stamp('date_trunc(\'hour\', "timestamp")')} AS bucket_start, count(*) AS requests, {BYTES}, {AVG_ALL} FROM http_requests
WHERE date_trunc('hour', "timestamp") + INTERVAL 1 HOUR <= (SELECT max("timestamp") - INTERVAL 60 SECOND FROM http_requests) GROUP BY date_trunc('hour', "timestamp")""",
)


def _visitor_errors(s: Sample) -> DataFrame:
    """Whether the streamed timeline's approximate visitors are within a tenth of the exact ones."""
    found = _streamed(s, lambda r: stream.stream_timeline(stream.live(r), 24), rows=s.placed)
    hour = F.date_trunc("hour", "timestamp").alias("bucket_start")
    exact = s.placed.groupBy(hour).agg(F.count_distinct("client_ip").alias("exact"))
    near = F.abs(F.col("unique_visitors") - F.col("exact")) <= F.col("exact") * 0.1 + 1
    return found.join(exact, "bucket_start").select("bucket_start", near.alias("near"))


query(
    "stream_timeline_visitors",
    _visitor_errors,
    base() + f"""SELECT DISTINCT {stamp('date_trunc(\'hour\', "timestamp")')} AS bucket_start, true AS near FROM http_requests
WHERE date_trunc('hour', "timestamp") + INTERVAL 1 HOUR <= (SELECT max("timestamp") - INTERVAL 60 SECOND FROM http_requests)""",
)


def _ingested(s: Sample) -> DataFrame:
    """Lines land twice; the stream stores each request once."""
    work = shared_dir(s.spark, "stream-ingest")
    s.lines.select("value").write.text(f"{work}/landing")
    s.lines.filter(F.col("id") % 4 == 0).select("value").write.mode("append").text(f"{work}/landing")
    lines = logs.stream_lines(s.spark, f"{work}/landing", max_files=4)
    stream_ingest.start_ingest(lines, f"{work}/table", f"{work}/checkpoint", interval=None).awaitTermination()
    return sinks.read_requests(s.spark, f"{work}/table").groupBy("partition_key", "method").agg(m.hits())


query(
    "stream_ingest",
    _ingested,
    base() + "SELECT strftime(\"timestamp\", '%Y-%m') AS partition_key, method, count(*) AS hits FROM http_requests GROUP BY 1, 2",
)
