"""Queries of the streams with state of their own, on the replayed requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitledger.functions import measures as m
from hitledger.operators import cleaning
from hitledger.plans.catalog import query
from hitledger.plans.live_queries import _SERVICE_NAME, _TEN_MINUTES, _fast, _landed, NOW, SOME, SOME_SQL
from hitledger.plans.sample import Sample
from hitledger.plans.sample_sql import BYTES, HASH, base, stamp
from hitledger.session import shared_dir
from hitledger.streaming import realtime as stream
from hitledger.streaming import stateful


#: The month in twelve hours: slow enough for the whole stream to fall silent.
_HALF_DAY = 60


def _replayed(s: Sample, factor: int = _TEN_MINUTES) -> DataFrame:
    return _landed(s, cleaning.with_identity(s.squeezed(factor)))


def _run(s: Sample, frame: DataFrame, transform: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> DataFrame:
    work = shared_dir(s.spark, "stateful")

    def store(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{work}/out/batch={batch_id}")

    stateful.start(frame, store, f"{work}/checkpoint").awaitTermination()
    return s.spark.read.parquet(f"{work}/out").drop("batch")


# --- resets ---


def _silent_sql(key: str, factor: int = _TEN_MINUTES) -> str:
    """Seconds after which ``key`` had no request for five seconds, up to the watermark."""
    more = f"""active AS (SELECT DISTINCT {key} AS key, epoch_us("timestamp") // 1000000 AS s FROM fast),
gap AS (SELECT key, s, lead(s) OVER (PARTITION BY key ORDER BY s) AS after FROM active),
newest AS (SELECT epoch_us(max("timestamp")) // 1000 - 60000 AS mark FROM fast)"""
    zeros = ", ".join(f"0.0::DOUBLE AS {z}" for z in ("request_rate", "error_rate", "bandwidth_rate", "avg_response_time"))
    return base(_fast(factor), more) + f"""SELECT key, {stamp('make_timestamp((s + 6) * 1000000)')} AS window_end, {zeros} FROM gap, newest
WHERE (after IS NULL OR after - s > 5) AND (s + 6) * 1000 < mark"""


query("stream_silent_clients", lambda s: _run(s, stateful.silent_keys(stream.live(_replayed(s)), "client_ip")), _silent_sql("client_ip"))
query(
    "stream_silent_services",
    lambda s: _run(s, stateful.silent_keys(stream.live(_replayed(s)), stream.live_service_name())),
    _silent_sql(_SERVICE_NAME),
)
query("stream_silence", lambda s: _run(s, stateful.silent_keys(stream.live(_replayed(s, _HALF_DAY)))), _silent_sql("'all'", _HALF_DAY))

# --- newest requests ---

_VIEWS = {"all": (NOW, ""), "some": (SOME, ""), "app 1": (NOW, "app 1")}


def _newest(s: Sample) -> DataFrame:
    work = shared_dir(s.spark, "newest")
    stateful.keep_newest(stateful.newest_requests(_replayed(s), _VIEWS), f"{work}/lists", f"{work}/checkpoint").awaitTermination()
    return stateful.read_newest(s.spark, f"{work}/lists")


_VIEW_SQL = {"all": "true", "some": SOME_SQL, "app 1": "contains(backend_name, 'app-1')"}
query(
    "stream_newest_requests",
    _newest,
    base(_fast(_TEN_MINUTES))
    + " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{view}' AS view, row_number() OVER (ORDER BY fast."timestamp" DESC, {HASH} DESC) AS place, {HASH} AS request_hash,
  {stamp('fast."timestamp"')} AS "timestamp", method, host, backend_name, path, status_code, response_time_ms, geo_country, client_ip
FROM fast WHERE {where}) WHERE place <= 20"""
        for view, where in _VIEW_SQL.items()
    ),
)

# --- heavy clients ---

_WINDOWS = """slid AS (SELECT f.*, make_timestamp((epoch_us(f."timestamp") // 5000000 + 1 + k) * 5000000) AS window_end FROM fast f, range(3) r(k)),
newest AS (SELECT max("timestamp") - INTERVAL 60 SECOND AS mark FROM fast)"""
_OVER = "slid.window_end < date_trunc('millisecond', mark)"
query(
    "stream_heavy_clients",
    lambda s: _run(s, stateful.heavy_clients(stream.live(_replayed(s)), counters=20_000, parts=2), stateful.merged_clients),
    base(_fast(_TEN_MINUTES), _WINDOWS)
    + f"""SELECT {stamp('window_end')} AS window_end, client_ip AS ip, {BYTES},
  coalesce(arg_min(geo_country, slid."timestamp") FILTER (geo_country <> ''), '') AS country, round(count(*) / 15.0::DOUBLE, 6) AS request_rate,
  round(sum(response_size) / 15.0::DOUBLE, 6) AS bandwidth_rate, 0.0::DOUBLE AS rate_error,
  row_number() OVER (PARTITION BY slid.window_end ORDER BY count(*) DESC, client_ip) AS place
FROM slid, newest WHERE {_OVER} GROUP BY slid.window_end, client_ip
QUALIFY row_number() OVER (PARTITION BY slid.window_end ORDER BY count(*) DESC, client_ip) <= 10""",
)


def _bounded(s: Sample) -> DataFrame:
    """Whether, with far fewer counters than clients, every rate given is within its stated error, and that within its bound."""
    counters, parts = 8, 2
    found = _run(s, stateful.heavy_clients(stream.live(_replayed(s)), counters=counters, parts=parts), lambda b: stateful.merged_clients(b, 1_000_000))
    ends = F.explode(F.array(*(F.timestamp_seconds((F.floor(F.unix_seconds("timestamp") / 5) + 1 + k) * 5) for k in range(3)))).alias("window_end")
    rows = s.squeezed(_TEN_MINUTES).select("client_ip", ends)
    exact = rows.groupBy("window_end", F.col("client_ip").alias("ip")).agg((m.hits("_") / 15).alias("rate"))
    total = rows.groupBy("window_end").agg((m.hits("_") / 15).alias("total"))
    both = found.join(exact, ["window_end", "ip"], "left").join(total, "window_end").withColumn("rate", F.coalesce("rate", F.lit(0.0)))
    slack = 1e-9
    right = (F.col("request_rate") >= F.col("rate") - slack) & (F.col("request_rate") - F.col("rate_error") <= F.col("rate") + slack)
    return both.groupBy("window_end").agg(F.every(right).alias("within"), F.every(F.col("rate_error") <= F.col("total") / counters + slack).alias("bounded"), F.max("place").alias("_n")).drop("_n")


query(
    "stream_heavy_clients_bounds",
    _bounded,
    base(_fast(_TEN_MINUTES), _WINDOWS) + f"SELECT DISTINCT {stamp('window_end')} AS window_end, true AS within, true AS bounded FROM slid, newest WHERE {_OVER}",
)
