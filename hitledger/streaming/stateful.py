"""Streams with state of their own: resets of what falls silent, newest requests, heavy clients.

They run on Spark's ``transformWithState`` and need its RocksDB state store, which :func:`start` chooses for the
query it starts. All state is bounded by parameters or by what is active within the watermark.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from hitledger.functions import measures as m
from hitledger.functions.predicates import Scope, any_service, host_contains
from hitledger.operators.realtime import CLIENT_SECONDS, LATEST, MIN_CLIENT_RATE, RATE_SECONDS, TOP_CLIENTS
from hitledger.sources.sinks import delete_folders, folders_of

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts that the rows of one view, window or key are dealt to before their results are put together.
PARTS = 8
#: Counters of each part of a window; a client's count is wrong by at most its part's rows over this.
COUNTERS = 1_000


def start(frame: DataFrame, store, checkpoint: str, *, mode: str = "append", interval: str | None = None) -> StreamingQuery:
    """Run ``store(batch, batch_id)`` on the stream's batches; ``interval=None`` processes what is there and stops."""
    spark = frame.sparkSession
    before = spark.conf.get(_STORE)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    spark.conf.set(_STORE, _ROCKS)
    try:
        writer = frame.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", checkpoint)
        return writer.trigger(**trigger).start()
    finally:
        spark.conf.set(_STORE, before)


# --- resets ---

_ZEROS = ("request_rate", "error_rate", "bandwidth_rate", "avg_response_time")


class _Silence(StatefulProcessor):
    """One row for each time a key falls silent: when ``seconds`` have passed since its last active second."""

    def __init__(self, seconds: int):
        self.wait = seconds * 1_000

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ended long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # the seconds are final and come in order from batch to batch
        ends = sorted({int(t.timestamp() * 1_000) for frame in rows for t in frame["ended"]})
        silent = []
        last = self.last.get()[0] if self.last.exists() else None
        if last is not None:
            self.handle.deleteTimer(last + self.wait)
        for end in ends:
            if last is not None and end - last > self.wait:
                silent.append(last + self.wait)
            last = end
        self.last.update((last,))
        self.handle.registerTimer(last + self.wait)
        yield self._rows(key, silent)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield self._rows(key, [expiredTimerInfo.getExpiryTimeInMs()])

    @staticmethod
    def _rows(key, at: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"key": pd.Series([key[0]] * len(at), dtype="object"), "at": pd.Series(at, dtype="int64")})

    def close(self) -> None:
        pass


def silent_keys(rows: DataFrame, key: str | Column | None = None, *, seconds: int = RATE_SECONDS) -> DataFrame:
    """A row of zero rates when a key (client, service; None: the whole stream) has had no request for ``seconds``.

    ``window_end`` is the end of the first rate window without a request. ``rows`` carries a watermark. Requests
    are folded to active seconds first, so a busy key costs its state one row a second; a key's state is one
    number and goes when its reset is out.
    """
    name = F.lit("all") if key is None else F.col(key) if isinstance(key, str) else key
    active = rows.groupBy(F.window("timestamp", "1 second").alias("second"), name.alias("key")).agg(m.hits("_n"))
    ended = active.select("key", F.window_time("second").alias("seen"), F.col("second.end").alias("ended"))
    found = ended.groupBy("key").transformWithStateInPandas(_Silence(seconds), "key string, at bigint", "Append", "EventTime")
    at = F.timestamp_millis("at").alias("window_end")
    return found.select("key", at, *(F.lit(0.0).alias(z) for z in _ZEROS))


# --- newest requests ---

LATEST_COLUMNS = ("request_hash", "timestamp", "method", "host", "backend_name", "path", "status_code", "response_time_ms", "geo_country", "client_ip")
_LATEST_TYPES = "request_hash string, at bigint, method string, host string, backend_name string, path string, status_code int, response_time_ms double, geo_country string, client_ip string"
_FIELDS = [f.split()[0] for f in _LATEST_TYPES.split(", ")]


class _Newest(StatefulProcessor):
    """The newest ``limit`` rows of a key, as a list that is handed on whenever it changes."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle) -> None:
        self.rows = handle.getListState("newest", _LATEST_TYPES)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.rows.get()]
        order = lambda r: (r[1], r[0])
        newest = heapq.nlargest(self.limit, {r for frame in rows for r in frame[_FIELDS].itertuples(index=False, name=None)} | set(held), order)
        if newest != held:
            self.rows.put(newest)
            out = pd.DataFrame(newest, columns=_FIELDS)
            out.insert(0, "part", key[1])
            out.insert(0, "view", key[0])
            yield out

    def close(self) -> None:
        pass


def _trimmed(dealt: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` different rows that each task has of a view's part: no others can enter its list."""
    order = [("view", "ascending"), ("part", "ascending"), ("at", "descending"), ("request_hash", "descending")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            fresh = pa.Table.from_batches([batch])
            both = fresh if held is None else pa.concat_tables([held, fresh])
            both = both.group_by(both.column_names, use_threads=False).aggregate([]).sort_by(order)
            if not both.num_rows:
                continue
            views = both["view"].combine_chunks().dictionary_encode().indices.to_numpy()
            parts = both["part"].to_numpy()
            starts = np.flatnonzero(np.r_[True, (views[1:] != views[:-1]) | (parts[1:] != parts[:-1])])
            place = np.arange(len(views)) - np.repeat(starts, np.diff(np.r_[starts, len(views)]))
            held = both.filter(pa.array(place < limit)).combine_chunks()
        if held is not None:
            yield from held.to_batches()

    return dealt.mapInArrow(run, dealt.schema)


def newest_requests(rows: DataFrame, views: Mapping[str, tuple[Scope, str]], *, limit: int = LATEST, parts: int = PARTS) -> DataFrame:
    """The newest requests of each view (name: scope and host filter), in ``parts`` lists of at most ``limit`` rows.

    A request enters every view whose filters it passes. Requests are dealt by hash, so no view is one task, and
    of each batch only what a task has newest is sent on.
    :func:`keep_newest` stores the lists and :func:`read_newest` puts them together.
    """
    tests = []
    for name, (scope, host) in views.items():
        if scope.exclude and isinstance(scope.exclude.client_ips, DataFrame):
            raise ValueError("a view leaves clients out by a list")
        passes = any_service(scope.services) if scope.services else F.lit(True)
        if host:
            passes = passes & host_contains(host)
        if scope.exclude and scope.exclude.client_ips:
            hit = F.col("client_ip").isin(list(scope.exclude.client_ips))
            passes = passes & ~(hit & any_service(scope.exclude.services) if scope.exclude.services else hit)
        tests.append(F.when(passes, F.lit(name)))
    part = F.pmod(F.xxhash64("request_hash"), F.lit(parts)).cast("int").alias("part")
    seen = rows.select(part, F.unix_micros("timestamp").alias("at"), *(c for c in LATEST_COLUMNS if c != "timestamp"), F.array_compact(F.array(*tests)).alias("_views"))
    dealt = seen.select(F.explode("_views").alias("view"), "part", *(F.col(f).cast(t).alias(f) for f, t in (x.split() for x in _LATEST_TYPES.split(", "))))
    return _trimmed(dealt, limit).groupBy("view", "part").transformWithStateInPandas(_Newest(limit), f"view string, part int, {_LATEST_TYPES}", "Update", "None")


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removeprefix("version=")) for n in folders_of(spark, path) if n.startswith("version="))


def keep_newest(lists: DataFrame, path: str, checkpoint: str, *, interval: str | None = None) -> StreamingQuery:
    """Keep the current lists below ``path``, one version for each batch, made from the one before; two are kept.

    A retried batch writes its own version again.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = [v for v in _versions(spark, path) if v < batch_id]
        batch = batch.persist()
        try:
            now = batch
            if earlier:
                before = spark.read.parquet(f"{path}/version={earlier[-1]}")
                now = batch.unionByName(before.join(batch.select("view", "part").distinct(), ["view", "part"], "left_anti"))
            now.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={batch_id}")  # views x parts x limit rows
            delete_folders(spark, [f"{path}/version={v}" for v in earlier[:-1]])
        finally:
            batch.unpersist()

    return start(lists, store, checkpoint, mode="update", interval=interval)


def read_newest(spark: SparkSession, path: str, *, limit: int = LATEST) -> DataFrame:
    """The newest ``limit`` requests of each view, newest first."""
    rows = spark.read.parquet(f"{path}/version={_versions(spark, path)[-1]}")
    place = F.row_number().over(Window.partitionBy("view").orderBy(F.desc("at"), F.desc("request_hash")))
    named = rows.withColumn("place", place).filter(F.col("place") <= limit).withColumn("timestamp", F.timestamp_micros("at"))
    return named.select("view", "place", *LATEST_COLUMNS)


# --- heavy clients ---


class _SpaceSaving(StatefulProcessor):
    """Counters of the heaviest clients of a window's part; handed on when the window is over."""

    def __init__(self, counters: int):
        self.most = counters

    def init(self, handle) -> None:
        self.handle = handle
        self.counters = handle.getListState("counters", "ip string, n bigint, error bigint, bytes bigint, country string, at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {r[0]: list(r[1:]) for r in self.counters.get()}
        if not held:
            self.handle.registerTimer(int(key[0].timestamp() * 1_000))
        whole = pd.concat(list(rows))
        sums = whole.groupby("client_ip").agg(n=("response_size", "size"), bytes=("response_size", "sum"))
        places = whole[whole["geo_country"] != ""].sort_values("at").drop_duplicates("client_ip").set_index("client_ip")[["geo_country", "at"]]
        first = {ip: (c, int(a)) for ip, c, a in places.itertuples()}
        queue = None
        for ip, n, size in sums.sort_values(["n"], ascending=False, kind="stable").itertuples():
            country, at = first.get(ip, ("", 1 << 62))
            if ip not in held:
                if len(held) < self.most:
                    held[ip] = [0, 0, 0, "", 1 << 62]
                else:
                    if queue is None:
                        queue = [(v[0], k) for k, v in held.items()]
                        heapq.heapify(queue)
                    while queue[0][1] not in held or held[queue[0][1]][0] != queue[0][0]:
                        k = heapq.heappop(queue)[1]
                        if k in held:
                            heapq.heappush(queue, (held[k][0], k))
                    least, gone = heapq.heappop(queue)
                    del held[gone]
                    held[ip] = [least, least, 0, "", 1 << 62]
            mine = held[ip]
            mine[0] += int(n)
            mine[2] += int(size)
            if at < mine[4]:
                mine[3], mine[4] = country, at
            if queue is not None:
                heapq.heappush(queue, (mine[0], ip))
        self.counters.put([(ip, *v) for ip, v in held.items()])
        yield pd.DataFrame({c: pd.Series([], dtype=t) for c, t in _COUNTED.items()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = [tuple(r) for r in self.counters.get()]
        self.counters.clear()
        # a client without a counter has at most the least count there
        floor = min(r[1] for r in rows) if len(rows) >= self.most else 0
        out = pd.DataFrame(rows, columns=["ip", "n", "error", "bytes", "country", "at"])
        out["window_end"], out["floor"] = key[0], floor
        out["part"] = key[1]
        yield out[list(_COUNTED)]

    def close(self) -> None:
        pass


_COUNTED = {"window_end": "datetime64[ns]", "part": "int32", "ip": "object", "n": "int64", "error": "int64", "bytes": "int64", "country": "object", "at": "int64", "floor": "int64"}


def heavy_clients(rows: DataFrame, *, slide: int = 5, counters: int = COUNTERS, parts: int = PARTS) -> DataFrame:
    """Space-Saving counters of the clients of each 15-second window, for :func:`merged_clients` in the sink.

    A part holds at most ``counters`` clients, however many a window has. Rows are dealt to the parts by hash,
    so a client with most of the requests is spread like any other.
    """
    window = F.window("timestamp", f"{CLIENT_SECONDS} seconds", f"{slide} seconds")
    part = F.pmod(F.xxhash64("client_ip", "timestamp", "path"), F.lit(parts)).cast("int").alias("part")
    size = F.coalesce(F.col("response_size"), F.lit(0)).cast("bigint").alias("response_size")
    dealt = rows.select("timestamp", window["end"].alias("window_end"), part, "client_ip", size, F.coalesce("geo_country", F.lit("")).alias("geo_country"), F.unix_micros("timestamp").alias("at"))
    schema = "window_end timestamp, part int, ip string, n bigint, error bigint, bytes bigint, country string, at bigint, floor bigint"
    return dealt.groupBy("window_end", "part").transformWithStateInPandas(_SpaceSaving(counters), schema, "Append", "EventTime")


def merged_clients(batch: DataFrame, limit: int = TOP_CLIENTS) -> DataFrame:
    """The heaviest clients of each window of a finished batch, from all its parts.

    ``request_rate`` is never below the true rate; the true one is at most ``rate_error`` below. Bytes are those
    since the client last got a counter. With fewer clients than counters all figures are exact.
    """
    floors = batch.select("window_end", "part", "floor").distinct().groupBy("window_end").agg(F.sum("floor").alias("_all"))
    first = F.min(F.when(F.col("country") != "", F.struct("at", "country")))["country"]
    sums = batch.groupBy("window_end", "ip").agg(
        F.sum("n").alias("_n"), F.sum("error").alias("_error"), F.sum("floor").alias("_met"), F.sum("bytes").alias("bandwidth"), F.coalesce(first, F.lit("")).alias("country")
    )
    both = sums.join(floors, "window_end").withColumn("_missing", F.col("_all") - F.col("_met"))
    rated = both.select(
        "window_end", "ip", "bandwidth", "country", ((F.col("_n") + F.col("_missing")) / CLIENT_SECONDS).alias("request_rate"),
        (F.col("bandwidth") / CLIENT_SECONDS).alias("bandwidth_rate"), ((F.col("_error") + F.col("_missing")) / CLIENT_SECONDS).alias("rate_error"),
    ).filter(F.col("request_rate") > MIN_CLIENT_RATE)
    place = F.row_number().over(Window.partitionBy("window_end").orderBy(F.desc("request_rate"), "ip"))
    return rated.withColumn("place", place).filter(F.col("place") <= limit)
