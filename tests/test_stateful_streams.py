"""State of the streams: restarts, bounded lists and counters."""

import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hitledger.functions.predicates import Exclusion, Scope, Service
from hitledger.session import shared_dir
from hitledger.streaming import realtime, stateful


@pytest.fixture
def landing(spark, requests_of):
    path = shared_dir(spark, "test-stateful")

    def land(*rows):
        requests_of(*rows).coalesce(1).write.mode("append").parquet(f"{path}/in")

    def stream():
        return spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")

    return path, land, stream


def at(second, client="a", **more):
    return {"timestamp": f"2024-01-01 10:{second // 60:02d}:{second % 60:02d}.500", "client_ip": client, "request_hash": f"{client}{second}", **more}


def collect(spark, frame, path, mode="append"):
    stateful.start(frame, lambda b, i: b.write.mode("overwrite").parquet(f"{path}/out/batch={i}"), f"{path}/checkpoint", mode=mode).awaitTermination()
    return spark.read.parquet(f"{path}/out")


def test_silence_over_a_restart(spark, landing):
    path, land, stream = landing
    land(at(0), at(3), at(8), at(9), at(0, "b"))
    frame = lambda: stateful.silent_keys(realtime.live(stream(), watermark="2 seconds"), "client_ip")
    first = {(r.key, r.window_end.isoformat()[14:]) for r in collect(spark, frame(), path).collect()}
    assert first == {("b", "00:06")}  # a is still within its five seconds
    land(at(30), at(100, "c"))
    rows = collect(spark, frame(), path).collect()
    # a's state came from the checkpoint; a falls silent a second time, c has not yet
    assert sorted((r.key, r.window_end.isoformat()[14:]) for r in rows) == [("a", "00:15"), ("a", "00:36"), ("b", "00:06")]
    assert {(r.request_rate, r.error_rate, r.bandwidth_rate, r.avg_response_time) for r in rows} == {(0.0,) * 4}


def test_newest_over_a_restart(spark, landing):
    path, land, stream = landing
    views = {"all": (Scope(hours=0), ""), "web": (Scope(hours=0, services=(Service("web", "host"),), exclude=Exclusion(("x",))), ""), "none": (Scope(hours=0), "nowhere")}
    made = [at(k, "ax"[k % 2], host=("web", "api")[k % 3 > 0]) for k in range(90)]

    def run():
        stateful.keep_newest(stateful.newest_requests(stream(), views, limit=5, parts=3), f"{path}/lists", f"{path}/checkpoint").awaitTermination()
        out = {}
        for r in stateful.read_newest(spark, f"{path}/lists", limit=5).orderBy("view", "place").collect():
            out.setdefault(r.view, []).append(r.request_hash)
        return out

    def want(rows):
        newest = sorted(rows, key=lambda r: (r["timestamp"], r["request_hash"]), reverse=True)
        found = {"all": [r["request_hash"] for r in newest[:5]], "web": [r["request_hash"] for r in newest if r["host"] == "web" and r["client_ip"] != "x"][:5]}
        return {k: v for k, v in found.items() if v}

    land(*made[20:40])
    assert run() == want(made[20:40])
    land(*made[:20])  # older ones change nothing
    assert run() == want(made[:40])
    land(*made[60:])
    land(*made[40:60])
    assert run() == want(made)
    assert len(stateful._versions(spark, f"{path}/lists")) <= 2
    assert spark.read.parquet(f"{path}/lists/version={stateful._versions(spark, f'{path}/lists')[-1]}").count() <= 2 * 3 * 5


class _List:
    def __init__(self):
        self.rows = []

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = rows


class _Handle:
    def __init__(self):
        self.lists = {}

    def getListState(self, name, schema):
        return self.lists.setdefault(name, _List())

    def registerTimer(self, at):
        pass


def test_counters_stay_within_their_bounds():
    rng = random.Random(9)
    for most in (5, 20):
        counter, exact, n = stateful._SpaceSaving(most), Counter(), 0
        handle = _Handle()
        counter.init(handle)
        key = (pd.Timestamp("2024-01-01"), 0)
        for _ in range(30):
            clients = [f"c{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(1, 60))]
            exact.update(clients)
            n += len(clients)
            frame = pd.DataFrame({"client_ip": clients, "response_size": 1, "geo_country": "", "at": range(len(clients))})
            list(counter.handleInputRows(key, iter([frame]), None))
            rows = list(handle.lists["counters"].get())
            assert len(rows) <= most and len({r[0] for r in rows}) == len(rows)
            assert all(r[1] - r[2] <= exact[r[0]] <= r[1] and r[2] <= n / most for r in rows)
            floor = min(r[1] for r in rows) if len(rows) >= most else 0
            assert all(c <= floor for ip, c in exact.items() if ip not in {r[0] for r in rows})


def test_a_heavy_client_is_spread_over_parts(spark, landing):
    path, land, stream = landing
    land(*[at(k % 10, "hot", path=f"/{k}") for k in range(300)], *[at(k % 10, f"c{k}", path="/") for k in range(40)], at(200, "end"))
    land(at(300, "end"))
    rows = collect(spark, stateful.heavy_clients(realtime.live(stream(), watermark="1 second"), counters=6, parts=4), path)
    one = rows.filter("window_end = '2024-01-01 10:00:10'")
    assert one.filter("ip = 'hot'").select("part").distinct().count() == 4
    assert one.groupBy("part").count().agg(F.max("count")).first()[0] <= 6
    best = stateful.merged_clients(rows, 1).filter("window_end = '2024-01-01 10:00:10'").first()
    assert best.ip == "hot" and best.request_rate * 15 - best.rate_error * 15 <= 300.001 and best.request_rate * 15 >= 299.999


def test_tasks_send_on_only_what_can_be_newest(spark):
    rows = [("all", i % 2, f"h{i % 300}", i % 300, "GET", "web", "b", "/", 200, 1.0, None, "x") for i in range(900)]
    dealt = spark.createDataFrame(rows, f"view string, part int, request_hash string, at bigint, {stateful._LATEST_TYPES.split(', ', 2)[2]}").repartition(3)
    left = stateful._trimmed(dealt, 5).collect()
    assert len(left) <= 3 * 2 * 5 and len(left) < dealt.count()
    for part in (0, 1):
        newest = sorted({r["at"] for r in left if r["part"] == part}, reverse=True)[:5]
        assert newest == [298 + part - 2 * i for i in range(5)]
    assert stateful._trimmed(dealt.limit(0), 5).count() == 0
