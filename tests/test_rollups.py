"""Hourly rollups: what they read, upkeep by ingest and retention, scopes they refuse."""

import pytest
from pyspark.sql import functions as F
from scans import scans

from hitledger.functions.predicates import Exclusion, Scope, Service
from hitledger.operators import cleaning, rollup
from hitledger.plans.sample import Sample
from hitledger.session import shared_dir
from hitledger.sources import logs, rollups, sinks
from hitledger.streaming import ingest as stream_ingest

SUMS = ["hour", "backend_name", "backend_url", "host", "requests", "failed_requests", "bandwidth", "measured", "slowest", "last_seen"]


def figures(df, columns=SUMS):
    return sorted(map(str, df.select(*columns).collect()))


def test_reports_read_no_request(spark, requests_of):
    table, path = shared_dir(spark, "test-rolled"), shared_dir(spark, "test-rollup")
    made = [{"timestamp": f"2024-03-{d:02d} {h:02d}:10:00", "client_ip": f"c{d % 7}", "host": f"h{h % 3}", "path": f"/{h}", "status_code": 200, "response_time_ms": float(h)} for d in range(1, 21) for h in range(24)]
    sinks.append_requests(cleaning.with_identity(requests_of(*made)), table, initial=True)
    rollups.refresh(spark, table, path)
    kept = rollups.read_rollup(spark, path)
    week = Scope("2024-03-21", 168, services=(Service("h1", "host"),))
    for report in (
        rollup.summary_from_rollup(kept, week), rollup.timeline_from_rollup(kept, week), rollup.top_from_rollup(kept, week, "host"), rollup.response_times_from_rollup(kept, week),
    ):
        found = scans(report)
        assert found and all("test-rollup" in where for where, _ in found)
    got = rollup.summary_from_rollup(kept, week).first()
    assert (got.total_requests, got.unique_visitors, got.unique_files) == (56, 7, 8)
    times = rollup.response_times_from_rollup(kept, week).first()
    assert (times["min"], times["max"], times["p50"], times["p99"]) == (1.0, 22.0, 10.0, 22.0)
    for wrong in (Scope("2024-03-21", 168, exclude=Exclusion(("c1",))), Scope("2024-03-21 00:30:00", 168)):
        with pytest.raises(ValueError):
            rollup.summary_from_rollup(kept, wrong)
    with pytest.raises(ValueError):
        rollup.summary_from_rollup(rollup.hourly_rollup(sinks.read_requests(spark, table), ["path"]), week)

    # retention: the cutoff's day is made anew, earlier days go
    sinks.apply_retention(spark, table, as_of="2024-03-21 12:00:00", days=10)
    assert rollups.retain(spark, table, path, as_of="2024-03-21 12:00:00", days=10) == [f"2024-03-{d:02d}" for d in range(1, 11)]
    assert figures(rollups.read_rollup(spark, path)) == figures(rollup.hourly_rollup(sinks.read_requests(spark, table)))


def test_stream_keeps_rollups(spark):
    work = shared_dir(spark, "test-stream-rollup")
    lines = Sample(spark, "/root/testdata/sf0.001").lines
    lines.filter("id % 2 = 0").coalesce(1).select("value").write.text(f"{work}/landing")
    kept = {f"{work}/services": rollup.SERVICE_KEYS, f"{work}/paths": ("path",)}

    def run(checkpoint):
        stream = logs.stream_lines(spark, f"{work}/landing", max_files=1)
        stream_ingest.start_ingest(stream, f"{work}/table", f"{work}/{checkpoint}", rollups=kept, interval=None).awaitTermination()

    run("first")
    lines.filter("id % 3 = 0").coalesce(1).select("value").write.mode("append").text(f"{work}/landing")
    run("first")
    run("lost")  # everything again from a new checkpoint: nothing is counted twice
    table = sinks.read_requests(spark, f"{work}/table")
    assert table.count() == lines.filter("id % 2 = 0 or id % 3 = 0").count()
    assert figures(rollups.read_rollup(spark, f"{work}/services")) == figures(rollup.hourly_rollup(table))
    columns = ["hour", "path", "requests", "bandwidth"]
    assert figures(rollups.read_rollup(spark, f"{work}/paths"), columns) == figures(rollup.hourly_rollup(table, ["path"]), columns)


def test_estimates_over_merged_hours(spark, requests_of):
    rows = requests_of({"timestamp": "2024-01-01 00:00:00"}).crossJoin(spark.range(60_000)).withColumns(
        {
            "timestamp": F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 10), "client_ip": F.concat(F.lit("c"), (F.col("id") * 7919 % 20_000).cast("string")),
            "response_time_ms": (F.col("id") * 7919 % 50_000 + 1).cast("double"),
        }
    )
    kept = rollup.hourly_rollup(rows)
    found = rollup.summary_from_rollup(kept, Scope(hours=0)).first()
    assert abs(found.unique_visitors - 20_000) <= 20_000 * rollup.DISTINCT_ERROR and found.total_requests == 60_000
    times = rollup.response_times_from_rollup(kept, Scope(hours=0)).first()
    for p, share in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        assert abs(times[p] / 50_000 - share) <= rollup.RANK_ERROR
    assert rollup.summary_from_rollup(kept.limit(0), Scope(hours=0)).first().total_requests == 0


def test_rows_meet_before_their_sketches_are_made(spark, requests_of):
    """No sketch is shuffled: one exchange, of the rows, below both aggregates."""
    rows = requests_of(*({"timestamp": f"2024-03-01 {i % 3:02d}:10:00", "client_ip": f"c{i}", "host": f"h{i % 2}", "backend_name": "b", "backend_url": "", "status_code": 200, "response_time_ms": 1.0} for i in range(40)))
    made = rollup.hourly_rollup(rows.repartition(4))
    above = made._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")
    assert len(above) == 2 and above[0].count("Aggregate") == 2 and "Aggregate" not in above[1]
    assert sorted((r.requests, r.clients) for r in made.selectExpr("requests", "hll_sketch_estimate(clients) AS clients").collect()) == [(6, 6)] * 2 + [(7, 7)] * 4
