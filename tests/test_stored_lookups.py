"""What is read of the stored table to find repeats, single requests and single clients."""

import pytest
from pyspark.sql import functions as F
from scans import rows_scanned

from hitledger.functions.predicates import Scope
from hitledger.operators import cleaning, clients, rows
from hitledger.schema import conform
from hitledger.session import shared_dir
from hitledger.sources import sinks


@pytest.fixture(scope="module")
def stored(spark):
    """Ninety days of 2 000 requests by 200 clients, in row groups of a few thousand."""
    path = shared_dir(spark, "test-lookups")
    n = F.col("id")
    made = spark.range(180_000).select(
        F.timestamp_micros(F.lit(1_704_067_200_000_000) + n * 43_200_000).alias("timestamp"), F.concat(F.lit("10.0.0."), (n * 7919 % 200).cast("string")).alias("client_ip"),
        F.concat(F.lit("/"), n.cast("string")).alias("path"), F.lit(200).alias("status_code"),
    )
    spark.conf.set("parquet.block.size", str(1 << 20))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        sinks.append_requests(cleaning.with_identity(conform(made)), path, initial=True)
        yield path
    finally:
        spark.conf.unset("parquet.block.size")
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def batch_of(spark, stored, requests_of, *extra):
    """An hour of stored requests again, some new ones of that hour, and ``extra`` (seconds, path)."""
    old = sinks.read_requests(spark, stored).filter(F.col("timestamp").between("2024-03-20 10:00:00", "2024-03-20 10:59:59"))
    new = [{"timestamp": f"2024-03-20 10:{m:02d}:01", "path": f"/new/{m}", "client_ip": "10.9.9.9"} for m in range(60)]
    new += [{"timestamp": t, "path": p, "client_ip": "10.9.9.9"} for t, p in extra]
    return old.unionByName(cleaning.with_identity(requests_of(*new)))


def test_late_row_reads_two_hours(spark, stored, requests_of):
    everything = sinks.read_requests(spark, stored)
    late = ("2024-01-05 03:04:05", "/late")
    batch = batch_of(spark, stored, requests_of, late).cache()
    hours = cleaning.hours_of(batch)
    assert len(hours) == 2 and sorted(map(len, hours.values())) == [0, 1]
    narrowed = cleaning.near(everything, hours)
    fresh = cleaning.new_only(batch, narrowed)
    assert sorted(r.path for r in fresh.select("path").collect()) == sorted(["/late", *(f"/new/{m}" for m in range(60))])
    assert fresh.exceptAll(cleaning.new_only(batch, everything)).isEmpty()
    one_hour = rows_scanned(everything.filter(F.col("timestamp").between("2024-03-20 10:00:00", "2024-03-20 10:59:59")).select("timestamp", "request_hash"))
    read = rows_scanned(narrowed.select("timestamp", "request_hash"))
    # the late hour is ruled out by its Bloom filters; by time alone the row group of that hour is read too
    assert read == one_hour < 20_000
    by_time = {h: [] for h in hours}
    assert read < rows_scanned(cleaning.near(everything, by_time).select("timestamp", "request_hash")) < 40_000
    batch.unpersist()


def test_append_with_late_rows(spark, requests_of):
    path = shared_dir(spark, "test-late")
    day = [{"timestamp": f"2024-03-{d:02d} 10:00:00", "path": f"/{d}", "client_ip": "a"} for d in range(1, 29)]
    sinks.append_requests(cleaning.with_identity(requests_of(*day)), path, initial=True)
    again = [*day[3:5], {"timestamp": "2023-12-31 23:59:59", "path": "/old", "client_ip": "a"}, {"timestamp": "2024-03-01 10:00:00", "path": "/other", "client_ip": "a"}]
    for _ in range(2):
        sinks.append_requests(cleaning.with_identity(requests_of(*again)), path)
    assert sorted(r.path for r in sinks.read_requests(spark, path).select("path").collect()) == sorted([*(d["path"] for d in day), "/old", "/other"])


def test_many_hours_make_few_spans():
    hours = [h * 7_200 for h in range(500)] + [4_000_000 * 3_600, 4_000_001 * 3_600]
    spans = cleaning._spans(hours)
    assert len(spans) == cleaning.MOST_SPANS and spans[-1] == (4_000_000 * 3_600, 4_000_002 * 3_600)
    assert all(any(a <= h < b for a, b in spans) for h in hours)


def test_one_request_by_hash(spark, stored):
    everything = sinks.read_requests(spark, stored)
    some = everything.filter("path = '/77777'").first()
    found = rows.find_by_hash(everything, some.request_hash)
    assert [r.path for r in found.select("path").collect()] == ["/77777"]
    assert rows_scanned(found.select("path")) < 20_000


def test_one_client_reads_a_share(spark, stored):
    def of_client():
        return sinks.read_requests(spark, stored).filter("client_ip = '10.0.0.17'").select("path", "timestamp")

    want, all_read = sorted(map(str, of_client().collect())), rows_scanned(of_client())
    assert all_read == 180_000  # in time order every row group has every client
    sinks.compact(spark, stored, by_client=True)
    assert sorted(map(str, of_client().collect())) == want and rows_scanned(of_client()) < all_read * 0.4
    after = sinks.read_requests(spark, stored)
    tags = spark.createDataFrame([], "ip_address string, friendly_name string, tags string")
    report = clients.ip_stats(after, "10.0.0.17", Scope("2024-04-01", 0), tags=tags)
    assert rows_scanned(report) < all_read * 0.4 and report.first()["total_requests"] == 900
    day = after.filter("timestamp >= '2024-02-10' and timestamp < '2024-02-11' and partition_key = '2024-02'").select("path")
    assert rows_scanned(day) < 58_000 * 0.6 and day.count() == 2_000
