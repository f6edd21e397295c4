"""Months of the stored table: replacement, compaction, pruning, side outputs."""

import glob
import os
from datetime import datetime, timezone

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from hitledger.functions.predicates import Scope
from hitledger.operators import cleaning, clients, periods, rows, summary
from hitledger.plans.ingest import ingest, judged_requests, refused
from hitledger.session import shared_dir
from hitledger.sources import logs, sinks
from hitledger.streaming import ingest as stream_ingest


@pytest.fixture
def table(spark, requests_of):
    path = shared_dir(spark, "test-upkeep")
    made = [{"timestamp": f"2024-{m:02d}-{d:02d} 12:00:00", "client_ip": "a", "path": f"/{m}/{d}"} for m in (1, 2, 3) for d in (5, 25)]
    for r in made:  # one append each
        sinks.append_requests(cleaning.with_identity(requests_of(r)), path)
    return path


def contents(spark, path):
    return sorted(map(str, sinks.read_requests(spark, path).collect()))


def test_failed_replacement_leaves_the_month(spark, table, monkeypatch):
    before = contents(spark, table)
    real = sinks.write_requests
    monkeypatch.setattr(sinks, "write_requests", lambda df, path, **k: real(df.limit(0) if "_new-" in path else df, path, **k))
    with pytest.raises(Exception):
        sinks.apply_retention(spark, table, as_of="2024-03-02", days=20)
    with pytest.raises(Exception):
        sinks.compact(spark, table, ["2024-03"])
    assert [r for r in before if "2024-02" in r or "2024-03" in r] == [r for r in contents(spark, table) if "2024-01" not in r]


def test_compaction(spark, table):
    before = contents(spark, table)
    assert len(glob.glob(f"{table}/partition_key=2024-01/*.parquet")) == 2
    assert sinks.compact(spark, table) == ["2024-01", "2024-02", "2024-03"]
    assert len(glob.glob(f"{table}/partition_key=2024-01/*.parquet")) == 1
    assert contents(spark, table) == before and not glob.glob(f"{table}/_*new*") and not glob.glob(f"{table}/_old*")


def test_files_carry_time_statistics(table):
    for f in glob.glob(f"{table}/partition_key=*/*.parquet"):
        meta = pq.ParquetFile(f).metadata.row_group(0)
        at = next(meta.column(i) for i in range(meta.num_columns) if meta.column(i).path_in_schema == "timestamp")
        assert at.statistics.has_min_max


def test_one_hour_skips_row_groups(spark, requests_of):
    path = shared_dir(spark, "test-groups")
    many = requests_of({"timestamp": "2024-01-01 00:00:00", "client_ip": "a"}).select(F.explode(F.sequence(F.lit(0), F.lit(49_999))).alias("n"), "*")
    many = many.withColumns({"timestamp": F.timestamp_seconds(F.lit(1_704_067_200) + F.col("n") * 50), "requests_total": F.col("n").cast("int")}).drop("n")
    spark.sparkContext._jsc.hadoopConfiguration().setInt("parquet.block.size", 65_536)
    try:
        sinks.append_requests(cleaning.with_identity(many), path, initial=True)
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
    report = summary.summary(sinks.read_requests(spark, path), Scope("2024-01-29 22:26:00", 1))
    assert report.first()["total_requests"] == 72
    assert "GreaterThan(timestamp" in report._jdf.queryExecution().toString()
    start, spans = datetime(2024, 1, 29, 21, 26, tzinfo=timezone.utc), []
    for f in glob.glob(f"{path}/partition_key=2024-01/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        at = next(i for i in range(meta.num_columns) if meta.row_group(0).column(i).path_in_schema == "timestamp")
        spans += [(meta.row_group(g).num_rows, meta.row_group(g).column(at).statistics.max) for g in range(meta.num_row_groups)]
    assert len(spans) > 3 and sum(n for n, last in spans if last > start) < 25_000  # the others cannot match


def test_gap_between_periods_is_not_read(spark, table):
    ps = periods.periods_of(("a", "2024-01-01", "2024-01-10"), ("b", "2024-03-01", "2024-03-10"))
    found = periods.in_periods(sinks.read_requests(spark, table), ps)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = found._jdf.queryExecution().toString()
    filters = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "2024-01" in filters and "2024-03" in filters and filters.count("partition_key") >= 4
    assert found.count() == 2


def test_row_reports_on_the_stored_table(spark, table):
    stored = sinks.read_requests(spark, table)
    newest = rows.recent_requests(stored, limit=2).collect()
    assert [r["path"] for r in newest] == ["/3/25", "/3/5"]
    assert rows.find_by_hash(stored, newest[0]["request_hash"], "2024-03").count() == 1
    assert [r["path"] for r in clients.ip_recent_requests(stored, "a", Scope(hours=0), 1).collect()] == ["/3/25"]


def test_negative_windows_and_limits_are_errors(spark, table):
    with pytest.raises(ValueError):
        Scope("2024-01-01", -1)
    ps = periods.periods_of(("a", "2024-01-01", "2024-01-10"), ("b", "2024-03-01", "2024-03-10"))
    with pytest.raises(ValueError):
        periods.period_top_paths(periods.in_periods(sinks.read_requests(spark, table), ps), 0)


def test_reports_on_all_clients_do_not_sort_globally(spark, table):
    stored = sinks.read_requests(spark, table)
    for report in (clients.ip_heatmap(stored, None, Scope(hours=0), days=0), clients.ip_top_paths(stored, None, Scope(hours=0), 3)):
        assert "rangepartitioning" not in report._jdf.queryExecution().toString().lower()


GOOD = '{"request_X-Real-Ip":"192.0.2.1","time":"2024-01-01T00:00:0%d.5Z","RequestPath":"/p","DownstreamStatus":200,"request_X-Forwarded-Proto":"%s"}'


def test_refused_rows_are_kept_with_their_reason(spark):
    lines = spark.createDataFrame([(GOOD % (n, "gopher" if n == 2 else "https"),) for n in range(4)] + [("what",)], "value string")
    judged = judged_requests(lines)
    assert ingest(lines).count() == 3
    assert sorted((r.reason, r.value) for r in refused(lines, judged).collect()) == [("request_scheme", ""), ("unknown_format", "what")]


def test_stream_writes_refused_rows_and_places(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join([GOOD % (1, "https"), GOOD % (2, "gopher"), "what", GOOD % (3, "")]))

    def places(clients_):
        return clients_.select(
            "client_ip", F.lit("NA").alias("geo_country"), F.lit("Town").alias("geo_city"), F.lit(1.0).alias("geo_lat"),
            F.lit(2.0).alias("geo_lon"), F.lit(64500).alias("asn"), F.lit("ORG").alias("asn_org"),
        )

    out, bad = str(tmp_path / "table"), str(tmp_path / "rejects")
    q = stream_ingest.start_ingest(logs.stream_lines(spark, str(tmp_path / "in")), out, str(tmp_path / "cp"), places=places, rejects_path=bad, interval=None)
    q.awaitTermination()
    assert [(r.geo_city, r.asn) for r in sinks.read_requests(spark, out).collect()] == [("Town", 64500)] * 2
    assert sorted(r.reason for r in spark.read.parquet(bad).collect()) == ["request_scheme", "unknown_format"]
    assert os.path.isdir(f"{bad}/batch=0")
