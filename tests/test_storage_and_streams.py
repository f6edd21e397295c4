import time

import pytest
from pyspark.sql import functions as F

from hitledger.functions.predicates import Scope, since
from hitledger.operators import cleaning
from hitledger.plans import all_queries
from hitledger.plans.ingest import ingest
from hitledger.plans.sample import Sample
from hitledger.schema import REQUEST_SCHEMA
from hitledger.session import shared_dir
from hitledger.sources import logs, sinks
from hitledger.streaming import ingest as stream_ingest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines(spark):
    return Sample(spark, SMALL).lines


@pytest.fixture(scope="module")
def table(spark, lines):
    path = shared_dir(spark, "test-table")
    sinks.append_requests(ingest(lines), path, initial=True)
    return path


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_append_is_idempotent(spark, lines, table):
    stored = sinks.read_requests(spark, table)
    before = stored.count()
    assert before == lines.count()
    assert stored.columns == REQUEST_SCHEMA.names
    sinks.append_requests(ingest(lines), table)
    assert sinks.read_requests(spark, table).count() == before


def test_time_filter_prunes_partitions_and_columns(spark, table):
    rows = since(sinks.read_requests(spark, table), "2024-01-31", 24).groupBy("path").count()
    plan = plan_of(rows)
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "PartitionFilters: [" in line)
    assert "partition_key" in scan.split("PartitionFilters:")[1].split("]")[0]
    assert "GreaterThan(timestamp" in scan
    assert scan.split("ReadSchema:")[1].strip().startswith("struct<timestamp:timestamp,path:string>")


def test_parsing_is_not_repeated_by_filters(lines):
    """Filters on parsed columns stay above the parsing step."""
    plan = plan_of(ingest(lines).filter(F.col("status_code") == 200)).split("== Physical Plan ==")[1]
    assert plan.count("from_json") <= 4


def test_top_k_plans(spark, table):
    from hitledger.operators import periods, rankings

    stored = sinks.read_requests(spark, table)
    assert "TakeOrderedAndProject" in plan_of(rankings.top_paths(stored, Scope("2024-01-31", 168)))
    ps = periods.preset_periods("7v7", as_of="2024-01-31")
    plan = plan_of(periods.period_top_paths(periods.in_periods(stored, ps)))
    assert plan.split("== Physical Plan ==")[1].count("WindowGroupLimit") == 2
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_dedupe_limits_before_shuffle(spark, table):
    plan = plan_of(cleaning.dedupe(sinks.read_requests(spark, table), all_hashed=True)).split("== Physical Plan ==")[1]
    assert plan.count("WindowGroupLimit") == 2


def test_retention(spark, requests_of):
    path = shared_dir(spark, "test-retention")
    rows = [{"timestamp": f"2024-{m:02d}-{d:02d} 12:00:00", "client_ip": "a", "path": f"/{m}/{d}"} for m in (1, 2, 3) for d in (5, 25)]
    sinks.append_requests(cleaning.with_identity(requests_of(*rows)), path, initial=True)
    assert sinks.apply_retention(spark, path, as_of="2024-03-30", days=40) == ["2024-01"]
    left = sorted(r["path"] for r in sinks.read_requests(spark, path).collect())
    assert left == ["/2/25", "/3/25", "/3/5"]
    assert sinks.apply_retention(spark, path, as_of="2024-03-30", days=0) == []


def test_retention_query_reads_events_once(spark, tmp_path, monkeypatch):
    """Events are dealt to the tasks while narrow, and both copies of a request come from one parsed row."""
    rows = [(i, i % 3, f"2024-01-{i % 28 + 1:02d} 10:00:00", "click", 1.5) for i in range(56)] + [(0, 0, "2024-01-01 10:00:00", "click", 1.5)]
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts string, event_type string, value double")
    events.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    plans, append = [], sinks.append_requests
    monkeypatch.setattr(sinks, "append_requests", lambda df, *a, **k: plans.append(plan_of(df).split("== Physical Plan ==")[1]) or append(df, *a, **k))
    got = {r["partition_key"]: r["hits"] for r in all_queries.QUERIES["apply_retention"](spark, str(tmp_path)).collect()}
    assert got == {"2024-01": 36}
    assert plans[0].count("FileScan") == 1 and plans[0].count("hashpartitioning(event_id") == 1


def test_a_stream_plans_its_parsing_once(spark, lines, monkeypatch):
    work, planned, judged = shared_dir(spark, "plans"), [], stream_ingest.judged_requests
    monkeypatch.setattr(stream_ingest, "judged_requests", lambda df, **options: planned.append(1) or judged(df, **options))
    for _ in range(2):
        lines.select("value").coalesce(1).write.mode("append").text(f"{work}/landing")
    source = logs.stream_lines(spark, f"{work}/landing", max_files=1)
    stream_ingest.start_ingest(source, f"{work}/table", f"{work}/checkpoint", interval=None).awaitTermination()
    assert len(planned) == 1
    assert sinks.read_requests(spark, f"{work}/table").count() == lines.select("value").distinct().count()
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_a_stream_makes_parsed_columns_in_projections_and_keeps_a_batch_once(spark, lines, monkeypatch):
    """The generator behind the parsed columns has nothing to evaluate, and a batch that only the append reads is not kept before it."""
    work, plans, append = shared_dir(spark, "kept"), [], stream_ingest.append_requests
    monkeypatch.setattr(stream_ingest, "append_requests", lambda df, path: plans.append(plan_of(df).split("== Physical Plan ==")[1]) or append(df, path))
    lines.select("value").coalesce(1).write.text(f"{work}/landing")
    source = logs.stream_lines(spark, f"{work}/landing")
    query = stream_ingest.start_ingest(source, f"{work}/table", f"{work}/checkpoint", interval=None)
    query.awaitTermination()
    assert len(plans) == 1 and "InMemoryTableScan" not in plans[0]
    parsed = plan_of(stream_ingest.judged_requests(logs.read_lines(spark, f"{work}/landing"))).split("== Physical Plan ==")[1]
    assert "Generate inline(array(_made" in parsed
    assert sinks.read_requests(spark, f"{work}/table").count() == lines.select("value").distinct().count()


def test_stream_ingest_resumes_and_keeps_late_rows(spark, lines):
    work = shared_dir(spark, "test-stream")
    landing = f"{work}/landing"

    def land(part):
        lines.filter(F.col("id") % 2 == part).select("value").coalesce(1).write.mode("append").text(landing)

    def run():
        source = logs.stream_lines(spark, landing)
        stream_ingest.start_ingest(source, f"{work}/table", f"{work}/checkpoint", interval=None).awaitTermination()
        return sinks.read_requests(spark, f"{work}/table").count()

    total = lines.count()
    even = lines.filter(F.col("id") % 2 == 0).count()
    land(0)
    assert run() == even
    land(1)
    assert run() == total
    land(0)
    assert run() == total


def test_stream_dedupe(spark, requests_of):
    path = shared_dir(spark, "test-dedupe")
    rows = cleaning.with_identity(requests_of(*[{"timestamp": "2024-01-01 00:00:01", "client_ip": str(n % 3)} for n in range(9)]))
    rows.write.parquet(path)
    source = spark.readStream.schema(rows.schema).parquet(path)
    query = stream_ingest.dedupe_stream(source).writeStream.format("memory").queryName("deduped").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("deduped").count() == 3


def test_source_names(spark):
    df = spark.createDataFrame([("file:///var/log/access.log.1",), ("file:///x/y/site-a.json",)], "p string")
    got = [r[0] for r in df.select(logs.source_name(F.col("p"), "traefik")).collect()]
    assert got == ["traefik-access", "traefik-site-a"]


def test_latest_rows_carry_over_between_batches(spark):
    from hitledger.streaming.realtime import merge_latest

    rows = lambda *ids: spark.createDataFrame([(str(i), i * 1.0) for i in ids], "request_hash string, timestamp double")
    first = merge_latest(rows(1, 5, 3), None, 2)
    second = merge_latest(rows(4, 2), first, 3)
    assert [r["request_hash"] for r in second.collect()] == ["5", "4", "3"]


def test_rows_later_than_the_watermark_change_no_window(spark, requests_of):
    from hitledger.streaming import realtime as stream

    work = shared_dir(spark, "test-late")
    second = lambda n: f"2024-01-01 00:{n // 60:02d}:{n % 60:02d}"
    files = [
        [{"timestamp": second(n), "client_ip": "a", "status_code": 200} for n in range(0, 301, 10)],
        [{"timestamp": second(295), "client_ip": "b", "status_code": 200}],
        [{"timestamp": second(12), "client_ip": "late", "status_code": 500}],  # the mark was set by the first file, windows closed with the second
        [{"timestamp": second(500), "client_ip": "c", "status_code": 200}],
    ]
    for rows in files:
        requests_of(*rows).coalesce(1).write.mode("append").parquet(f"{work}/in")
        time.sleep(1.1)  # files are read in the order of their times
    schema = requests_of(files[0][0]).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/in")
    stream.run_to_table(stream.rates(stream.live(source)), f"{work}/out", f"{work}/cp").awaitTermination()
    out = {r["window_end"].strftime("%M:%S"): r for r in spark.read.parquet(f"{work}/out").collect()}
    assert (out["00:13"]["request_rate"], out["00:13"]["error_rate"]) == (0.2, 0.0)  # the row of second 10 alone
    assert out["04:57"]["request_rate"] == 0.2  # five seconds late is in time


def test_files_are_told_apart_without_sorting_their_lines(spark):
    path = shared_dir(spark, "test-sniff")
    flat = '{"ClientAddr":"1.2.3.4:5","RequestMethod":"GET","RequestPath":"/","DownstreamStatus":200,"StartUTC":"2024-03-01T00:00:00Z"}'
    spark.createDataFrame([("a", ["", flat] + ["no log"] * 50), ("b", ["no log", flat])], "dialect string, value array<string>").selectExpr("dialect", "explode(value) AS value").coalesce(1).write.partitionBy("dialect").text(path)
    found = logs.sniff_sources(logs.read_lines(spark, path))
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r.file_path.split("dialect=")[1][0] for r in found.collect()] == ["a"]
