"""Writing the request table: append, retention and exports."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitledger.functions.instants import utc
from hitledger.operators.cleaning import dedupe, hours_of, near, new_only, retain
from hitledger.schema import REQUEST_SCHEMA


#: Row groups carry Bloom filters of the columns that single rows and single clients are looked up by. Their
#: size follows the number of values.
_BLOOM = {f"parquet.bloom.filter.enabled#{c}": "true" for c in ("request_hash", "client_ip")} | {"parquet.bloom.filter.adaptive.enabled": "true"}


def client_time_order() -> Column:
    """A number whose bits come by turns from the client's hash and the day of the month: near numbers share both."""
    day = F.dayofmonth(F.to_date(F.date_trunc("day", "timestamp"))) - 1
    client = F.pmod(F.xxhash64("client_ip"), F.lit(32)).cast("int")
    bits = [F.shiftleft(F.shiftright(c, k).bitwiseAND(F.lit(1)), 2 * k + side) for k in range(5) for side, c in enumerate((day, client))]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return fs.exists(where)


def folders_of(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below ``path``, sorted; none if it does not exist."""
    fs, root = _file_system(spark, path)
    if not fs.exists(root):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(root) if status.isDirectory())


def delete_folders(spark: SparkSession, paths: Sequence[str]) -> None:
    for path in paths:
        fs, where = _file_system(spark, path)
        fs.delete(where, True)


def months_of(spark: SparkSession, path: str) -> list[str]:
    """The months the table has, by the names of its folders."""
    return [n.removeprefix("partition_key=") for n in folders_of(spark, path) if n.startswith("partition_key=")]


def read_requests(spark: SparkSession, path: str, months: Sequence[str] | None = None) -> DataFrame:
    """The stored table, or only the folders of ``months``; month partitions stay text, as the filters expect."""
    folders = [path] if months is None else [f"{path}/partition_key={m}" for m in months]
    if not folders:
        return spark.createDataFrame([], REQUEST_SCHEMA)
    return spark.read.schema(REQUEST_SCHEMA).option("basePath", path).parquet(*folders).select(*REQUEST_SCHEMA.names)


def write_requests(df: DataFrame, path: str, *, mode: str = "append", by_client: bool = False) -> None:
    """Write by month. The rebalance step sizes files to the advisory partition size, splitting a
    month that holds most rows and merging small ones; files are sorted by time.

    ``by_client`` lays rows out by day and client instead, in ranges that interleave the two: a row group then
    has some days of some clients. Times are 64-bit microseconds, the form that carries row-group statistics, so
    that time filters skip row groups; Bloom filters do that for a hash or a client.
    """
    df.sparkSession.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    if by_client:
        key = client_time_order()
        laid_out = df.repartitionByRange("partition_key", key).sortWithinPartitions("partition_key", key, "client_ip", "timestamp")
    else:
        laid_out = df.hint("rebalance", F.col("partition_key")).sortWithinPartitions("partition_key", "timestamp")
    laid_out.write.mode(mode).options(**_BLOOM).partitionBy("partition_key").parquet(path)


def append_requests(batch: DataFrame, path: str, *, initial: bool = False) -> list[int] | None:
    """Append rows (all with a request hash) that are neither repeated in the batch nor stored already.

    The batch is de-duplicated first, so a request that fills most of it meets the stored rows once. Only the
    batch's months are listed, and of them only row groups of the batch's hours are read: a late row adds its own
    hour. ``initial`` is the bulk load into an empty table: only the batch itself is de-duplicated. Running the
    same batch again adds nothing, so a retried micro-batch is harmless.

    Returns the hours (first seconds) the batch has rows of, for what is kept by hour; None stands for all hours
    of the table, after a load into an empty one.
    """
    spark, batch = batch.sparkSession, dedupe(batch, all_hashed=True)
    present = [] if initial else months_of(spark, path)
    if not present:
        write_requests(batch, path)
        return None
    # The batch is read for its hours and its rows; keep the parsed form meanwhile.
    batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        hours = hours_of(batch)
        touched = {datetime.fromtimestamp(h, timezone.utc).strftime("%Y-%m") for h in hours}
        stored = read_requests(spark, path, [m for m in present if m in touched])
        write_requests(new_only(batch, near(stored, hours)), path)
        return list(hours)
    finally:
        batch.unpersist()


def _replace_month(spark: SparkSession, path: str, month: str, rows: DataFrame, expected: int, **layout: bool) -> None:
    """Put ``rows`` in the place of a month, or remove it if there are none.

    They are written beside the table's months, on the table's own file system, and counted before anything is
    moved. Readers skip folders that begin with an underscore. If a step fails, the month or, in the instant
    between the two renames, its set-aside copy is still there.
    """
    fs, root = _file_system(spark, path)
    new = f"{path}/_new-{uuid.uuid4().hex[:12]}"
    write_requests(rows, new, mode="errorifexists", **layout)
    written = spark.read.schema(REQUEST_SCHEMA).parquet(new).count()
    if written != expected:
        fs.delete(_path(spark, new), True)
        raise RuntimeError(f"month {month}: {written} rows written, {expected} expected; the month is unchanged")
    live, aside = _path(spark, f"{path}/partition_key={month}"), _path(spark, f"{path}/_old-{uuid.uuid4().hex[:12]}")
    if not fs.rename(live, aside):
        raise RuntimeError(f"month {month} could not be set aside")
    if expected and not fs.rename(_path(spark, f"{new}/partition_key={month}"), live):
        fs.rename(aside, live)
        raise RuntimeError(f"month {month} could not be replaced and was put back")
    fs.delete(aside, True)
    fs.delete(_path(spark, new), True)


def apply_retention(spark: SparkSession, path: str, *, as_of, days: int = 60) -> list[str]:
    """Delete rows older than ``days``: whole old months by folder, the boundary month by rewrite.

    Returns the months dropped.
    """
    if days <= 0:
        return []
    boundary = (utc(as_of) - timedelta(days=days)).strftime("%Y-%m")
    months = months_of(spark, path)
    old = [m for m in months if m < boundary]
    delete_folders(spark, [f"{path}/partition_key={month}" for month in old])
    if boundary in months:
        kept = retain(read_requests(spark, path, [boundary]), as_of=as_of, days=days)
        left = kept.count()
        _replace_month(spark, path, boundary, kept, left)
        if not left:
            old.append(boundary)
    return old


def compact(spark: SparkSession, path: str, months: Sequence[str] | None = None, *, by_client: bool = False) -> list[str]:
    """Rewrite months into files of the advisory size, as many small appends call for.

    Sorted by time, or ``by_client`` in the order that suits reports on single clients (see ``write_requests``).
    """
    done = [m for m in months_of(spark, path) if months is None or m in months]
    for month in done:
        rows = read_requests(spark, path, [month])
        _replace_month(spark, path, month, rows, rows.count(), by_client=by_client)
    return done


def export_csv(df: DataFrame, path: str) -> None:
    """Any report as CSV with a header line."""
    df.write.mode("overwrite").option("header", True).csv(path)
