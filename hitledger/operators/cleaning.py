"""Identity, de-duplication, validity and retention of stored requests."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitledger.functions.fixed_values import REQUEST_SCHEMES
from hitledger.functions.instants import bucket_key, instant, month_key, utc

# Fixed value: fields that identify a request, in hash order.
IDENTITY = (
    "client_ip", "method", "host", "path", "query_string", "status_code", "duration", "start_utc", "requests_total",
)

#: Hours of at most this many rows are looked up by hash, if there are no more than this many of them.
FEW_ROWS, FEW_HOURS = 8, 32
#: Parts of the time filter on stored rows.
MOST_SPANS = 64
_HOUR = 3_600


def request_hash() -> Column:
    """SHA-256 of the whole second and the identity fields; the source is not part of it."""
    fields = [F.unix_seconds("timestamp"), *(F.col(c) for c in IDENTITY)]
    return F.sha2(F.concat_ws("|", *(f.cast("string") for f in fields)), 256)


def with_identity(df: DataFrame) -> DataFrame:
    return df.withColumns({"request_hash": request_hash(), "partition_key": month_key(F.col("timestamp"))})


def dedupe(df: DataFrame, *, order: tuple[str, ...] = (), all_hashed: bool = False) -> DataFrame:
    """One row per request hash, the first in ``order``, then by a hash of the row; rows without a hash all stay.

    ``all_hashed`` says that every row has a hash (ingest computes it), which saves the second scan.

    The rank-one filter also runs before the shuffle, so copies of one request collapse where they
    are read, and a hash that fills a third of the table never meets in one task.
    """
    hashed = df if all_hashed else df.filter(F.col("request_hash") != "")
    rest = [c for c, kind in hashed.dtypes if not kind.startswith(("map", "variant")) and c not in ("request_hash", *order)]
    first = Window.partitionBy("request_hash").orderBy(*(order or ("timestamp",)), F.xxhash64(*rest))
    kept = hashed.withColumn("_copy", F.row_number().over(first)).filter(F.col("_copy") == 1).drop("_copy")
    return kept if all_hashed else kept.unionByName(df.filter(F.col("request_hash") == ""))


def hours_of(batch: DataFrame) -> dict[int, list[str]]:
    """Hours (first second) that a batch touches, with the hashes of those that have few rows.

    One row for each hour comes to the driver, and the hashes of at most ``FEW_HOURS`` hours.
    """
    hour = bucket_key(F.col("timestamp"), "hour").alias("hour")
    counts = {r["hour"]: r["n"] for r in batch.groupBy(hour).agg(F.count("*").alias("n")).collect()}
    few = sorted(h for h, n in counts.items() if n <= FEW_ROWS)
    hours: dict[int, list[str]] = {h: [] for h in sorted(counts)}
    if few and len(few) <= FEW_HOURS:
        for r in batch.select(hour, "request_hash").filter(F.col("hour").isin(few)).collect():
            hours[r["hour"]].append(r["request_hash"])
    return hours


def _spans(hours: list[int]) -> list[tuple[int, int]]:
    """Neighbouring hours as one span; beyond ``MOST_SPANS`` they are joined over the shortest gaps."""
    spans: list[tuple[int, int]] = []
    for start in sorted(hours):
        if spans and spans[-1][1] == start:
            spans[-1] = (spans[-1][0], start + _HOUR)
        else:
            spans.append((start, start + _HOUR))
    gaps = sorted(range(1, len(spans)), key=lambda k: spans[k][0] - spans[k - 1][1])
    joined = set(gaps[: max(0, len(spans) - MOST_SPANS)])
    out: list[tuple[int, int]] = []
    for at, span in enumerate(spans):
        if at in joined:
            out[-1] = (out[-1][0], span[1])
        else:
            out.append(span)
    return out


def near(stored: DataFrame, hours: dict[int, list[str]]) -> DataFrame:
    """The stored rows that a batch of these hours can repeat, by filters that Parquet readers take.

    Equal hashes imply equal seconds, so row groups outside the batch's hours are not read. Hours of few rows,
    as late rows make them, are looked up by time and hash in a scan of their own, where the row groups' Bloom
    filters decide: beside a filter on time alone they could not.
    """

    def within(start: int, end: int) -> Column:
        return (F.col("timestamp") >= F.timestamp_micros(F.lit(start * 1_000_000))) & (F.col("timestamp") < F.timestamp_micros(F.lit(end * 1_000_000)))

    busy = [within(*span) for span in _spans([h for h, hashes in hours.items() if not hashes])]
    few = [within(h, h + _HOUR) & F.col("request_hash").isin(hashes) for h, hashes in hours.items() if hashes]
    parts = [stored.filter(reduce(or_, tests)) for tests in (busy, few) if tests]
    return reduce(DataFrame.unionByName, parts) if parts else stored.limit(0)


def new_only(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``batch`` whose hash is not stored yet.

    Only stored rows of the batch's hours meet it: equal hashes imply equal seconds. Months are pruned at run
    time. A caller that may run a job first narrows the scan too, with :func:`hours_of` and :func:`near`.
    """
    hour = bucket_key(F.col("timestamp"), "hour").alias("_hour")
    span = batch.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    lo, hi = (F.date_trunc("second", span.select(c).scalar()) for c in ("lo", "hi"))
    hours = F.broadcast(batch.select("partition_key", hour).distinct())  # one row for each hour
    known = stored.filter((F.col("timestamp") >= lo) & (F.col("timestamp") < hi + F.expr("INTERVAL 1 SECOND")))
    known = known.filter(F.col("request_hash") != "").select("partition_key", "request_hash", hour)
    keys = known.join(hours, ["partition_key", "_hour"], "left_semi").drop("_hour")
    return batch.join(keys, ["partition_key", "request_hash"], "left_anti")


def validity_reason() -> Column:
    """First broken rule of a row, or ''. Nulls break no rule."""
    rules = {
        "client_port": ~F.col("client_port").between(0, 65_535),
        "request_scheme": ~F.col("request_scheme").isin(*REQUEST_SCHEMES),
        "status_code": ~F.col("status_code").between(0, 599),
        "upstream_status": ~F.col("upstream_status").between(0, 599),
    }
    amounts = (
        "request_length", "response_size", "response_time_ms", "duration", "upstream_response_time_ms",
        "retry_attempts", "requests_total",
    )
    rules |= {c: F.col(c) < 0 for c in amounts}
    reason = F.lit("")
    for name, broken in reversed(rules.items()):
        reason = F.when(broken, name).otherwise(reason)
    return reason


def valid_rows(df: DataFrame) -> DataFrame:
    return df.filter(validity_reason() == "")


def invalid_rows(df: DataFrame) -> DataFrame:
    return df.withColumn("broken_rule", validity_reason()).filter(F.col("broken_rule") != "")


def retain(df: DataFrame, *, as_of, days: int = 60) -> DataFrame:
    """Rows that survive retention; 0 days keeps everything."""
    if days <= 0:
        return df
    cutoff = utc(as_of) - timedelta(days=days)
    df = df.filter(F.col("timestamp") >= instant(cutoff))
    if "partition_key" in df.columns:
        df = df.filter(F.col("partition_key") >= cutoff.strftime("%Y-%m"))
    return df
