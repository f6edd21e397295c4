"""Reading raw log lines, in batch and as a stream."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitledger.functions import fixed_values as fv
from hitledger.functions import measures as m
from hitledger.functions.instants import instant, utc
from hitledger.sources import json_lines as jl
from hitledger.sources.parsers import NESTED_JSON, PLAIN_CLF, PROXY_CLF, detect_format


def source_name(file_path: Column, parser: str) -> Column:
    """``<parser>-<file name up to its first dot>``."""
    stem = F.regexp_extract(F.replace(file_path, F.lit("\\"), F.lit("/")), r"([^/.]*)[^/]*$", 1)
    return F.concat(F.lit(f"{parser}-"), stem)


def _with_origin(lines: DataFrame, parser: str) -> DataFrame:
    path = F.col("_metadata.file_path")
    rows = lines.select(
        "value", source_name(path, parser).alias("source_name"), path.alias("file_path"),
        F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_modification_time").alias("ingest_time"),
    )
    return rows.filter(F.col("value") != "")


def read_lines(spark: SparkSession, path, *, parser: str = "traefik", modified_after: str | None = None) -> DataFrame:
    """Non-empty lines of log files with source name and file facts.

    ``ingest_time``, for lines with an unreadable time, is when their file was written: reading a file
    again gives the same rows.
    ``modified_after`` skips whole files by modification time without opening them.
    """
    options = {"modifiedAfter": modified_after} if modified_after else {}
    return _with_origin(spark.read.options(**options).text(path), parser)


def stream_lines(spark: SparkSession, path: str, *, parser: str = "traefik", max_files: int = 1_000) -> DataFrame:
    """Lines of files that land in ``path``; the stream's checkpoint remembers files already read.

    Files must be complete when they appear (rotated logs): a growing file is read once.
    """
    return _with_origin(spark.readStream.option("maxFilesPerTrigger", max_files).text(path), parser)


def initial_import(df: DataFrame, *, as_of, days: int = 60) -> DataFrame:
    """Only the last ``days`` days of events; 0 imports everything."""
    return df if days <= 0 else df.filter(F.col("timestamp") >= instant(utc(as_of) - timedelta(days=days)))


def sniff_sources(lines: DataFrame) -> DataFrame:
    """Parser of each file by its first line; files of an unknown format are left out.

    Flat proxy JSON needs two of its five marker keys. The places of the first lines are found first, as
    numbers, so no line is sorted or shuffled; one number per file is broadcast.
    """
    placed = lines.select("file_path", "value", F.monotonically_increasing_id().alias("place"))
    places = placed.groupBy("file_path").agg(F.min("place").alias("place")).select("place")
    first = placed.join(F.broadcast(places), "place", "left_semi").select("file_path", "value")
    line = F.col("value")
    looked = detect_format(first).withColumn("doc", F.when(F.startswith(line, F.lit("{")), F.try_parse_json(line)))
    marks = [jl.present(F.col("doc"), k).cast("int") for k in fv.FLAT_JSON_FILE_KEYS]
    markers = reduce(add, marks)
    clf = F.col("log_format").isin(PROXY_CLF, PLAIN_CLF)
    parser = F.when((markers >= 2) | clf, "traefik").when(F.col("log_format") == NESTED_JSON, "caddy")
    return looked.select("file_path", parser.alias("parser")).filter(F.col("parser").isNotNull())


def source_progress(landed: DataFrame, stored: DataFrame) -> DataFrame:
    """Landed bytes and lines against stored rows per source, with the share already stored."""
    files = landed.groupBy("source_name", "file_path").agg(F.max("file_size").alias("file_size"), m.hits("lines"))
    sizes = files.groupBy("source_name").agg(F.sum("file_size").alias("file_size"), F.sum("lines").alias("landed_lines"))
    rows = stored.groupBy("source_name").agg(m.hits("stored_rows"), F.max("created_at").alias("last_processed_at"))
    joined = sizes.join(rows, "source_name", "full_outer")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("file_size", "landed_lines", "stored_rows")}
    share = (
        F.when(F.col("landed_lines") > 0, F.col("stored_rows") / F.col("landed_lines") * 100)
        .when(F.col("stored_rows") > 0, 100.0)
        .otherwise(0.0)
    )
    return joined.withColumns(counts).withColumn("percentage", share)
