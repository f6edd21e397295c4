"""The ingest path: raw lines to stored requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitledger.functions.useragent import parse_user_agent
from hitledger.operators.cleaning import validity_reason, with_identity
from hitledger.operators.enrichment import enrich_geo
from hitledger.schema import REQUEST_SCHEMA, conform
from hitledger.sources.parsers import parse_lines, parse_logs, rejected


def judged_requests(lines: DataFrame, *, parser: str = "auto") -> DataFrame:
    """Narrow part of the path, valid on streams: parse, classify the agent, identify; ``broken_rule`` is '' for good rows."""
    events = parse_user_agent(parse_logs(lines, parser))
    return with_identity(events).withColumn("broken_rule", validity_reason())


def parse_requests(lines: DataFrame, *, parser: str = "auto") -> DataFrame:
    return judged_requests(lines, parser=parser).filter("broken_rule = ''").drop("broken_rule")


def refused(lines: DataFrame, judged: DataFrame) -> DataFrame:
    """What ingest does not store: lines that no parser takes, and rows that break a rule, each with the reason."""

    def named(df: DataFrame) -> DataFrame:
        return df if "source_name" in df.columns else df.withColumn("source_name", F.lit(""))

    unread = rejected(parse_lines(named(lines)))
    unread = unread.select("source_name", F.col("reject_reason").alias("reason"), "value", F.lit("").alias("request_hash"))
    broken = named(judged).filter("broken_rule <> ''").select("source_name", F.col("broken_rule").alias("reason"), F.lit("").alias("value"), "request_hash")
    return unread.unionByName(broken)


def finish_requests(parsed: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Attach places (one row per address) and project to the stored schema."""
    placed = enrich_geo(parsed, places) if places is not None else parsed
    return conform(placed.withColumn("created_at", F.current_timestamp()), REQUEST_SCHEMA)


def ingest(lines: DataFrame, *, parser: str = "auto", places: DataFrame | None = None) -> DataFrame:
    return finish_requests(parse_requests(lines, parser=parser), places)
