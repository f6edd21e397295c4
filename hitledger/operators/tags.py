"""User labels per client address, kept as a small table (ip_address, friendly_name, tags)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_tags(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """Insert new addresses and replace known ones."""
    kept = stored.join(updates.select("ip_address"), "ip_address", "left_anti")
    return kept.unionByName(updates.select(*stored.columns))


def delete_tags(stored: DataFrame, ips: DataFrame | Sequence[str]) -> DataFrame:
    if isinstance(ips, DataFrame):
        return stored.join(ips.select("ip_address"), "ip_address", "left_anti")
    return stored.filter(~F.col("ip_address").isin(list(ips)))


def find_tags(stored: DataFrame, ips: Sequence[str] | None = None) -> DataFrame:
    """Labels of the given addresses, or of all, with the tag list parsed."""
    rows = stored if ips is None else stored.filter(F.col("ip_address").isin(list(ips)))
    return rows.withColumn("tag_list", F.from_json("tags", "array<string>"))
