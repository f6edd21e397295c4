"""Address range tables for geographic lookup, in the common CSV block layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitledger.functions.net import ip_key


def _filled(key: Column, bits: Column, digit: str) -> Column:
    """``key`` with everything behind the first ``bits`` bits set to 0 or f."""
    width = F.length(key)
    whole = F.floor(bits / 4).cast("int")
    free = F.lit(4) - F.pmod(bits, F.lit(4)).cast("int")
    nibble = F.conv(F.substring(key, whole + 1, F.lit(1)), 16, 10).cast("int")
    block = F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4), F.lit(8), F.lit(16)), free + 1)
    low = nibble - F.pmod(nibble, block)
    edge = low if digit == "0" else low + block - 1
    partial = F.when(bits < width * 4, F.lower(F.conv(edge.cast("string"), 10, 16))).otherwise("")
    rest = F.repeat(F.lit(digit), F.greatest(width - whole - 1, F.lit(0)))
    return F.concat(F.substring(key, F.lit(1), whole), partial, rest)


def _as_address(key: Column) -> Column:
    """Hex form back to address text."""
    octets = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda n: F.conv(F.substring(key, n * 2 + 1, F.lit(2)), 16, 10))
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda n: F.substring(key, n * 4 + 1, F.lit(4)))
    return F.when(F.length(key) == 8, F.array_join(octets, ".")).otherwise(F.array_join(groups, ":"))


def cidr_bounds(df: DataFrame, network: str = "network") -> DataFrame:
    """Add ``start_ip`` and ``end_ip`` of a CIDR block column."""
    key = ip_key(F.substring_index(F.col(network), "/", 1))
    bits = F.substring_index(F.col(network), "/", -1).cast("int")
    return df.withColumns(
        {"start_ip": _as_address(_filled(key, bits, "0")), "end_ip": _as_address(_filled(key, bits, "f"))}
    )


def read_city_ranges(spark: SparkSession, blocks: str, locations: str) -> DataFrame:
    """City blocks joined with their location names (CSV with header)."""
    where = spark.read.option("header", True).csv(locations).select(
        "geoname_id", F.col("country_iso_code").alias("geo_country"), "country_name", F.col("city_name").alias("geo_city")
    )
    nets = spark.read.option("header", True).csv(blocks)
    joined = cidr_bounds(nets).join(where, "geoname_id", "left")
    return joined.select(
        "start_ip", "end_ip", "geo_country", "country_name", "geo_city",
        F.col("latitude").try_cast("double").alias("geo_lat"), F.col("longitude").try_cast("double").alias("geo_lon"),
    )


def read_country_ranges(spark: SparkSession, blocks: str, locations: str) -> DataFrame:
    where = spark.read.option("header", True).csv(locations).select(
        "geoname_id", F.col("country_iso_code").alias("geo_country"), "country_name"
    )
    joined = cidr_bounds(spark.read.option("header", True).csv(blocks)).join(where, "geoname_id", "left")
    return joined.select("start_ip", "end_ip", "geo_country", "country_name")


def read_asn_ranges(spark: SparkSession, blocks: str) -> DataFrame:
    nets = cidr_bounds(spark.read.option("header", True).csv(blocks))
    return nets.select(
        "start_ip", "end_ip",
        F.col("autonomous_system_number").try_cast("int").alias("asn"),
        F.col("autonomous_system_organization").alias("asn_org"),
    )


def read_country_names(spark: SparkSession, path: str) -> DataFrame:
    """Country dimension (code, name, continent) from a CSV with header."""
    return spark.read.option("header", True).csv(path).select("code", "name", "continent")
