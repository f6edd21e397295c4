"""Places: cities, continents and spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitledger.functions import measures as m
from hitledger.functions.fixed_values import WORLD_COUNTRIES
from hitledger.functions.predicates import Scope, known
from hitledger.operators.rankings import top_countries


def with_country_names(df: DataFrame, countries: DataFrame, *, code: str = "country") -> DataFrame:
    """Add ``country_name`` and ``continent`` from a dimension (code, name, continent).

    Codes missing in the dimension are named by themselves and belong to 'Other'.
    """
    names = countries.select(F.col("code").alias(code), F.col("name").alias("country_name"), "continent")
    joined = df.join(names, code, "left")
    return joined.withColumns(
        {"country_name": F.coalesce("country_name", code), "continent": F.coalesce("continent", F.lit("Other"))}
    )


def top_cities(df: DataFrame, scope: Scope, limit: int = 0) -> DataFrame:
    """The ``limit`` busiest cities with coordinates, or all; a city's position is that of its first client address."""
    rows = scope.apply(df).filter(known("geo_city") & (F.col("geo_lat") != 0) & (F.col("geo_lon") != 0))
    position = F.min(F.struct("client_ip", "geo_lat", "geo_lon"))
    grouped = rows.groupBy(F.col("geo_city").alias("city"), F.col("geo_country").alias("country")).agg(
        position.alias("_first"), m.hits(), m.bandwidth()
    )
    cities = grouped.select(
        "city", "country", F.col("_first.geo_lat").alias("latitude"), F.col("_first.geo_lon").alias("longitude"),
        "hits", "bandwidth",
    )
    ranked = cities.orderBy(F.desc("hits"), "city", "country")
    return ranked.limit(limit) if limit > 0 else ranked


def continent_distribution(df: DataFrame, scope: Scope, countries: DataFrame) -> DataFrame:
    """Hits per continent; facts shrink to one row per country before the lookup."""
    named = with_country_names(top_countries(df, scope, 0), countries)
    return named.groupBy("continent").agg(F.sum("hits").alias("hits")).orderBy(F.desc("hits"), "continent")


def geo_insights(df: DataFrame, scope: Scope, countries: DataFrame) -> DataFrame:
    """Countries, continents and cities reached, and how wide the traffic spreads."""
    places = scope.apply(df).filter(known("geo_country") | known("geo_city")).select("geo_country", "geo_city").distinct()
    named = with_country_names(places.withColumnRenamed("geo_country", "country"), countries)
    real = F.col("country") != ""
    figures = named.agg(
        F.count_distinct(F.when(real, F.col("country"))).alias("countries"),
        F.count_distinct(F.when(real, F.col("continent"))).alias("continents"),
        F.count_if(known("geo_city")).alias("cities"),
    )
    n = F.col("countries")
    spread = F.when(n > 50, "Global").when(n > 20, "Continental").when(n > 5, "Multi-Regional").otherwise("Regional")
    return figures.withColumns({"world_percent": n / WORLD_COUNTRIES * 100, "spread": spread})
