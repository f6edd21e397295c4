"""Geographic and network enrichment of client addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitledger.functions import measures as m
from hitledger.functions.frames import computed_once
from hitledger.functions.net import ip_key
from hitledger.schema import GEO_COLUMNS

_KINDS = ("city", "country", "asn")
#: Ranges as wide as a prefix of so few hex digits are met by very many addresses: these are dealt to SHARES groups,
#: each with a copy of those ranges. Disjoint tables have at most 15 such ranges for each of 273 prefixes.
_SHORT, SHARES = 2, 32


def _shared_prefix(start: Column, end: Column) -> Column:
    """Longest common leading digits of two equally long hex texts."""
    lengths = F.filter(
        F.sequence(F.lit(0), F.length(start)),
        lambda n: F.substring(start, F.lit(1), n) == F.substring(end, F.lit(1), n),
    )
    return F.substring(start, F.lit(1), F.array_max(lengths))


def prepare_ranges(ranges: DataFrame, kind: str) -> DataFrame:
    """Key a range table (``start_ip``, ``end_ip``, attributes) by the prefix its two ends share.

    Every range gets exactly one key, however wide it is. Ranges under one key all cross one of the
    15 inner borders of that prefix, so a table of disjoint ranges has at most 15 rows per key.
    """
    have = set(ranges.columns)
    keyed = computed_once(ranges, {"_start": ip_key(F.col("start_ip")), "_end": ip_key(F.col("end_ip"))})
    keyed = keyed.filter(F.length("_start") == F.length("_end"))
    keyed = computed_once(keyed, {"_prefix": _shared_prefix(F.col("_start"), F.col("_end"))})
    wanted = GEO_COLUMNS + ("country_name",)
    place = F.struct(*(F.col(c) if c in have else F.lit(None).alias(c) for c in wanted))
    return keyed.select(
        F.lit(kind).alias("_kind"),
        F.length("_start").alias("_family"),
        "_prefix",
        "_start",
        "_end",
        place.cast(
            "struct<geo_country:string,geo_city:string,geo_lat:double,geo_lon:double,asn:int,asn_org:string,country_name:string>"
        ).alias("_place"),
    )


def lookup_ips(ips: DataFrame, *, city: DataFrame | None = None, country: DataFrame | None = None, asn: DataFrame | None = None) -> DataFrame:
    """Place and network of each address in ``client_ip``.

    The city table decides country, city and position; the country table fills in the country where
    the city table has no range; the network table is separate. Addresses without a hit, and texts
    that are no address, get '' and 0. Nested ranges: the narrowest wins.

    An address can only lie in ranges whose key is one of its own prefixes, so it is expanded to those
    of a length that the tables have, and matched by equality; the range test is a residual. Short prefixes,
    which wide ranges have, are matched within shares of the addresses, so no prefix is one task. All tables
    share one join, and addresses without a range come out of it too. Nothing runs before the plan does.
    """
    tables = {"city": city, "country": country, "asn": asn}
    given = [prepare_ranges(t, kind) for kind, t in tables.items() if t is not None]
    addresses = computed_once(ips.select("client_ip").distinct(), {"_key": ip_key(F.col("client_ip"))})
    if not given:
        raise ValueError("no range table given")
    ranges = given[0]
    for table in given[1:]:
        ranges = ranges.unionByName(table)

    lengths = ranges.agg(F.array_append(F.collect_set(F.length("_prefix")), F.lit(-1))).scalar()  # 34 at most; -1 keeps every address
    spread = addresses.select("client_ip", "_key", F.length("_key").alias("_width"), F.explode(lengths).alias("_n"))
    spread = spread.filter((F.col("_n") <= F.col("_width")) | (F.col("_n") < 0))
    spread = spread.withColumn("_own", F.when(F.col("_n") >= 0, F.substring(F.col("_key"), F.lit(1), F.col("_n")))).drop("_n")
    share = F.when(F.length("_own") <= _SHORT, F.pmod(F.xxhash64("client_ip"), F.lit(SHARES)).cast("int")).otherwise(0)
    spread = spread.withColumn("_share", share)
    shares = F.when(F.length("_prefix") <= _SHORT, F.sequence(F.lit(0), F.lit(SHARES - 1))).otherwise(F.array(F.lit(0)))
    ranges = ranges.select("*", F.explode(shares).alias("_of"))
    inside = (F.col("_key") >= F.col("_start")) & (F.col("_key") <= F.col("_end"))
    same = (F.col("_width") == F.col("_family")) & (F.col("_own") == F.col("_prefix")) & (F.col("_share") == F.col("_of"))
    hits = spread.join(ranges, same & inside, "left")

    # Of nested ranges the narrowest ends first; of those ending together it starts last.
    late_start_first = F.translate("_start", "0123456789abcdef", "fedcba9876543210")
    narrowness = F.struct("_end", late_start_first.alias("_s"))
    best = hits.groupBy("client_ip").agg(
        *(F.min_by(F.when(F.col("_kind") == k, F.col("_place")), F.when(F.col("_kind") == k, narrowness)).alias(f"_{k}") for k in _KINDS)
    )
    placed = best
    has_city = F.col("_city").isNotNull()

    def place(field: str, *, fallback: bool = False) -> Column:
        inner = F.when(has_city, F.col(f"_city.{field}"))
        return inner.otherwise(F.col(f"_country.{field}")) if fallback else inner

    columns = {
        "geo_country": place("geo_country", fallback=True),
        "country_name": place("country_name", fallback=True),
        "geo_city": place("geo_city"),
        "asn_org": F.col("_asn.asn_org"),
        "geo_lat": place("geo_lat"),
        "geo_lon": place("geo_lon"),
        "asn": F.col("_asn.asn"),
    }
    texts = ("geo_country", "country_name", "geo_city", "asn_org")
    return placed.select(
        "client_ip", *(F.coalesce(c, F.lit("") if n in texts else F.lit(0)).alias(n) for n, c in columns.items())
    )


def enrich_geo(df: DataFrame, dimension: DataFrame) -> DataFrame:
    """Attach the looked-up place of each request's client.

    ``dimension`` has one row per address (see ``lookup_ips``). No join hint: a small dimension is
    broadcast by its measured size, a large one is shuffled, and a client that holds a large part of
    all requests is split by the adaptive skew join.
    """
    return df.drop(*GEO_COLUMNS).join(dimension.select("client_ip", *GEO_COLUMNS), "client_ip", "left")


def ip_dimension(df: DataFrame, dimension: DataFrame) -> DataFrame:
    """One row per client: place, first and last request, number of requests."""
    seen = df.groupBy("client_ip").agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), m.hits("lookup_count")
    )
    return seen.join(dimension, "client_ip", "left")


def merge_ip_dimension(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fold a batch's addresses into the stored dimension: earliest, latest, summed; newest place wins."""
    attributes = [c for c in stored.columns if c not in ("client_ip", "first_seen", "last_seen", "lookup_count")]
    newest = F.max_by(F.struct(*attributes), "last_seen")
    merged = stored.unionByName(fresh.select(*stored.columns)).groupBy("client_ip").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sum("lookup_count").alias("lookup_count"), newest.alias("_place"),
    )
    return merged.select("client_ip", "first_seen", "last_seen", "lookup_count", "_place.*").select(*stored.columns)
