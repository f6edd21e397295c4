"""Grouped counts and top-k lists.

All follow one plan: filter, partial and final hash aggregation on the group key, then a top-k that
keeps ``limit`` rows per task. Distinct visitor counts aggregate on (key, client) first, so one
very busy key is spread over many tasks. Ties are ordered by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitledger.functions import measures as m
from hitledger.functions.predicates import DrillDown, Scope, contains_ci, known


def _top(df: DataFrame, order: str | Column, keys: list[str], limit: int) -> DataFrame:
    first = F.desc(order) if isinstance(order, str) else order
    df = df.orderBy(first, *keys)
    return df.limit(limit) if limit > 0 else df


def top_paths(df: DataFrame, scope: Scope, limit: int = 10) -> DataFrame:
    grouped = scope.apply(df).groupBy("path").agg(m.hits(), m.visitors(), m.avg_time(), m.bandwidth("total_bandwidth"))
    return _top(grouped, "hits", ["path"], limit)


def path_times(df: DataFrame, scope: Scope, *, slowest: bool = True, limit: int = 10) -> DataFrame:
    """Paths by mean response time, slowest or fastest first."""
    grouped = scope.apply(df).groupBy("path").agg(m.hits(), m.avg_time(), m.bandwidth("total_bandwidth"))
    order = F.desc("avg_response_time") if slowest else F.asc("avg_response_time")
    return _top(grouped, order, ["path"], limit)


def top_countries(df: DataFrame, scope: Scope, limit: int = 10) -> DataFrame:
    """``limit=0`` returns every country."""
    rows = scope.apply(df).filter(known("geo_country"))
    grouped = rows.groupBy(F.col("geo_country").alias("country")).agg(m.hits(), m.visitors(), m.bandwidth())
    return _top(grouped, "hits", ["country"], limit)


def client_measures() -> list[Column]:
    places = {"country": "geo_country", "city": "geo_city", "latitude": "geo_lat", "longitude": "geo_lon"}
    return [*(F.max(source).alias(name) for name, source in places.items()), m.hits(), m.bandwidth()]


def with_tags(ranked: DataFrame, tags: DataFrame, *, on: str = "ip_address") -> DataFrame:
    """Add the user's label and tags; '' for clients without."""
    labels = tags.select(F.col("ip_address").alias(on), "friendly_name", "tags")
    joined = ranked.join(labels, on, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit("")) for c in ("friendly_name", "tags")})


def top_ips(
    df: DataFrame,
    scope: Scope,
    limit: int = 10,
    *,
    tags: DataFrame,
    tag: str = "",
    drill: DrillDown | None = None,
    sort: str = "hits",
) -> DataFrame:
    """Busiest clients by hits or bandwidth, with place and user labels.

    ``tag`` keeps clients whose tags contain the text. Labels join the ``limit`` result rows only.
    """
    rows = scope.apply(df)
    if drill:
        rows = drill.apply(rows)
    if tag:
        wanted = tags.filter(contains_ci(F.col("tags"), tag)).select(F.col("ip_address").alias("client_ip"))
        rows = rows.join(wanted, "client_ip", "left_semi")
    order = "bandwidth" if sort == "bandwidth" else "hits"
    grouped = rows.groupBy(F.col("client_ip").alias("ip_address")).agg(*client_measures())
    best = _top(grouped, order, ["ip_address"], limit)
    return _top(with_tags(best, tags), order, ["ip_address"], 0)


def search_ips(df: DataFrame, text: str, *, as_of, hours: float = 168, limit: int = 20) -> DataFrame:
    """Clients of the window, by default a week, whose address contains ``text``."""
    rows = Scope(as_of, hours).apply(df).filter(contains_ci(F.col("client_ip"), text))
    grouped = rows.groupBy(F.col("client_ip").alias("ip_address")).agg(
        m.hits(),
        F.max("geo_country").alias("country"),
        F.max("geo_city").alias("city"),
        F.max("timestamp").alias("last_seen"),
    )
    return _top(grouped, "hits", ["ip_address"], limit)


def hot_ips(df: DataFrame, *, as_of, limit: int, hours: float = 168, more_than: int = 5) -> DataFrame:
    """Clients worth keeping in a lookup cache: more than ``more_than`` requests in the window, by default a week."""
    counts = Scope(as_of, hours).apply(df).groupBy("client_ip").agg(m.hits("repetition"))
    return _top(counts.filter(F.col("repetition") > more_than), "repetition", ["client_ip"], limit)


# Column of each plain distribution and the markers that do not count as a value; None keeps ''.
DISTRIBUTIONS: dict[str, tuple[str, ...] | None] = {
    "status_code": None,
    "method": None,
    "protocol": (),
    "tls_version": (),
    "device_type": (),
    "user_agent": None,
    "browser": ("Unknown",),
    "os": ("Unknown",),
}


def distribution(df: DataFrame, scope: Scope, column: str, limit: int = 0) -> DataFrame:
    """Requests per value of ``column``, most frequent first."""
    rows = scope.apply(df)
    unknown = DISTRIBUTIONS[column]
    if unknown is not None:
        rows = rows.filter(known(column, *unknown))
    elif column == "user_agent":
        rows = rows.filter(known(column))
    return _top(rows.groupBy(column).agg(m.hits("count")), "count", [column], limit)


def top_asns(df: DataFrame, scope: Scope, limit: int = 10) -> DataFrame:
    rows = scope.apply(df).filter(F.col("asn") > 0)
    grouped = rows.groupBy("asn").agg(
        F.max("asn_org").alias("asn_org"), m.hits(), m.bandwidth(), F.max("geo_country").alias("country")
    )
    return _top(grouped, "hits", ["asn"], limit)


def top_referrers(df: DataFrame, scope: Scope, limit: int = 10) -> DataFrame:
    rows = scope.apply(df).filter(known("referer"))
    return _top(rows.groupBy(F.col("referer").alias("referrer")).agg(m.hits(), m.visitors()), "hits", ["referrer"], limit)


def top_referrer_domains(df: DataFrame, scope: Scope, limit: int = 10) -> DataFrame:
    """Referrers by host; local files do not count."""
    rows = scope.apply(df).filter(known("referer") & ~F.startswith(F.lower("referer"), F.lit("file:")))
    rows = rows.select(m.referrer_domain(F.col("referer")).alias("domain"), "client_ip").filter(F.col("domain").isNotNull())
    return _top(rows.groupBy("domain").agg(m.hits(), m.visitors()), "hits", ["domain"], limit)


def with_share(ranked: DataFrame, column: str, name: str = "share") -> DataFrame:
    """Percentage of the column total; the total is a scalar subquery, not a global window.

    The subquery looks at all columns, so that it is planned like ``ranked`` and both share one aggregation of
    the facts. Columns that nothing needs should be dropped before, not after.
    """
    others = [F.max(c).alias(c) for c in ranked.columns if c != column]
    total = ranked.agg(F.struct(F.coalesce(F.sum(column), F.lit(0)).alias("_total"), *others).alias("_whole"))
    return ranked.withColumn(name, m.percent(F.col(column), total.scalar().getField("_total")))


def country_engagement(df: DataFrame, scope: Scope, limit: int = 0) -> DataFrame:
    """Hits per visitor and share of all visitors, per country."""
    figures = top_countries(df, scope, limit).select("country", "unique_visitors", "hits")
    per_visitor = F.when(F.col("unique_visitors") > 0, F.col("hits") / F.col("unique_visitors")).otherwise(0.0)
    return with_share(figures, "unique_visitors", "visitor_share").select(
        "country", "unique_visitors", "hits", per_visitor.alias("avg_hits"), "visitor_share"
    )


def referral_share(df: DataFrame, scope: Scope) -> DataFrame:
    """Share of requests that carry a referrer."""
    figures = scope.apply(df).agg(F.count_if(known("referer")).alias("referrals"), m.hits("total_requests"))
    return figures.withColumn("referral_share", m.percent(F.col("referrals"), F.col("total_requests")))


def _device_counts(df: DataFrame) -> DataFrame:
    device = F.lower("device_type")
    kinds = {k: F.count_if(device == k).alias(k) for k in ("desktop", "mobile", "tablet", "bot")}
    return df.filter(known("device_type")).agg(*kinds.values(), m.hits("total"))


def bot_share(df: DataFrame, scope: Scope) -> DataFrame:
    """People, bots and unknown devices: requests and percentages."""
    counts = _device_counts(scope.apply(df))
    human = F.col("desktop") + F.col("mobile") + F.col("tablet")
    parts = {"human": human, "bot": F.col("bot"), "unknown": F.col("total") - human - F.col("bot")}
    return counts.select(
        *(c.alias(f"{n}_requests") for n, c in parts.items()),
        *(m.percent(c, F.col("total")).alias(f"{n}_percent") for n, c in parts.items()),
    )


def platform_share(df: DataFrame, scope: Scope) -> DataFrame:
    """Desktop, mobile and tablet in percent of those three."""
    counts = _device_counts(scope.apply(df))
    kinds = ("desktop", "mobile", "tablet")
    total = F.col("desktop") + F.col("mobile") + F.col("tablet")
    return counts.select(*(m.percent(F.col(k), total).alias(f"{k}_percent") for k in kinds))
