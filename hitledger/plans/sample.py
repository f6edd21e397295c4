"""Request table and side tables derived from the supplied parquet tables.

Every event becomes one request; the other columns follow from its ids by integer arithmetic, so
any SQL engine can derive the same rows. Clients, services, places and agents repeat in short
cycles, as in real logs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitledger.functions.useragent import parse_user_agent
from hitledger.operators.cleaning import with_identity
from hitledger.session import shared_dir

AS_OF = "2024-01-31 00:00:00"

USER_AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36 Edg/120.0.2210.91",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.1 Safari/605.1.15",
    "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.0 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Mobile Safari/537.36",
    "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)",
    "curl/8.4.0",
]

_COLUMNS = """
event_id AS id
cast(ts AS timestamp) AS timestamp
concat('10.', user_id div 65536 % 256, '.', user_id div 256 % 256, '.', user_id % 256) AS client_ip
CASE event_type WHEN 'purchase' THEN 'POST' WHEN 'signup' THEN 'PUT' ELSE 'GET' END AS method
CASE event_type WHEN 'error' THEN element_at(array(404, 500, 503, 403), cast(event_id % 4 + 1 AS int)) WHEN 'click' THEN 302 WHEN 'purchase' THEN 201 ELSE 200 END AS status_code
event_id * 37 % 5000 AS response_size
CASE WHEN event_id % 10 = 0 THEN 0D ELSE value END AS response_time_ms
CASE WHEN event_id % 10 = 0 THEN 0L ELSE cast(round(value * 1000000) AS bigint) END AS duration
date_format(cast(ts AS timestamp), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") AS start_utc
cast(event_id % 1000 AS int) AS requests_total
concat('/', event_type, '/', event_id % 40) AS path
concat('page=', event_id % 7) AS query_string
concat('site', user_id % 5, '.example.com') AS host
CASE WHEN event_id % 5 < 3 THEN concat(event_id % 7, '-app-', user_id % 3, '-service@docker') ELSE '' END AS backend_name
CASE WHEN event_id % 5 = 3 THEN concat('http://10.1.0.', user_id % 4, ':8080') ELSE '' END AS backend_url
concat('City', user_id % 20) AS geo_city
cast(user_id % 180 - 90 AS double) AS geo_lat
cast(user_id % 360 - 180 AS double) AS geo_lon
cast(CASE WHEN user_id % 6 = 0 THEN 0 ELSE 64500 + user_id % 6 END AS int) AS asn
CASE WHEN user_id % 6 = 0 THEN 'ORG0' ELSE concat('ORG', 64500 + user_id % 6) END AS asn_org
element_at(array('', 'HTTP/1.1', 'HTTP/2.0'), cast(event_id % 3 + 1 AS int)) AS protocol
element_at(array('', '1.2', '1.3'), cast(event_id % 3 + 1 AS int)) AS tls_version
CASE WHEN event_id % 3 = 0 THEN 'http' ELSE 'https' END AS request_scheme
concat('traefik-', event_id % 2) AS source_name
user_id % 25 AS nation_id
event_id % 50 AS page_id
user_id AS user_id
"""


#: Where a session wrote the log lines of a data folder.
_LINES: dict[tuple[str, str], str] = {}


class Sample:
    """Tables of one data folder, each built on first use and never collected."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def plain(self) -> DataFrame:
        """Requests without the two looked-up columns (country, referer)."""
        return self._requests(self.table("events"))

    @cached_property
    def spread(self) -> DataFrame:
        """The rows of ``plain``, dealt to all tasks as narrow events: a small file of them makes many wide requests."""
        return self._requests(self.table("events").select("event_id", "ts", "user_id", "event_type", "value").repartition("event_id"))

    @staticmethod
    def _requests(events: DataFrame) -> DataFrame:
        agents = F.array(*(F.lit(a) for a in USER_AGENTS))
        picked = F.element_at(agents, (F.col("id") % len(USER_AGENTS) + 1).cast("int"))
        rows = events.selectExpr(*_COLUMNS.strip().split("\n"))
        return parse_user_agent(rows.withColumn("user_agent", picked))

    @cached_property
    def placed(self) -> DataFrame:
        """Requests with ``geo_country``; every eleventh client has none."""
        codes = self.countries.select("nation_id", F.col("code").alias("geo_country"))
        joined = self.plain.join(codes, "nation_id", "left")
        known = F.when(F.col("user_id") % 11 != 0, F.col("geo_country"))
        return joined.withColumn("geo_country", F.coalesce(known, F.lit("")))

    @cached_property
    def referred(self) -> DataFrame:
        """Requests with ``referer``: every third request carries the URL of a page."""
        pages = self.table("pages").select("page_id", F.col("url").alias("referer"))
        joined = self.plain.join(pages, "page_id", "left")
        sent = F.when(F.col("id") % 3 == 0, F.col("referer"))
        return joined.withColumn("referer", F.coalesce(sent, F.lit("")))

    @cached_property
    def countries(self) -> DataFrame:
        """Country dimension (code, name, continent) from nations and regions."""
        nations, regions = self.table("nation"), self.table("region")
        letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.col("n_nationkey") + 1, F.lit(1))
        joined = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        return joined.select(
            F.col("n_nationkey").cast("bigint").alias("nation_id"),
            F.concat(F.lit("N"), letter).alias("code"),
            F.col("n_name").alias("name"),
            F.col("r_name").alias("continent"),
        )

    @cached_property
    def tags(self) -> DataFrame:
        """User labels: every tenth client."""
        rows = self.plain.filter(F.col("user_id") % 10 == 0).select("client_ip", "user_id").distinct()
        return rows.select(
            F.col("client_ip").alias("ip_address"),
            F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("friendly_name"),
            F.when(F.col("user_id") % 20 == 0, '["vip","office"]').otherwise('["vip"]').alias("tags"),
        )

    @cached_property
    def identified(self) -> DataFrame:
        return with_identity(self.plain)

    def squeezed(self, factor: int) -> DataFrame:
        """Requests of the month replayed ``factor`` times faster from 2024-02-01 on."""
        start, base = "unix_micros(timestamp '2024-01-01 00:00:00Z')", "unix_micros(timestamp '2024-02-01 00:00:00Z')"
        fast = f"timestamp_micros({base} + (unix_micros(timestamp) - {start}) div {factor})"
        return self.placed.withColumn("timestamp", F.expr(fast))

    @cached_property
    def lines(self) -> DataFrame:
        """The requests as raw log lines, in three dialects by turns, written once per session as logs are."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _LINES:
            path = shared_dir(self.spark, "log-lines")
            self._rendered().write.parquet(path)
            _LINES[key] = path
        return self.spark.read.parquet(_LINES[key])

    def _rendered(self) -> DataFrame:
        r = self.referred
        flat = F.to_json(
            F.struct(
                F.col("client_ip").alias("request_X-Real-Ip"),
                F.col("start_utc").alias("time"),
                F.col("start_utc").alias("StartUTC"),
                F.col("method").alias("RequestMethod"),
                F.concat_ws("?", "path", "query_string").alias("RequestPath"),
                F.col("protocol").alias("RequestProtocol"),
                F.col("host").alias("request_Host"),
                F.col("request_scheme").alias("request_X-Forwarded-Proto"),
                F.col("status_code").alias("DownstreamStatus"),
                F.col("response_size").alias("DownstreamContentSize"),
                F.col("duration").alias("Duration"),
                F.col("requests_total").alias("RequestsTotal"),
                F.col("user_agent").alias("request_User-Agent"),
                F.col("referer").alias("request_Referer"),
                F.col("backend_name").alias("ServiceName"),
                F.col("backend_url").alias("backend_URL"),
                F.col("tls_version").alias("TLSVersion"),
            )
        )
        dash = lambda c: F.when(F.col(c) == "", "-").otherwise(F.col(c))
        clf = F.concat(
            F.col("client_ip"), F.lit(" - - ["), F.date_format("timestamp", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "'),
            F.col("method"), F.lit(" "), F.concat_ws("?", "path", "query_string"), F.lit(' HTTP/1.1" '),
            F.col("status_code").cast("string"), F.lit(" "), F.col("response_size").cast("string"),
            F.lit(' "'), dash("referer"), F.lit('" "'), F.col("user_agent"), F.lit('" '),
            F.col("requests_total").cast("string"), F.lit(' "'), dash("backend_name"), F.lit('" "'), dash("backend_url"),
            F.lit('" '), F.floor("response_time_ms").cast("string"), F.lit("ms"),
        )
        nested = F.to_json(
            F.struct(
                F.lit("http.log.access.main").alias("logger"),
                (F.unix_micros("timestamp") / 1e6).alias("ts"),
                F.struct(
                    F.col("client_ip").alias("remote_ip"),
                    "method",
                    F.col("protocol").alias("proto"),
                    "host",
                    F.concat_ws("?", "path", "query_string").alias("uri"),
                    F.struct(
                        F.array("user_agent").alias("User-Agent"),
                        F.array("referer").alias("Referer"),
                    ).alias("headers"),
                    F.struct((F.lit(770) + F.col("id") % 4).alias("version"), F.lit(4865).alias("cipher_suite")).alias("tls"),
                ).alias("request"),
                F.col("status_code").alias("status"),
                F.col("response_size").alias("size"),
                (F.col("duration") / 1e9).alias("duration"),
                F.when(F.col("backend_url") != "", F.struct(F.col("backend_url").alias("address"))).alias("upstream"),
            )
        )
        parts = [r.filter(F.col("id") % 3 == n).select("id", line.alias("value")) for n, line in enumerate((flat, clf, nested))]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    def _block(self, size: int) -> DataFrame:
        """Address blocks of ``size`` consecutive clients that occur in the data."""
        return self.table("events").select(F.expr(f"user_id div {size}").alias("block")).distinct()

    @staticmethod
    def address(user) -> "F.Column":
        parts = [F.pmod(F.floor(user / d), F.lit(256)).cast("string") for d in (65_536, 256, 1)]
        return F.concat_ws(".", F.lit("10"), *parts)

    @cached_property
    def city_ranges(self) -> DataFrame:
        b = F.col("block")
        return self._block(16).filter(b % 4 != 3).select(
            self.address(b * 16).alias("start_ip"), self.address(b * 16 + 15).alias("end_ip"),
            F.concat(F.lit("C"), (b % 26).cast("string")).alias("geo_country"),
            F.concat(F.lit("Town"), b.cast("string")).alias("geo_city"),
            (b % 90).cast("double").alias("geo_lat"), (b % 180).cast("double").alias("geo_lon"),
        )

    @cached_property
    def country_ranges(self) -> DataFrame:
        b = F.col("block")
        return self._block(64).filter(b % 5 != 4).select(
            self.address(b * 64).alias("start_ip"), self.address(b * 64 + 63).alias("end_ip"),
            F.concat(F.lit("K"), (b % 26).cast("string")).alias("geo_country"),
        )

    @cached_property
    def asn_ranges(self) -> DataFrame:
        b = F.col("block")
        return self._block(32).select(
            self.address(b * 32 + 5).alias("start_ip"), self.address(b * 32 + 30).alias("end_ip"),
            (b + 65_000).cast("int").alias("asn"), F.concat(F.lit("AS"), (b + 65_000).cast("string")).alias("asn_org"),
        )
