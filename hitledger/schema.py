"""The wide request table: one row per HTTP request.

Text columns hold '' and number columns 0 when a value is unknown; nulls are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "s": T.StringType(),
    "i": T.IntegerType(),
    "l": T.LongType(),
    "d": T.DoubleType(),
    "t": T.TimestampType(),
    "b": T.BooleanType(),
}

# Column names and types of the stored request table.
_EVENT_COLUMNS = """
timestamp t
client_ip s
client_port i
client_user s
client_hostname s
method s
protocol s
host s
path s
query_string s
request_length l
request_scheme s
status_code i
response_size l
response_time_ms d
response_content_type s
duration l
start_utc s
upstream_response_time_ms d
retry_attempts i
requests_total i
user_agent s
referer s
backend_name s
backend_url s
router_name s
upstream_status i
upstream_content_type s
tls_version s
tls_cipher s
tls_server_name s
request_id s
trace_id s
proxy_metadata s
"""
_DERIVED_COLUMNS = """
source_name s
request_hash s
partition_key s
browser s
browser_version s
os s
os_version s
device_type s
geo_country s
geo_city s
geo_lat d
geo_lon d
asn i
asn_org s
created_at t
timestamp_defaulted b
"""


def _fields(text: str) -> list[T.StructField]:
    return [T.StructField(name, _TYPES[code]) for name, code in (line.split() for line in text.split("\n") if line)]


EVENT_SCHEMA = T.StructType(_fields(_EVENT_COLUMNS))
REQUEST_SCHEMA = T.StructType(_fields(_EVENT_COLUMNS) + _fields(_DERIVED_COLUMNS))

GEO_COLUMNS = ("geo_country", "geo_city", "geo_lat", "geo_lon", "asn", "asn_org")
USER_AGENT_COLUMNS = ("browser", "browser_version", "os", "os_version", "device_type")


def empty_value(dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return F.lit("")
    if isinstance(dtype, T.TimestampType):
        return F.lit(None).cast(dtype)
    return F.lit(0).cast(dtype)


def conform(df: DataFrame, schema: T.StructType = REQUEST_SCHEMA) -> DataFrame:
    """Project ``df`` to ``schema`` by column name; absent columns and nulls become '' or 0."""
    have = set(df.columns)
    return df.select(
        *(
            F.coalesce(F.col(f.name).cast(f.dataType), empty_value(f.dataType)).alias(f.name)
            if f.name in have
            else empty_value(f.dataType).alias(f.name)
            for f in schema.fields
        )
    )
