"""JSON log lines by fixed schemas, with the type rules of the log formats.

``from_json`` reads a number where text is declared. Where it matters, the readers here ask the parsed line,
a variant, for the type at the value's path, to tell ``"key":5`` from ``"key":"5"``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hitledger.functions import fixed_values as fv

# Keys of flat proxy lines, as text and as numbers.
FLAT_TEXT = [
    *fv.FLAT_JSON_TIME_KEYS, *fv.FLAT_JSON_CLIENT_KEYS, "RequestMethod", "RequestPath", "RequestProtocol", "request_Host",
    "request_X-Forwarded-Proto", "downstream_Content-Type", "request_User-Agent", "request_Referer", "ServiceName",
    "backend_URL", "router_Name", "origin_Content-Type", "TLSVersion", "TLSCipher", "request_X-Request-Id", "RouterName",
]
FLAT_NUMBERS = ["DownstreamStatus", "DownstreamContentSize", "Duration", "RetryAttempts", "RequestsTotal"]
FLAT_SCHEMA = ", ".join([f"`{k}` string" for k in FLAT_TEXT] + [f"`{k}` double" for k in FLAT_NUMBERS])

# Layout of nested access-log lines. Numbers are read as text because they may be quoted.
NESTED_SCHEMA = """
ts string, logger string, status string, size string, duration string, bytes_read string, user_id string,
request struct<client_ip: string, remote_ip: string, remote_port: string, uri: string, method: string, proto: string, host: string,
  headers: map<string, array<string>>, tls: struct<version: string, cipher_suite: string, server_name: string>>,
resp_headers map<string, array<string>>,
upstream struct<address: string, status: string, duration: string>
"""


def _at(doc: Column, keys: tuple[str, ...]) -> Column:
    return F.try_variant_get(doc, "$" + "".join(f"['{k}']" for k in keys), "variant")


def quoted(doc: Column, *keys: str) -> Column:
    """Whether the value at the path is written as text."""
    return F.coalesce(F.schema_of_variant(_at(doc, keys)) == "STRING", F.lit(False))


def present(doc: Column, *keys: str) -> Column:
    """Whether the path occurs at all, with null counted as occurring."""
    return _at(doc, keys).isNotNull()


def text(doc: Column, value: Column, *keys: str) -> Column:
    """Text value; '' when absent or of another type."""
    plain = ~F.substring(value, 1, 1).isin(*"-0123456789tf[{")  # no number, boolean, list or object
    return F.when(plain | quoted(doc, *keys), value).otherwise("")


def number(value: Column) -> Column:
    """Value of a double field; text and other types read as 0."""
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def whole(value: Column) -> Column:
    """Number cut towards zero."""
    return F.coalesce(number(value).try_cast("bigint"), F.lit(0))


def lenient_number(value: Column) -> Column:
    """Number, quoted or not."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def lenient_whole(doc: Column, value: Column, *keys: str) -> Column:
    """Whole number, quoted or not; a fraction is cut, but a quoted fraction is no number."""
    cut = F.when(~quoted(doc, *keys), value.try_cast("double").try_cast("bigint"))
    return F.coalesce(value.try_cast("bigint"), cut, F.lit(0))


def first_of_list(headers: Column, name: str) -> Column:
    return F.coalesce(F.get(F.try_element_at(headers, F.lit(name)), F.lit(0)), F.lit(""))
