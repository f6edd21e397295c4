"""Access-log lines to request events.

Every line is decoded once: JSON by the schema of its dialect, Common Log Format by one regular
expression. A format column then picks, per output column, the expression of that dialect, so a
mixed source needs a single scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitledger.functions import fixed_values as fv
from hitledger.functions.frames import computed_once
from hitledger.functions.net import split_host_port
from hitledger.schema import EVENT_SCHEMA, empty_value
from hitledger.sources import json_lines as jl

FLAT_JSON, NESTED_JSON, PROXY_CLF, PLAIN_CLF = "traefik_json", "caddy_json", "traefik_clf", "generic_clf"
TRAEFIK = (FLAT_JSON, PROXY_CLF, PLAIN_CLF)
CADDY = (NESTED_JSON,)
ALL_DIALECTS = (FLAT_JSON, NESTED_JSON, PROXY_CLF, PLAIN_CLF)

_SEP = "\u0001\u0003\u0001"
_CLF_LINE = f"(?s){fv.CLF_PATTERN}(?:{fv.CLF_PROXY_TAIL})?.*$"
_CLF_GROUPS = 13
_RFC3339 = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)$"
_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def _line() -> Column:
    return F.col("value")


def _doc() -> Column:
    """The JSON line as a variant."""
    return F.col("_doc")


def _flat(key: str) -> Column:
    return F.col("_flat").getField(key)


def _flat_text(key: str) -> Column:
    return F.trim(jl.text(_doc(), _flat(key), key))


def _nested(*keys: str) -> Column:
    value = F.col("_nested")
    for key in keys:
        value = value.getField(key)
    return value


def _clf(group: int) -> Column:
    return F.col("_clf")[group]


def _decode(df: DataFrame, dialects: Sequence[str]) -> DataFrame:
    line = _line()
    is_json = F.startswith(line, F.lit("{"))
    nothing = F.lit(None)

    df = df.withColumn("_doc", F.when(is_json, F.try_parse_json(line)))
    nested_format = nothing.cast("string")
    if NESTED_JSON in dialects:
        doc = F.when(is_json & F.contains(line, F.lit(fv.NESTED_JSON_LOGGER)), F.from_json(line, jl.NESTED_SCHEMA))
        df = df.withColumn("_nested", doc)
        logger = F.startswith(jl.text(_doc(), _nested("logger"), "logger"), F.lit(fv.NESTED_JSON_LOGGER))
        has_request = jl.present(_doc(), "request")
        nested_format = F.when(F.col("_nested").isNotNull() & logger & has_request, NESTED_JSON)
    df = df.withColumn("_nested_format", nested_format)

    flat_format = nothing.cast("string")
    if FLAT_JSON in dialects:
        df = df.withColumn("_flat", F.when(is_json & F.col("_nested_format").isNull(), F.from_json(line, jl.FLAT_SCHEMA)))

        def any_key(keys: Sequence[str]) -> Column:
            return reduce(or_, (jl.present(_doc(), k) for k in keys))

        flat_format = F.when(F.col("_flat").isNotNull() & any_key(fv.FLAT_JSON_TIME_KEYS) & any_key(fv.FLAT_JSON_CLIENT_KEYS), FLAT_JSON)
    df = df.withColumn("_json_format", F.coalesce("_nested_format", flat_format))

    groups = _SEP.join(f"${n}" for n in range(1, _CLF_GROUPS + 1))
    parts = F.split(F.regexp_replace(line, _CLF_LINE, groups), _SEP)
    wants_clf = PROXY_CLF in dialects or PLAIN_CLF in dialects
    df = df.withColumn("_clf", F.when(F.col("_json_format").isNull(), parts) if wants_clf else nothing.cast("array<string>"))
    clf_format = F.when(F.size("_clf") == _CLF_GROUPS, F.when(_clf(9) != "", PROXY_CLF).otherwise(PLAIN_CLF))
    return df.withColumn("log_format", F.coalesce("_json_format", clf_format)).drop("_json_format", "_nested_format")


def detect_format(df: DataFrame, *, dialects: Sequence[str] = ALL_DIALECTS) -> DataFrame:
    """Add ``log_format``: dialect of each line in ``value``, or null."""
    return _decode(df, dialects).drop("_flat", "_nested", "_clf", "_doc")


def _undash(part: Column) -> Column:
    return F.when(part == "-", "").otherwise(part)


def _valid_status(code: Column) -> Column:
    return F.when((code >= 100) & (code < 600), code).otherwise(0)


def _redirect_target(query: Column) -> Column:
    """Decoded ``redirect`` parameter; '' when absent or when the query is not well-formed."""
    broken = F.contains(query, F.lit(";")) | query.rlike("%(?![0-9A-Fa-f]{2})")
    pairs = F.filter(
        F.split(query, "&"),
        lambda p: F.try_url_decode(F.substring_index(p, "=", 1)) == "redirect",
    )
    first = F.get(pairs, F.lit(0))
    value = F.when(F.contains(first, F.lit("=")), F.try_url_decode(F.regexp_replace(first, "^[^=]*=", "")))
    possible = F.contains(query, F.lit("redirect")) | F.contains(query, F.lit("%"))
    return F.when(~possible | broken, "").otherwise(F.coalesce(value, F.lit("")))


def _clf_start_text(stamp: Column) -> Column:
    """CLF time as RFC 3339 text in the offset of the log."""
    month = ((F.instr(F.lit(_MONTHS), F.substring(stamp, 4, 3)) + 2) / 3).cast("int").cast("string")
    offset = F.substring(stamp, 22, 5)
    zone = F.when(offset.isin("+0000", "-0000"), "Z").otherwise(
        F.concat(F.substring(offset, 1, 3), F.lit(":"), F.substring(offset, 4, 2))
    )
    return F.concat(
        F.substring(stamp, 8, 4), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.substring(stamp, 1, 2),
        F.lit("T"), F.substring(stamp, 13, 8), zone,
    )


def _utc_text(seconds: Column, nanos: Column) -> Column:
    """RFC 3339 text in UTC; the fraction keeps up to nine digits without trailing zeros."""
    whole_day = seconds - F.pmod(seconds, F.lit(86_400))
    clock = F.pmod(seconds, F.lit(86_400))
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    digits = F.regexp_replace(F.lpad(nanos.cast("string"), 9, "0"), "0+$", "")
    return F.concat(
        F.date_from_unix_date((whole_day / 86_400).cast("int")).cast("string"),
        F.lit("T"), two(clock / 3_600), F.lit(":"), two(F.pmod(clock, F.lit(3_600)) / 60), F.lit(":"),
        two(F.pmod(clock, F.lit(60))), F.when(digits != "", F.concat(F.lit("."), digits)).otherwise(""), F.lit("Z"),
    )


def _named(code: Column, names: dict[int, str]) -> Column:
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    unknown = F.when(code > 0, F.concat(F.lit("UNKNOWN_"), code.cast("string"))).otherwise("")
    return F.coalesce(F.try_element_at(known, code.cast("int")), unknown)


def tls_version_name(code: Column) -> Column:
    return _named(code, fv.TLS_VERSIONS)


def tls_cipher_name(code: Column) -> Column:
    return _named(code, fv.TLS_CIPHERS)


def _flat_json_columns() -> dict[str, Column]:
    text = _flat_text
    nanos = jl.number(_flat("Duration"))
    raw = lambda key: jl.text(_doc(), _flat(key), key)
    stamp = F.when(jl.present(_doc(), "time"), raw("time")).otherwise(raw("StartUTC"))
    host, port = split_host_port(F.col("_client"))
    method, target = text("RequestMethod"), text("RequestPath")
    return {
        "_client": F.coalesce(*(F.nullif(text(k), F.lit("")) for k in fv.FLAT_JSON_CLIENT_KEYS), F.lit("")),
        "_target": F.when(target == "", "/").otherwise(target),
        "timestamp": F.when(stamp.rlike(_RFC3339), stamp.try_cast("timestamp")),
        "client_ip": host,
        "client_port": port,
        "client_hostname": text("ClientHost"),
        "method": F.upper(F.when(method == "", "GET").otherwise(method)),
        "protocol": text("RequestProtocol"),
        "host": text("request_Host"),
        "request_scheme": text("request_X-Forwarded-Proto"),
        "status_code": _valid_status(jl.whole(_flat("DownstreamStatus"))),
        "response_size": jl.whole(_flat("DownstreamContentSize")),
        "response_time_ms": nanos / 1_000_000,
        "response_content_type": text("downstream_Content-Type"),
        "duration": F.coalesce(nanos.try_cast("bigint"), F.lit(0)),
        "start_utc": text("StartUTC"),
        "retry_attempts": jl.whole(_flat("RetryAttempts")),
        "requests_total": jl.whole(_flat("RequestsTotal")),
        "user_agent": text("request_User-Agent"),
        "referer": text("request_Referer"),
        "backend_name": text("ServiceName"),
        "backend_url": text("backend_URL"),
        "router_name": text("router_Name"),
        "upstream_content_type": text("origin_Content-Type"),
        "tls_version": text("TLSVersion"),
        "tls_cipher": text("TLSCipher"),
        "request_id": text("request_X-Request-Id"),
    }


def _clf_columns() -> dict[str, Column]:
    stamp = _clf(2)
    when = F.try_to_timestamp(stamp, F.lit(fv.CLF_TIME_FORMAT))
    host, port = split_host_port(F.col("_client"))
    millis = F.coalesce(_clf(12).try_cast("bigint"), F.lit(0))
    return {
        "_client": _clf(0),
        "_target": _clf(4),
        "timestamp": when,
        "client_ip": host,
        "client_port": port,
        "method": _clf(3),
        "status_code": _valid_status(_clf(5).try_cast("int")),
        "response_size": F.coalesce(_clf(6).try_cast("bigint"), F.lit(0)),
        "response_time_ms": millis.cast("double"),
        "duration": millis * 1_000_000,
        "start_utc": F.when(when.isNotNull(), _clf_start_text(stamp)),
        "requests_total": F.coalesce(_clf(9).try_cast("int"), F.lit(0)),
        "user_agent": _undash(_clf(8)),
        "referer": _undash(_clf(7)),
        "backend_name": _undash(_clf(10)),
        "backend_url": _undash(_clf(11)),
    }


def _nested_json_columns() -> dict[str, Column]:
    text = lambda *keys: jl.text(_doc(), _nested(*keys), *keys)
    whole = lambda *keys: jl.lenient_whole(_doc(), _nested(*keys), *keys)
    header = lambda name: jl.first_of_list(_nested("request", "headers"), name)
    ts = jl.lenient_number(_nested("ts"))
    seconds = ts.try_cast("bigint")
    nanos = ((ts - seconds) * 1e9).try_cast("bigint")
    took = jl.lenient_number(_nested("duration"))
    has_tls = _nested("request", "tls").isNotNull()
    if_tls = lambda c: F.when(has_tls, c).otherwise("")
    client = [text("request", "client_ip"), text("request", "remote_ip"), header("X-Forwarded-For")]
    return {
        "_client": F.coalesce(*(F.nullif(c, F.lit("")) for c in client), F.lit("")),
        "_target": text("request", "uri"),
        "timestamp": F.when(ts != 0, F.timestamp_micros(seconds * 1_000_000 + F.floor(nanos / 1_000))),
        "client_ip": F.col("_client"),
        "client_port": whole("request", "remote_port"),
        "client_user": text("user_id"),
        "method": text("request", "method"),
        "protocol": text("request", "proto"),
        "host": text("request", "host"),
        "request_length": whole("bytes_read"),
        "request_scheme": F.when(has_tls, "https").otherwise("http"),
        "status_code": whole("status"),
        "response_size": whole("size"),
        "response_time_ms": took * 1_000,
        "response_content_type": jl.first_of_list(_nested("resp_headers"), "Content-Type"),
        "duration": F.coalesce((took * 1e9).try_cast("bigint"), F.lit(0)),
        "start_utc": _utc_text(seconds, nanos),
        "upstream_response_time_ms": jl.lenient_number(_nested("upstream", "duration")) * 1_000,
        "user_agent": header("User-Agent"),
        "referer": header("Referer"),
        "backend_url": text("upstream", "address"),
        "router_name": text("logger"),
        "upstream_status": whole("upstream", "status"),
        "tls_version": if_tls(tls_version_name(whole("request", "tls", "version"))),
        "tls_cipher": if_tls(tls_cipher_name(whole("request", "tls", "cipher_suite"))),
        "tls_server_name": if_tls(text("request", "tls", "server_name")),
    }


_BUILDERS = {
    FLAT_JSON: _flat_json_columns,
    PROXY_CLF: _clf_columns,
    PLAIN_CLF: _clf_columns,
    NESTED_JSON: _nested_json_columns,
}


def _columns_by_format(dialects: Sequence[str]) -> list[tuple[list[str], dict[str, Column]]]:
    """Columns of each dialect in use, with the formats they serve."""
    formats: dict[Callable, list[str]] = {}
    for dialect in dialects:
        formats.setdefault(_BUILDERS[dialect], []).append(dialect)
    return [(names, build()) for build, names in formats.items()]


def _by_format(parts: list[tuple[list[str], dict[str, Column]]], name: str) -> Column | None:
    picked: Column | None = None
    for formats, columns in parts:
        if name in columns:
            test = F.col("log_format").isin(formats)
            picked = F.when(test, columns[name]) if picked is None else picked.when(test, columns[name])
    return picked


def parse_lines(df: DataFrame, *, dialects: Sequence[str] = ALL_DIALECTS) -> DataFrame:
    """Parse ``value`` into event columns and keep every line.

    ``reject_reason`` is '' for usable lines. Other input columns stay; ``ingest_time``, when
    present, replaces unreadable timestamps, else the query's start time does, and
    ``timestamp_defaulted`` tells so.
    """
    carried = [c for c in df.columns if c not in ("value", *EVENT_SCHEMA.names)]
    now = F.col("ingest_time") if "ingest_time" in df.columns else F.current_timestamp()
    df = _decode(df.filter(F.col("value") != "").select(*carried, "value"), dialects)
    parts = _columns_by_format(dialects)
    df = df.withColumns({n: _by_format(parts, n) for n in ("_client", "_target")})

    columns = {}
    for f in EVENT_SCHEMA.fields:
        picked = _by_format(parts, f.name)
        if picked is not None and f.name != "timestamp":
            picked = F.coalesce(picked.try_cast(f.dataType), empty_value(f.dataType))
        columns[f.name] = empty_value(f.dataType) if picked is None else picked
    target = F.coalesce("_target", F.lit(""))
    cut = F.instr(target, "?")
    columns["path"] = F.substring_index(target, "?", 1)
    columns["query_string"] = F.when(cut > 0, F.substring(target, cut + 1, F.length(target))).otherwise("")

    reason = F.when(F.col("log_format").isNull(), "unknown_format").otherwise("")
    if FLAT_JSON in dialects:
        reason = F.when((F.col("log_format") == FLAT_JSON) & (F.col("_client") == ""), "missing_client_ip").otherwise(reason)
    if NESTED_JSON in dialects:
        nested = F.col("log_format") == NESTED_JSON
        reason = F.when(nested & _nested("request").isNull(), "missing_request").otherwise(reason)
        reason = F.when(nested & (jl.lenient_number(_nested("ts")) == 0), "missing_timestamp").otherwise(reason)

    event = {"reject_reason": reason, **columns}
    out = computed_once(df, event).select(*carried, "value", "log_format", *event)
    known_redirect = F.when(
        (F.col("referer") == "") & (F.col("log_format") != NESTED_JSON), _redirect_target(F.col("query_string"))
    ).otherwise(F.col("referer"))
    return out.withColumns(
        {
            "timestamp_defaulted": F.col("timestamp").isNull(),
            "timestamp": F.coalesce("timestamp", now),
            "referer": F.coalesce(known_redirect, F.lit("")),
        }
    )


def rejected(parsed: DataFrame) -> DataFrame:
    """Lines no parser could use, with the reason."""
    return parsed.filter(F.col("reject_reason") != "").select(
        *[c for c in ("source_name", "file_path") if c in parsed.columns], "log_format", "reject_reason", "value"
    )


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject_reason") == "").drop("value", "reject_reason")


def _parser(*dialects: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: accepted(parse_lines(df, dialects=dialects))


parse_traefik_json = _parser(FLAT_JSON)
parse_traefik_clf = _parser(PROXY_CLF)
parse_generic_clf = _parser(PLAIN_CLF)
parse_caddy_json = _parser(NESTED_JSON)

PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "traefik": _parser(*TRAEFIK),
    "caddy": _parser(*CADDY),
    "auto": _parser(*ALL_DIALECTS),
}


def register_parser(name: str, transform: Callable[[DataFrame], DataFrame]) -> None:
    """Add a log dialect: a function from raw lines to event columns."""
    PARSERS[name] = transform


def parse_logs(df: DataFrame, parser: str = "auto") -> DataFrame:
    """Usable events of ``df``, by the named parser."""
    return PARSERS[parser](df)
