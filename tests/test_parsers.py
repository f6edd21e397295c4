"""Log lines of a made-up bookshop in the public formats: JSON access logs of two proxies and the Common Log Format."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hitledger.sources import parsers as P


def flat(**fields):
    line = {
        "StartUTC": "2023-04-02T03:04:05.000600Z", "request_X-Real-Ip": "203.0.113.77", "RequestMethod": "delete", "RequestPath": "/books/42?shelf=7",
        "RequestProtocol": "HTTP/3.0", "request_Host": "shop.test", "request_X-Forwarded-Proto": "wss", "DownstreamStatus": 204, "DownstreamContentSize": 5,
        "Duration": 1500, "RequestsTotal": 9, "RetryAttempts": 2, "ServiceName": "books@swarm", "router_Name": "front", "TLSVersion": "1.2",
        "TLSCipher": "TLS_X", "request_User-Agent": "reader/3", "downstream_Content-Type": "text/plain", "request_X-Request-Id": "id-1",
    }
    return json.dumps({k: v for k, v in (line | fields).items() if v is not ...})


def nested(drop=(), **fields):
    request = {"remote_ip": "198.51.100.3", "remote_port": "61000", "client_ip": "198.51.100.4", "proto": "HTTP/1.0", "method": "PATCH", "host": "shop.test",
               "uri": "/cart?item=9", "headers": {"User-Agent": ["reader/4", "second"], "Referer": ["http://list.test/"]},
               "tls": {"version": 771, "cipher_suite": 4866, "server_name": "shop.test"}}
    line = {"ts": 1680000000.25, "logger": "http.log.access.shop", "request": request, "bytes_read": 12, "user_id": "ann", "duration": 0.5, "size": 77, "status": 418,
            "resp_headers": {"Content-Type": ["application/json"]}}
    request.update(fields.pop("request", {}))
    return json.dumps({k: v for k, v in (line | fields).items() if k not in drop})


def clf(size="88", referer="http://list.test/", agent="reader/5", tail=' 3 "cart" "http://10.9.8.7:81" 21ms', zone="+0000"):
    return f'198.51.100.20 - bob [29/Feb/2024:23:59:58 {zone}] "PUT /cart/1?x=y HTTP/1.0" 409 {size} "{referer}" "{agent}"{tail}'


LINES = {
    "flat": flat(), "flat_redirect": flat(RequestPath="/login?a=1&redirect=http%3A%2F%2Fnext.test%2Fp+q&redirect=no"),
    "flat_broken_redirect": flat(RequestPath="/login?redirect=n&c=%q1"), "flat_quoted_status": flat(DownstreamStatus="204"), "flat_numbers": flat(RequestMethod=3, TLSVersion=1.2),
    "flat_null_time": flat(StartUTC=..., time=None, **{"request_X-Real-Ip": ..., "ClientHost": "[2001:db8::7]:5"}), "flat_no_client": flat(**{"request_X-Real-Ip": ""}),
    "flat_odd_status": flat(DownstreamStatus=42), "flat_no_path": flat(RequestPath=""), "flat_nested_key": flat(extra={"DownstreamStatus": "x", "RequestMethod": 1}),
    "clf": clf(), "plain": clf(tail=""), "dashes": clf(size="-", referer="-", agent="-", tail=' 3 "-" "-" 21ms'), "offset": clf(tail="", zone="-0330"),
    "nested": nested(), "nested_no_ts": nested(drop=["ts"]), "nested_no_request": nested(drop=["request"]), "nested_request_number": nested() .replace('"request": {', '"request": 7, "r": {'),
    "nested_upstream": nested(status=200.0, duration=0.125, upstream={"address": "10.1.1.1:90", "status": "502", "duration": "0.0625"}),
    "nested_quoted": nested(status="201", size="9.5", upstream={"status": 503.0}), "nested_plain_http": nested(request={"tls": None}),
    "nested_remote": nested(request={"client_ip": ""}), "nested_forwarded": nested(request={"client_ip": "", "remote_ip": "", "headers": {"X-Forwarded-For": ["192.0.2.200"]}}),
    "nested_odd_tls": nested(request={"tls": {"version": 1, "cipher_suite": 2}}), "nested_spaced": nested().replace('": ', '" :  '),
    "prose": "the quick brown fox", "other_json": '{"level":"info","msg":"started"}', "cut_json": flat()[:60], "empty": "",
}


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame(list(LINES.items()), "name string, value string")
    return {r["name"]: r for r in P.parse_lines(df).collect()}


def check(row, **wanted):
    assert {k: row[k] for k in wanted} == wanted


def test_flat_json(parsed):
    check(
        parsed["flat"], log_format="traefik_json", reject_reason="", client_ip="203.0.113.77", method="DELETE", path="/books/42", query_string="shelf=7", protocol="HTTP/3.0",
        host="shop.test", request_scheme="wss", status_code=204, response_size=5, response_time_ms=0.0015, duration=1500, requests_total=9, retry_attempts=2,
        backend_name="books@swarm", router_name="front", tls_version="1.2", tls_cipher="TLS_X", user_agent="reader/3", response_content_type="text/plain",
        request_id="id-1", referer="", timestamp_defaulted=False,
    )


def test_flat_json_types(parsed):
    check(parsed["flat_quoted_status"], status_code=0)
    check(parsed["flat_numbers"], method="GET", tls_version="")
    check(parsed["flat_odd_status"], status_code=0)
    check(parsed["flat_no_path"], path="/", query_string="")
    check(parsed["flat_nested_key"], status_code=204, method="DELETE")
    check(parsed["flat_null_time"], reject_reason="", timestamp_defaulted=True, client_ip="2001:db8::7", client_port=5)


def test_redirects(parsed):
    assert parsed["flat_redirect"]["referer"] == "http://next.test/p q"
    assert parsed["flat_broken_redirect"]["referer"] == ""


def test_clf(parsed):
    check(
        parsed["clf"], log_format="traefik_clf", client_ip="198.51.100.20", method="PUT", path="/cart/1", query_string="x=y", status_code=409, response_size=88,
        referer="http://list.test/", user_agent="reader/5", requests_total=3, backend_name="cart", backend_url="http://10.9.8.7:81", response_time_ms=21.0,
        duration=21_000_000, start_utc="2024-02-29T23:59:58Z",
    )
    check(parsed["plain"], log_format="generic_clf", backend_name="", response_time_ms=0.0, requests_total=0, user_agent="reader/5")
    check(parsed["dashes"], response_size=0, referer="", user_agent="", backend_name="", backend_url="", response_time_ms=21.0)
    assert parsed["offset"]["start_utc"] == "2024-02-29T23:59:58-03:30"
    assert parsed["offset"]["timestamp"] - parsed["plain"]["timestamp"] == timedelta(hours=3, minutes=30)


def test_nested_json(parsed):
    check(
        parsed["nested"], log_format="caddy_json", reject_reason="", client_ip="198.51.100.4", client_port=61000, client_user="ann", method="PATCH", protocol="HTTP/1.0",
        host="shop.test", path="/cart", query_string="item=9", request_length=12, request_scheme="https", status_code=418, response_size=77, response_time_ms=500.0,
        duration=500_000_000, start_utc="2023-03-28T10:40:00.25Z", response_content_type="application/json", user_agent="reader/4", referer="http://list.test/",
        router_name="http.log.access.shop", tls_version="1.2", tls_cipher="TLS_AES_256_GCM_SHA384", tls_server_name="shop.test",
    )
    assert {k: v for k, v in parsed["nested_spaced"].asDict().items() if k not in ("name", "value")} == {k: v for k, v in parsed["nested"].asDict().items() if k not in ("name", "value")}


def test_nested_keys_of_one_name_keep_their_own_types(parsed):
    check(parsed["nested_upstream"], status_code=200, upstream_status=502, duration=125_000_000, upstream_response_time_ms=62.5, backend_url="10.1.1.1:90")
    check(parsed["nested_quoted"], status_code=201, response_size=0, upstream_status=503)


def test_nested_clients_and_tls(parsed):
    assert [parsed[n]["client_ip"] for n in ("nested_remote", "nested_forwarded")] == ["198.51.100.3", "192.0.2.200"]
    check(parsed["nested_plain_http"], request_scheme="http", tls_version="", tls_cipher="", tls_server_name="")
    check(parsed["nested_odd_tls"], tls_version="UNKNOWN_1", tls_cipher="UNKNOWN_2")


@pytest.mark.parametrize(
    "name, reason",
    [
        ("prose", "unknown_format"), ("other_json", "unknown_format"), ("cut_json", "unknown_format"), ("flat_no_client", "missing_client_ip"),
        ("nested_no_ts", "missing_timestamp"), ("nested_no_request", "unknown_format"), ("nested_request_number", "missing_request"),
    ],
)
def test_rejects(parsed, name, reason):
    assert parsed[name]["reject_reason"] == reason and "empty" not in parsed


def test_unreadable_times_follow_the_file(spark, tmp_path):
    from hitledger.plans.ingest import ingest
    from hitledger.sources import logs, sinks

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join([flat(StartUTC="soon"), flat(), flat(StartUTC="later", RequestPath="/b")]))
    table = str(tmp_path / "table")
    for _ in range(2):
        sinks.append_requests(ingest(logs.read_lines(spark, str(tmp_path / "in"))), table)
    rows = sinks.read_requests(spark, table).collect()
    assert len(rows) == 3 and sorted(r["timestamp_defaulted"] for r in rows) == [False, True, True]
    assert all(abs(r["timestamp"] - datetime.now()) < timedelta(days=1, hours=1) for r in rows if r["timestamp_defaulted"])


def test_registry(spark):
    P.register_parser("upper", lambda df: df.selectExpr("upper(value) AS path"))
    assert P.parse_logs(spark.createDataFrame([("a",)], "value string"), "upper").first()["path"] == "A"
    del P.PARSERS["upper"]


def test_every_tls_code_has_its_name(spark):
    from hitledger.functions import fixed_values as fv

    pairs = [(v, 0) for v in fv.TLS_VERSIONS] + [(0, c) for c in fv.TLS_CIPHERS]
    df = spark.createDataFrame(pairs, "v int, c int").select("*", P.tls_version_name(F.col("v")).alias("vn"), P.tls_cipher_name(F.col("c")).alias("cn"))
    for r in df.collect():
        assert (r.vn, r.cn) == (fv.TLS_VERSIONS.get(r.v, ""), fv.TLS_CIPHERS.get(r.c, ""))
