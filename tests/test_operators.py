import random

import pytest
from pyspark.sql import functions as F

from hitledger.functions.predicates import Scope
from hitledger.operators import clients, cleaning, enrichment, latency, periods
from hitledger.sources.ranges import cidr_bounds


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 101, 5_000])
def test_exact_percentiles_against_sorting(spark, n):
    rng = random.Random(n)
    values = [rng.choice([rng.lognormvariate(3, 2), 5.0, round(rng.random(), 1) + 0.1, 1e7]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    got = latency.exact_percentiles(df, "v", latency.overall_offset).first()
    ordered = sorted(values)
    assert [got[p] for p in latency.RANKS] == [ordered[int((n - 1) * q)] for q in (0.5, 0.95, 0.99)]


def test_exact_percentiles_per_group_with_a_dominating_group(spark):
    rng = random.Random(5)
    rows = [("hot", rng.choice([1.5, rng.random() + 1])) for _ in range(3_000)] + [(f"k{i % 50}", rng.random() * 9 + 0.1) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {r["k"]: (r["p50"], r["p95"], r["p99"]) for r in latency.exact_percentiles(df, "v", latency.client_offset, by=["k"]).collect()}
    groups: dict = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    for k, vs in groups.items():
        vs.sort()
        n = len(vs)
        assert got[k] == (vs[n // 2], vs[n * 95 // 100], vs[n * 99 // 100])


def test_no_measured_requests_gives_zeros(requests_of):
    df = requests_of({"timestamp": "2024-01-01", "response_time_ms": 0.0})
    assert tuple(latency.response_time_stats(df, Scope(hours=0)).first()) == (0.0,) * 6


def test_approximate_percentiles_are_close(spark):
    df = spark.range(1, 10_001).select(F.col("id").cast("double").alias("v"))
    got = latency.approx_percentiles(df, "v").first()
    assert abs(got["p95"] - 9_500) <= 2 and abs(got["p50"] - 5_000) <= 2


def test_lookup_against_brute_force(spark):
    import ipaddress

    rng = random.Random(3)
    nets = [ipaddress.ip_network((rng.getrandbits(32) >> (32 - b) << (32 - b), b)) for b in [rng.randint(2, 30) for _ in range(150)]]
    nets += [ipaddress.ip_network((int(ipaddress.ip_address("2001:db8::")) + (rng.getrandbits(64) >> (128 - b) << (128 - b)), b)) for b in [rng.randint(70, 120) for _ in range(40)]]
    nets = list(dict.fromkeys(nets))
    ranges = spark.createDataFrame([(str(n[0]), str(n[-1]), str(n)) for n in nets], "start_ip string, end_ip string, geo_city string")
    ips = [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(300)] + [str(n[0]) for n in nets] + [str(n[-1]) for n in nets] + ["bad", "::1"]
    got = {r["client_ip"]: r["geo_city"] for r in enrichment.lookup_ips(spark.createDataFrame([(i,) for i in ips], "client_ip string"), city=ranges).collect()}
    for text in ips:
        try:
            address = ipaddress.ip_address(text)
        except ValueError:
            assert got[text] == ""
            continue
        inside = [n for n in nets if n.version == address.version and address in n]
        assert got[text] == (str(max(inside, key=lambda n: n.prefixlen)) if inside else ""), text


def test_ranges_that_are_no_blocks(spark):
    ranges = spark.createDataFrame([("10.0.0.250", "10.0.1.5", 7), ("10.0.1.6", "10.0.1.6", 8)], "start_ip string, end_ip string, asn int")
    ips = spark.createDataFrame([("10.0.0.249",), ("10.0.0.250",), ("10.0.1.5",), ("10.0.1.6",), ("10.0.1.7",)], "client_ip string")
    got = {r["client_ip"]: r["asn"] for r in enrichment.lookup_ips(ips, asn=ranges).collect()}
    assert got == {"10.0.0.249": 0, "10.0.0.250": 7, "10.0.1.5": 7, "10.0.1.6": 8, "10.0.1.7": 0}


def test_city_hit_blocks_country_fallback(spark):
    city = spark.createDataFrame([("10.0.0.0", "10.0.0.255", "Town")], "start_ip string, end_ip string, geo_city string")
    country = spark.createDataFrame([("10.0.0.0", "10.0.255.255", "XX")], "start_ip string, end_ip string, geo_country string")
    ips = spark.createDataFrame([("10.0.0.1",), ("10.0.9.1",)], "client_ip string")
    got = {r["client_ip"]: (r["geo_country"], r["geo_city"]) for r in enrichment.lookup_ips(ips, city=city, country=country).collect()}
    assert got == {"10.0.0.1": ("", "Town"), "10.0.9.1": ("XX", "")}


def test_cidr_bounds(spark):
    import ipaddress

    nets = ["10.0.0.0/8", "192.0.2.128/25", "192.0.2.7/32", "0.0.0.0/0", "2001:db8::/33", "2001:db8::1/128", "172.16.0.0/12"]
    for r in cidr_bounds(spark.createDataFrame([(n,) for n in nets], "network string")).collect():
        net = ipaddress.ip_network(r["network"])
        assert (ipaddress.ip_address(r["start_ip"]), ipaddress.ip_address(r["end_ip"])) == (net[0], net[-1])


def test_validity_names_first_broken_rule(requests_of):
    df = requests_of({"timestamp": "2024-01-01", "status_code": 600, "client_port": 70_000}, {"timestamp": "2024-01-01", "request_scheme": "wss", "status_code": 599})
    assert [r["broken_rule"] for r in cleaning.invalid_rows(df).collect()] == ["client_port"]
    assert cleaning.valid_rows(df).count() == 1


def test_capped_client_counts(requests_of, spark):
    rows = [{"timestamp": "2024-01-01", "client_ip": "a", "path": f"/{n}", "backend_name": f"b{n}"} for n in range(600)]
    tags = spark.createDataFrame([], "ip_address string, friendly_name string, tags string")
    df = requests_of(*rows)
    exact = clients.ip_stats(df, "a", Scope(hours=0), tags=tags).first()
    capped = clients.ip_stats(df, ["a"], Scope(hours=0), tags=tags, most_backends=100, most_paths=500).first()
    assert (exact["unique_backends"], exact["unique_paths"]) == (600, 600)
    assert (capped["unique_backends"], capped["unique_paths"]) == (100, 500)


def test_period_rules():
    with pytest.raises(ValueError):
        periods.periods_of(("a", "2024-01-01", "2024-01-02"))
    with pytest.raises(ValueError):
        periods.periods_of(("a", "2024-01-01", "2024-01-02"), ("b", "2024-01-02", "2024-01-02"))
    same = periods.preset_periods("same-hour-week", as_of="2024-01-10 07:30:00")
    assert [p.hours for p in same] == [7.5, 7.5] and same[1].end.isoformat() == "2024-01-03T07:30:00+00:00"
    assert [p.label for p in periods.preset_periods("24v24", as_of="2024-01-10")] == ["Last 24h", "Previous 24h"]


def test_trend_words(spark):
    cases = {(0, 0, 0): "none", (0, 2, 1): "appeared:2", (3, 2, 0): "disappeared:3", (1, 2, 3): "up", (3, 2, 1): "down", (1, 5, 2): "peak:2", (5, 1, 5): "dip:2", (2, 2, 2): "mixed", (4,): ""}
    for values, word in cases.items():
        assert spark.range(1).select(periods.trend_description(F.array(*(F.lit(v) for v in values)))).first()[0] == word
