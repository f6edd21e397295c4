import ipaddress
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from hitledger.functions import instants, measures
from hitledger.functions.net import ip_key
from hitledger.functions.predicates import Exclusion, Scope, Service
from hitledger.functions.useragent import parse_user_agent


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_user_agents(spark):
    cases = {
        "": ("", "", "", "", ""),
        "Mozilla/5.0 (iPad; CPU OS 16_5 like Mac OS X) AppleWebKit Version/16.5 Mobile Safari/604.1": ("Safari", "16.5", "iOS", "16.5", "mobile"),
        "Mozilla/5.0 (Linux; Android 14; Pixel 8) Chrome/120.0.0.0 Mobile": ("Chrome", "120.0", "Linux", "", "mobile"),
        "Mozilla/5.0 (Linux; Android 8.1; X) Chrome/99.0.1": ("Chrome", "99.0", "Android", "8.1", "mobile"),
        "Mozilla/5.0 (Windows NT 6.1) Chrome/90.0 OPR/76.0": ("Chrome", "90.0", "Windows", "6.1", "desktop"),
        "Mozilla/5.0 (Windows NT 6.3; Trident/7.0; rv:11.0) like Gecko": ("IE", "11.0", "Windows", "6.3", "desktop"),
        "Mozilla/5.0 (X11; CrOS x86_64)": ("Unknown", "", "ChromeOS", "", "desktop"),
        "python-requests/2.31": ("Python Client", "", "Bot", "", "bot"),
        "SomeCrawler": ("Bot", "", "Bot", "", "bot"),
        "strange": ("Unknown", "", "Unknown", "", "desktop"),
    }
    df = parse_user_agent(spark.createDataFrame([(k,) for k in cases], "user_agent string"))
    for r in df.collect():
        assert (r["browser"], r["browser_version"], r["os"], r["os_version"], r["device_type"]) == cases[r["user_agent"]], r


def test_ip_keys(spark):
    texts = ["1.2.3.4", "01.2.3.4", "256.1.1.1", "::1", "::", "2001:db8::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::ffff:1.2.3.4", "1::2::3",
             ":1:2", "g::1", "1:2:3:4:5:6:7", "", "64:ff9b::1.2.3.4", "1:2:3:4:5:6:7:8:9", "::1:2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4", ":::", "x.y"]

    def expected(text):
        try:
            address = ipaddress.ip_address(text)
        except ValueError:
            return None
        mapped = getattr(address, "ipv4_mapped", None)
        address = mapped or address
        return f"{int(address):0{8 if address.version == 4 else 32}x}"

    got = spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", ip_key(F.col("ip")).alias("key")).collect()
    assert {r["ip"]: r["key"] for r in got} == {t: expected(t) for t in texts}


def test_referrer_domain_steps(spark):
    cases = {
        "https://www.Example.com:8080/a?b": "example.com", "//cdn.example.org/x": "cdn.example.org", "HTTP://WWW.x.org/": "www.x.org",
        "http://my.www.site.com/": "my.site.com", "example.com?q=1": "example.com?q=1", "http://u@host/": None, "http:///path": None, "http://:80": "",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "r string").select("r", measures.referrer_domain(F.col("r")).alias("d")).collect()
    assert {r["r"]: r["d"] for r in rows} == cases


def test_display_name(spark):
    cases = {"7-shop-api-service@docker": "shop api", "app-service@docker": "app", "plain": "plain", "": "", "1-a": "a", "x-service-y@z": "service y"}
    rows = spark.createDataFrame([(k,) for k in cases], "b string").select("b", measures.display_name(F.col("b")).alias("d")).collect()
    assert {r["b"]: r["d"] for r in rows} == cases


def test_buckets_match_python_over_years(spark):
    start = datetime(1999, 12, 25, 5, 7, 9, tzinfo=timezone.utc)
    moments = [start + timedelta(hours=37 * n) for n in range(6_000)]
    df = spark.createDataFrame([(t, t.isoformat()) for t in moments], "t timestamp, text string")
    units = ("hour", "6h", "day", "month", "week")
    df = df.select("text", instants.day_of_week(F.col("t")).alias("dow"), instants.hour_of_day(F.col("t")).alias("h"),
                   *(instants.bucket_label(instants.bucket_key(F.col("t"), u), u).alias(u) for u in units))
    for r in df.collect():
        t = datetime.fromisoformat(r["text"])
        want = (t.strftime("%Y-%m-%dT%H:00:00Z"), f"{t:%Y-%m-%d}T{t.hour // 6 * 6:02d}:00:00Z", t.strftime("%Y-%m-%dT00:00:00Z"), t.strftime("%Y-%m"), t.strftime("%Y-W%W"))
        assert tuple(r[u] for u in units) == want
        assert (r["dow"], r["h"]) == (int(t.strftime("%w")), t.hour)


@pytest.mark.parametrize(
    "seconds, text",
    [(0, "0 seconds"), (1, "1 second"), (61, "1 minute, 1 second"), (3600, "1 hour"), (90_000, "1 day, 1 hour"), (-172_800, "2 days")],
)
def test_age_text(spark, seconds, text):
    assert one(spark, measures.age_text(F.lit(seconds))) == text


def test_windows_and_services_on_three_rows(requests_of):
    """Three rows: two within a day, two of one service."""
    df = requests_of(
        {"timestamp": "2024-01-30 23:00:00", "client_ip": "1.2.3.4", "backend_name": "svc-a", "status_code": 200, "response_size": 100},
        {"timestamp": "2024-01-30 22:00:00", "client_ip": "1.2.3.4", "backend_name": "svc-b", "status_code": 200, "response_size": 200},
        {"timestamp": "2024-01-21 00:00:00", "client_ip": "1.2.3.4", "backend_name": "svc-a", "status_code": 200, "response_size": 400},
    ).drop("partition_key")
    now = "2024-01-31"
    assert Scope(now, 24).apply(df).count() == 2
    assert Scope(now, 0).apply(df).count() == 3
    assert Scope(now, 0, services=(Service("svc-a", "backend_name"),)).apply(df).count() == 2
    assert Scope(now, 24, services=(Service("svc-b", "backend_name"),)).apply(df).count() == 1
    assert Scope("2024-01-31", 1).apply(df).count() == 0  # lower bound is exclusive


def test_service_types(requests_of):
    rows = requests_of(
        {"timestamp": "2024-01-01", "backend_name": "x", "backend_url": "", "host": "", "client_ip": "a"},
        {"timestamp": "2024-01-01", "backend_name": "", "backend_url": "x", "host": "", "client_ip": "a"},
        {"timestamp": "2024-01-01", "backend_name": "", "backend_url": "y", "host": "x", "client_ip": "b"},
    )
    count = lambda kind: Scope(hours=0, services=(Service("x", kind),)).apply(rows).count()
    assert [count(k) for k in ("auto", "auto_loose", "host", "backend_url", "nonsense")] == [2, 3, 1, 1, 2]
    excluded = Scope(hours=0, exclude=Exclusion(("a",), (Service("x", "backend_url"),))).apply(rows)
    assert excluded.count() == 2
    assert Scope(hours=0, exclude=Exclusion(())).apply(rows).count() == 3
