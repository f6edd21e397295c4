"""Range tables from CSV files, addresses of both families, and all bot names."""

from hitledger.functions import fixed_values as fv
from hitledger.functions.useragent import parse_user_agent
from hitledger.operators.enrichment import lookup_ips
from hitledger.sources import ranges


def csv(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_lookup_in_csv_tables(spark, tmp_path):
    places = csv(tmp_path / "places.csv", "geoname_id,country_iso_code,country_name,city_name", "1,AA,Aland,Alpha", "2,BB,Bland,Beta", "3,CC,Cland,")
    city = csv(
        tmp_path / "city.csv", "network,geoname_id,latitude,longitude", "10.0.0.0/8,1,1.5,-2.5", "10.1.2.0/23,2,3.5,4.5", "2001:db8::/32,2,5.5,6.5", "2001:db8:0:1::/64,1,,",
    )
    country = csv(tmp_path / "country.csv", "network,geoname_id", "10.0.0.0/8,3", "192.0.2.128/25,3", "::/0,3")
    asn = csv(tmp_path / "asn.csv", "network,autonomous_system_number,autonomous_system_organization", "10.1.0.0/16,64501,Net One", "2001:db8::/33,64502,Net Six")
    ips = ["10.200.0.1", "10.1.2.0", "10.1.3.255", "10.1.4.0", "192.0.2.127", "192.0.2.128", "2001:db8::1", "2001:DB8:0:1::ffff", "2001:db8:8000::1", "fe80::1", "not an address", ""]
    found = lookup_ips(
        spark.createDataFrame([(i,) for i in ips + ips[:3]], "client_ip string"),
        city=ranges.read_city_ranges(spark, city, places), country=ranges.read_country_ranges(spark, country, places), asn=ranges.read_asn_ranges(spark, asn),
    )
    got = {r["client_ip"]: (r["geo_country"], r["geo_city"], r["geo_lat"], r["asn"], r["asn_org"]) for r in found.collect()}
    assert found.count() == len(ips)
    assert got == {
        "10.200.0.1": ("AA", "Alpha", 1.5, 0, ""), "10.1.2.0": ("BB", "Beta", 3.5, 64501, "Net One"), "10.1.3.255": ("BB", "Beta", 3.5, 64501, "Net One"),
        "10.1.4.0": ("AA", "Alpha", 1.5, 64501, "Net One"), "192.0.2.127": ("", "", 0.0, 0, ""), "192.0.2.128": ("CC", "", 0.0, 0, ""),
        "2001:db8::1": ("BB", "Beta", 5.5, 64502, "Net Six"), "2001:DB8:0:1::ffff": ("AA", "Alpha", 0.0, 64502, "Net Six"),
        "2001:db8:8000::1": ("BB", "Beta", 5.5, 0, ""), "fe80::1": ("CC", "", 0.0, 0, ""), "not an address": ("", "", 0.0, 0, ""), "": ("", "", 0.0, 0, ""),
    }


def test_country_names_from_csv(spark, tmp_path):
    path = csv(tmp_path / "names.csv", "code,name,continent", "AA,Aland,Europe")
    assert [tuple(r) for r in ranges.read_country_names(spark, path).collect()] == [("AA", "Aland", "Europe")]


def test_every_bot_has_its_name(spark):
    agents = [(f"{part}/1.0 (a bot)", label) for part, label in fv.BOTS] + [("some spider", "Bot")]
    rows = parse_user_agent(spark.createDataFrame(agents, "user_agent string, want string")).collect()
    assert [(r["browser"], r["device_type"]) for r in rows] == [(r["want"], "bot") for r in rows]
