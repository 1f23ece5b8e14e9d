"""Addresses and networks against the standard library."""

import ipaddress
import random

from pyspark.sql import functions as F

from palisade.functions.address import address_bits, network_bits, range_networks
from palisade.operators.enrich import geo_enrich


def bits(ip):
    try:
        a = ipaddress.ip_address(ip.split("%")[0])
    except ValueError:
        return None
    a = getattr(a, "ipv4_mapped", None) or a
    return f"{a.version}{int(a):0{a.max_prefixlen}b}"


def some_addresses():
    rng = random.Random(2)
    v4 = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(40)]
    v6 = [ipaddress.IPv6Address(rng.getrandbits(128) & rng.choice([-1, (1 << 16) - 1, ~0xFFFFFFFF << 40, ~(0xFFFF << 64)])) for _ in range(40)]
    odd = ["0.0.0.0", "255.255.255.255", "256.1.1.1", "1.2.3", "1.2.3.4.5", "", "x", "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3", ":1::2", "1:::2",
           "12345::", "::ffff:1.2.3.4", "::ffff:102:304", "64:ff9b::1.2.3.4", "::1.2.3.400", "fe80::1%eth0", "FE80::Ab", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "g::"]
    return v4 + [str(a) for a in v6] + [a.exploded.upper() for a in v6[:9]] + odd


def test_bits_of_addresses(spark):
    rows = spark.createDataFrame([(a,) for a in some_addresses()] + [(None,)], "ip string")
    got = {r.ip: r.b for r in rows.select("ip", address_bits(F.col("ip")).alias("b")).collect()}
    assert got == {a: bits(a) for a in some_addresses()} | {None: None}


def test_bits_of_networks(spark):
    want = {"10.": "4" + f"{10:08b}", "175.45.176.": "4" + "".join(f"{o:08b}" for o in (175, 45, 176)), "10.1.2.3/8": "4" + f"{10:08b}", "0.0.0.0/0": "4", "::/0": "6",
            "1.2.3.4": bits("1.2.3.4"), "1.2.3.4/33": None, "1.2.3.4/x": None, "1.2.3.4/8/8": None, "2001:db8::/33": bits("2001:db8::")[:34], "::ffff:10.0.0.0/104": "4" + f"{10:08b}",
            "::ffff:10.0.0.0/90": None, "300.": None, "a.b.": None, "": None, None: None}
    rows = spark.createDataFrame([(n,) for n in want], "n string")
    assert {r.n: r.b for r in rows.select("n", network_bits(F.col("n")).alias("b")).collect()} == want


def test_ranges_become_networks(spark):
    rng = random.Random(3)
    pairs = [tuple(sorted(rng.getrandbits(rng.choice([32, 9, 3])) for _ in range(2))) for _ in range(40)] + [(0, 2 ** 32 - 1), (5, 5), (9, 4)]
    rows = [(str(ipaddress.IPv4Address(a)), str(ipaddress.IPv4Address(b))) for a, b in pairs] + [("x", "1.1.1.1")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", range_networks(F.col("a"), F.col("b")).alias("n")).collect()
    for r in got:
        whole = r.a != "x" and ipaddress.IPv4Address(r.a) <= ipaddress.IPv4Address(r.b)
        want = list(map(str, ipaddress.summarize_address_range(ipaddress.IPv4Address(r.a), ipaddress.IPv4Address(r.b)))) if whole else []
        assert sorted(r.n) == sorted(want)


def test_longest_of_nested_networks(spark):
    rng = random.Random(4)
    networks = sorted({str(ipaddress.ip_network((rng.getrandbits(32) & 0x0FFFFFFF | 0x0A000000, n), strict=False)) for n in range(0, 33) for _ in range(3)})
    networks += ["2001:db8::/32", "2001:db8:8000::/33", "2001:db8:8000::/127"]
    ips = [str(ipaddress.IPv4Address(rng.getrandbits(28) | 0x0A000000)) for _ in range(150)] + [n.split("/")[0] for n in networks] + ["2001:db8::1", "2001:db8:8000::1", "2001:db8:9::", "::1", "bad", None]
    events = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "id int, source_ip string")
    places = spark.createDataFrame([(n, n) for n in networks] * 2 + [("nonsense", "no")], "prefix string, country string")

    def best(ip):
        try:
            a = ipaddress.ip_address(ip)
        except ValueError:
            return "Unknown"
        held = [n for n in map(ipaddress.ip_network, networks) if a.version == n.version and a in n]
        return str(max(held, key=lambda n: n.prefixlen)) if held else "Unknown"

    got = {r.id: r.country for r in geo_enrich(events, places).collect()}
    assert got == {i: best(ip) if ip else "Unknown" for i, ip in enumerate(ips)}
