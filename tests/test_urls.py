"""References and addresses against the standard library."""

import ipaddress
import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

from mizan.functions import urls

# the examples of RFC 3986, 5.4
BASE = "http://a/b/c/d;p?q"
RFC = {
    "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s",
    "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/",
    "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g",
    "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y",
    "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x", "http:g": "http://a/b/c/g", "mailto:x@y": "mailto:x@y",
}


def test_examples_of_the_standard(spark):
    df = spark.createDataFrame([(BASE, x) for x in RFC], "base string, link string")
    assert {r["link"]: r["j"] for r in df.select("link", urls.joined("base", "link").alias("j")).collect()} == RFC


def test_references_equal_the_library(spark):
    rnd = random.Random(1)
    bases = ["https://h.example", "https://h.example/", "https://h.example/a/b", "https://h.example/a/b/?q=1#f", "http://u@h:80/a//b/../c", "HTTPS://H.example/x"]
    pieces = ["a", "b.pdf", ".", "..", "/", "//", "?", "#", "x=1", "https:", "http://", "h2", ":", "mailto:", " ", "é", "%20", "[", "]"]
    pairs = [(rnd.choice(bases), "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 6)))) for _ in range(3000)] + [(None, "a"), ("https://h/", None), ("https://h/", " \n a\tb ")]

    def want(base, link):
        try:
            return None if base is None or link is None else urljoin(base, link.strip())
        except ValueError:
            return None

    df = spark.createDataFrame(pairs, "base string, link string")
    wrong = []
    for r in df.select("base", "link", urls.joined("base", "link").alias("j")).collect():
        w = want(r["base"], r["link"])
        if r["j"] != w and not ("[" in (r["link"] or "") or "]" in (r["link"] or "")):
            wrong.append((r["base"], r["link"], r["j"], w))
    assert not wrong, wrong[:10]


def unsafe(h):
    try:
        a = ipaddress.ip_address((h or "").strip("[]"))
    except ValueError:
        return False
    return a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_reserved or a.is_unspecified


def test_addresses_equal_the_library(spark):
    rnd, hosts = random.Random(2), [None, "", "h.example", "1.2.3", "1.2.3.4.5", "01.2.3.4", "256.1.1.1", "::1::", "1:2:3:4:5:6:7:8:9", ":::", "::", "[::1]", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "fe80::1%eth0", "12345::", ":1", "1:", "::1.2.3.4", "1::2:3:4:5:6:7", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8::", "::ffff:1.2.3", "64:ff9b::8.8.8.8", "1.1.1.1:2"]
    for block in (*urls.BLOCKS_V4, *urls.BLOCKS_V6):
        n = ipaddress.ip_network(block)
        kind, top = type(n.network_address), 1 << n.max_prefixlen
        hosts += [str(kind(x)) for x in {int(n.network_address) - 1, int(n.network_address), int(n.broadcast_address), int(n.broadcast_address) + 1} if 0 <= x < top]
    hosts += [str(ipaddress.IPv4Address(rnd.getrandbits(32))) for _ in range(800)]
    for _ in range(1500):
        a = ipaddress.IPv6Address(rnd.choice([rnd.getrandbits(128), rnd.getrandbits(64), rnd.getrandbits(32) | 0xFFFF << 32, (0x20 << 120) | rnd.getrandbits(110)]))
        hosts.append(rnd.choice([str(a), a.exploded, f"[{a}]", str(a).upper()]))
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    wrong = [(r["h"], r["u"]) for r in df.select("h", urls.unsafe_literal_ip(F.col("h")).alias("u")).collect() if r["u"] != unsafe(r["h"])]
    assert not wrong, wrong[:20]


def test_numbers(spark):
    df = spark.createDataFrame([("1.2.3.4", "::1"), ("255.255.255.255", "2001:DB8::a:0:1.2.3.4"), ("x", "x")], "a string, b string")
    got = [tuple(r) for r in df.select(urls.v4_number(F.col("a")), urls.v6_digits(F.col("b"))).collect()]
    assert got == [(0x01020304, f"{1:032x}"), (2**32 - 1, ipaddress.IPv6Address("2001:db8::a:0:1.2.3.4").exploded.replace(":", "")), (None, None)]
