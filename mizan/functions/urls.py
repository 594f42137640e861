"""URL predicates and links, as Column -> Column."""

from __future__ import annotations

import html
import ipaddress
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: href attributes, and quoted document addresses in scripts (fixed patterns).
HREF = r"""(?i)href\s*=\s*["']([^"']+)["']"""
QUOTED_PDF = r"""(?i)["']((?:https://[^"']+|/[^"']+?)\.pdf(?:\?[^"']*)?)["']"""


def part(url: Column, name: str) -> Column:
    """SCHEME, HOST, PATH and so on; null where the URL can't be read. Schemes and hosts in lower case."""
    if name == "SCHEME":
        return F.lower(F.nullif(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.lit("")))
    if name == "HOST":
        return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1), F.lit("")))
    if name == "PORT":
        return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]*):([0-9]+)", 1), F.lit("")).cast("int")
    if name == "USERINFO":
        return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*)@", 1), F.lit(""))
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def path_allowed(url: Column, prefixes: Column, excluded: Column) -> Column:
    """No excluded fragment in the path, and one of the prefixes at its start, if there are any; case does not count."""
    path = F.lower(part(url, "PATH"))
    out = F.exists(excluded, lambda x: F.contains(path, F.lower(x)))
    return ~out & ((F.size(prefixes) == 0) | F.exists(prefixes, lambda x: F.startswith(path, F.lower(x))))


def https_allowed(url: Column, require_https: bool = True) -> Column:
    has_host = part(url, "HOST").isNotNull()
    return has_host & part(url, "SCHEME").eqNullSafe(F.lit("https")) if require_https else has_host


# The blocks of addresses that registries set aside or that are private, and the exceptions within them.
BLOCKS_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.0/29", "192.0.0.8/32", "192.0.0.9/32", "192.0.0.10/32",
    "192.0.0.170/31", "192.0.2.0/24", "192.31.196.0/24", "192.52.193.0/24", "192.88.99.0/24", "192.168.0.0/16", "192.175.48.0/24", "198.18.0.0/15", "198.51.100.0/24",
    "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4", "255.255.255.255/32",
)
BLOCKS_V6 = (
    "::/128", "::1/128", "::/8", "::ffff:0:0/96", "64:ff9b::/96", "64:ff9b:1::/48", "100::/8", "100::/64", "200::/7", "400::/6", "800::/5", "1000::/4", "2001::/23", "2001::/32", "2001:1::1/128",
    "2001:1::2/128", "2001:1::3/128", "2001:2::/48", "2001:3::/32", "2001:4:112::/48", "2001:10::/28", "2001:20::/28", "2001:30::/28", "2001:db8::/32", "2002::/16", "2620:4f:8000::/48", "3fff::/20", "4000::/3",
    "5f00::/16", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fc00::/7", "fe00::/9", "fe80::/10", "fec0::/10", "ff00::/8",
)


def _set_aside(a: ipaddress.IPv4Address | ipaddress.IPv6Address) -> bool:
    return a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_reserved or a.is_unspecified


def intervals(blocks: tuple[str, ...]) -> list[tuple[int, int]]:
    """(first, last) of the addresses that are not public, sorted and apart; every border is one of a block's."""
    nets = [ipaddress.ip_network(b) for b in blocks]
    address, end = type(nets[0].network_address), 1 << nets[0].max_prefixlen
    borders = sorted({0, end} | {int(n.network_address) for n in nets} | {int(n.broadcast_address) + 1 for n in nets})
    out: list[tuple[int, int]] = []
    for first, after in zip(borders, borders[1:], strict=False):
        if _set_aside(address(first)):
            joins = out and out[-1][1] == first - 1
            out[-1:] = [(out[-1][0], after - 1)] if joins else [*out[-1:], (first, after - 1)]
    return out


def _inside(x: Column, table: list[tuple[int, int]], write: Callable[[int], object]) -> Column:
    """Whether x lies in one of sorted intervals, by binary search in an array."""
    firsts, lasts = (F.array(*(F.lit(write(t[k])) for t in table)) for k in (0, 1))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(table).bit_length()))))
    # the number of intervals that begin at x or before it
    n = F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= len(table)) & (F.get(firsts, n + step - 1) <= x), n + step).otherwise(n))
    return F.coalesce((n > 0) & (x <= F.get(lasts, n - 1)), F.lit(False))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_V4 = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4_WHOLE = rf"{_V4}(?:\.{_V4}){{3}}"


def v4_number(host: Column) -> Column:
    """bigint of a dotted address; null for other texts."""
    parts = F.split(F.regexp_extract(host, f"^{_V4_WHOLE}$", 0), r"\.")
    return F.when(F.size(parts) == 4, F.aggregate(parts, F.lit(0).cast("long"), lambda n, x: n * 256 + x.cast("long")))


def v6_digits(host: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address, brackets and zone left off; null for other texts. Digits order as numbers."""
    bare = F.lower(F.regexp_extract(host, r"^\[?([0-9A-Fa-f:.]+)(?:%[^%\]]+)?\]?$", 1))
    tail = v4_number(F.regexp_extract(bare, f":({_V4_WHOLE})$", 1))
    halves = F.concat(F.lower(F.hex(F.shiftright(tail, 16))), F.lit(":"), F.lower(F.hex(tail.bitwiseAND(65535))))
    plain = F.when(tail.isNotNull(), F.concat(F.regexp_extract(bare, f"^(.*:){_V4_WHOLE}$", 1), halves)).otherwise(bare)
    groups = lambda c: F.filter(F.split(c, ":", -1), lambda g: c != "")  # noqa: E731  none of an empty text
    padded = lambda gs: F.array_join(F.transform(gs, lambda g: F.lpad(g, 4, "0")), "")

    def told(sides: Column) -> Column:
        left, right = groups(F.get(sides, F.lit(0))), groups(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
        n = F.size(left) + F.size(right)
        whole = F.when(F.size(sides) == 1, n == 8).otherwise((F.size(sides) == 2) & (n <= 7)) & F.forall(F.concat(left, right), lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(whole, F.concat(padded(left), F.repeat(F.lit("0000"), 8 - n), padded(right)))

    return F.when(F.contains(plain, F.lit(":")), _let(F.split(plain, "::", -1), told))


_UNSAFE_V4, _UNSAFE_V6 = intervals(BLOCKS_V4), intervals(BLOCKS_V6)


def unsafe_literal_ip(host: Column) -> Column:
    """Whether a host is an IP address that is not public; names are not resolved and count as safe."""
    v4 = lambda x: _inside(x, _UNSAFE_V4, lambda n: n)
    v6 = lambda x: _inside(x, _UNSAFE_V6, lambda n: f"{n:032x}")
    return F.coalesce(_let(v4_number(F.trim(host)), v4), F.lit(False)) | F.when(F.contains(host, F.lit(":")), F.coalesce(_let(v6_digits(F.trim(host)), v6), F.lit(False))).otherwise(False)


def url_faults(url: Column, approved: Column) -> Column:
    """Reasons against fetching a document, in order of check; approved: the source takes direct documents."""
    checks = (
        (~part(url, "SCHEME").eqNullSafe(F.lit("https")), "not https"),
        (part(url, "HOST").isNull(), "no host"),
        (part(url, "USERINFO").isNotNull(), "credentials"),
        (~F.coalesce(part(url, "PORT"), F.lit(443)).eqNullSafe(F.lit(443)), "port"),
        (~F.coalesce(approved, F.lit(False)), "source not approved"),
        (unsafe_literal_ip(part(url, "HOST")), "address not public"),
    )
    return F.array_compact(F.array(*(F.when(bad, F.lit(why)) for bad, why in checks)))


@F.pandas_udf(T.StringType())
def unescaped(pages: pd.Series) -> pd.Series:
    """Character references decoded, escaped slashes made plain."""
    return pages.map(lambda p: html.unescape(p).replace("\\/", "/"), na_action="ignore")


#: scheme, authority, path, query, fragment of a reference; the groups that are absent are told by those before them.
_REFERENCE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
_BLANK = r"[\x00-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: Schemes whose references may be relative.
_RELATIVE = ("http", "https", "ftp")


def _split(url: Column) -> Column:
    names = ("scheme", "host", "path", "query", "fragment")
    return F.struct(*(F.regexp_extract(url, _REFERENCE, i + 1).alias(n) for i, n in enumerate(names)))


def _without_dots(segments: Column) -> Column:
    """The path of its segments: . and .. are worked out; those that lead out are dropped."""
    back = lambda out: F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))
    done = F.aggregate(segments, F.array().cast("array<string>"), lambda out, x: F.when(x == "..", back(out)).when(x == ".", out).otherwise(F.concat(out, F.array(x))))
    closed = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(done, F.array(F.lit("")))).otherwise(done)
    return F.coalesce(F.nullif(F.array_join(closed, "/"), F.lit("")), F.lit("/"))


def _without_gaps(segments: Column) -> Column:
    """Empty segments only at the ends."""
    return F.filter(segments, lambda x, i: (x != "") | (i == 0) | (i == F.size(segments) - 1))


def joined(base: Column | str, link: Column | str) -> Column:
    """The address that a link of a page at ``base`` leads to, by the rules of RFC 3986 as browsers keep them: a link with the
    scheme of its page and no host is relative. Links of other schemes stay as they are; null for broken hosts."""
    base, link = (F.col(c) if isinstance(c, str) else c for c in (base, link))
    bare = F.regexp_replace(F.regexp_replace(link, f"^{_BLANK}|{_BLANK}$", ""), r"[\t\r\n]", "")
    mark = lambda c: F.when(F.length(c) > 1, c).otherwise(F.lit(""))  # noqa: E731  a query or fragment of nothing is none

    def told(x: Column) -> Column:
        b, r, whole = x["b"], x["r"], x["whole"]
        scheme, own = F.lower(b["scheme"]), F.lower(r["scheme"])
        other = (own != "") & (own != scheme)
        has_host, has_path = F.length(r["host"]) > 2, r["path"] != ""
        base_parts = F.split(b["path"], "/", -1)
        folder = F.when(F.element_at(base_parts, -1) != "", F.slice(base_parts, F.lit(1), F.size(base_parts) - 1)).otherwise(base_parts)
        segments = F.when(F.startswith(r["path"], F.lit("/")), F.split(r["path"], "/", -1)).otherwise(_without_gaps(F.concat(folder, F.split(r["path"], "/", -1))))
        path = F.when(has_host, r["path"]).when(has_path, _without_dots(segments)).otherwise(b["path"])
        query = F.when(has_host | has_path | (F.length(r["query"]) > 1), mark(r["query"])).otherwise(mark(b["query"]))
        host = F.when(has_host, r["host"]).otherwise(b["host"])
        rooted = F.when((path != "") & ~F.startswith(path, F.lit("/")) & (F.length(host) > 2), F.concat(F.lit("/"), path)).otherwise(path)
        out = F.concat(scheme, F.lit(":"), host, rooted, query, mark(r["fragment"]))
        broken = F.contains(r["host"], F.lit("[")) != F.contains(r["host"], F.lit("]"))
        return F.when(whole == "", x["base"]).when(broken, F.lit(None)).when(other | ~scheme.isin(*_RELATIVE), whole).otherwise(out)

    return F.when(base.isNotNull() & link.isNotNull(), _let(F.struct(base.alias("base"), _split(base).alias("b"), _split(bare).alias("r"), bare.alias("whole")), told))


def links(page: Column) -> Column:
    """Distinct link targets of a page, as written."""
    return F.array_distinct(F.concat(F.regexp_extract_all(page, F.lit(HREF), F.lit(1)), F.regexp_extract_all(page, F.lit(QUOTED_PDF), F.lit(1))))
