"""Whether an address or a URL may be fetched from: addresses of any form as numbers, looked up in reserved ranges.

IPv4 addresses are longs, IPv6 addresses strings of 32 hex digits, which compare as their 128-bit values do. Everything is a
built-in expression. Nulls and what is no address give null as a value and false as public.
"""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

#: IPv4 ranges that no public host has, and addresses within them that are public.
RESERVED_4 = """
0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16
198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4
""".split()
PUBLIC_4 = "192.0.0.9/32 192.0.0.10/32".split()
#: The IPv6 range of public hosts, what is reserved in it, and what is public in that.
UNICAST_6 = ["2000::/3"]
RESERVED_6 = "2001::/23 2001:db8::/32 2002::/16".split()
PUBLIC_6 = "2001:1::1/128 2001:1::2/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28".split()
#: IPv6 ranges whose last 32 bits are the IPv4 address that is reached.
HOLDS_4 = "::ffff:0:0/96 64:ff9b::/96 64:ff9b:1::/48".split()
#: Names of hosts inside a network.
INTERNAL = r"(^|\.)localhost$|\.(local|internal)$"


def _within_4(value: Column, ranges: list[str]) -> Column:
    nets = [ipaddress.ip_network(r) for r in ranges]
    return reduce(Column.__or__, (value.between(int(n[0]), int(n[-1])) for n in nets))


def _within_6(value: Column, ranges: list[str]) -> Column:
    nets = [ipaddress.ip_network(r) for r in ranges]
    return reduce(Column.__or__, (value.between(f"{int(n[0]):032x}", f"{int(n[-1]):032x}") for n in nets))


def ipv4(s: Column) -> Column:
    """The value of a dotted address of four decimal parts without leading noughts."""
    part = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    parts = F.transform(F.split(s, r"\."), lambda x: x.cast("long"))
    return F.when(F.regexp_like(s, F.lit(rf"^{part}(\.{part}){{3}}$")), F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x))


def legacy_ipv4(s: Column) -> Column:
    """The value of an address as old parsers take it: one to four parts, each decimal, octal after 0 or hex after 0x; the last fills what is left."""
    part = "(0x[0-9a-f]{1,15}|0[0-7]{0,20}|[1-9][0-9]{0,17})"

    def number(x: Column) -> Column:
        octal = F.conv(F.concat(F.lit("0"), x), 8, 10)
        return F.when(F.startswith(x, F.lit("0x")), F.conv(F.concat(F.lit("0"), F.substring(x, 3, 20)), 16, 10)).when(F.startswith(x, F.lit("0")), octal).otherwise(x).cast("decimal(20,0)")

    def value(parts: Column) -> Column:
        n = F.size(parts)
        last, head = F.element_at(parts, -1), F.slice(parts, F.lit(1), n - 1)
        room = F.element_at(F.array(*(F.lit(256**k) for k in (4, 3, 2, 1))), n)
        fits = (last < room) & ~F.exists(head, lambda x: x > 255)
        high = F.aggregate(head, F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
        return F.when(fits, high * room + last.cast("long"))

    return F.when(F.regexp_like(s, F.lit(rf"^{part}(\.{part}){{0,3}}$")), bound(F.transform(F.split(s, r"\."), number), value))


def ipv6(s: Column) -> Column:
    """The 32 hex digits of an IPv6 address; its last two groups may be written as IPv4."""
    tail = F.regexp_extract(s, r"^.*:([0-9]+(?:\.[0-9]+){3})$", 1)
    digits = lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")
    groups = lambda v: F.concat(F.regexp_extract(s, r"^(.*:)[^:]*$", 1), F.substring(digits(v), 1, 4), F.lit(":"), F.substring(digits(v), 5, 4))
    plain = F.lower(F.when(tail == "", s).otherwise(bound(ipv4(tail), lambda v: F.when(v.isNotNull(), groups(v)))))
    halves = F.split(plain, "::")
    listed = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":"))

    def whole(h: Column) -> Column:
        left, right = listed(F.get(h, F.lit(0))), listed(F.get(h, F.lit(1)))
        filled = lambda gap: F.concat(left, F.array_repeat(F.lit("0"), gap), right)
        return F.when(F.size(h) == 1, left).when((F.size(h) == 2) & (F.size(left) + F.size(right) <= 7), filled(8 - F.size(left) - F.size(right)))

    def joined(found: Column) -> Column:
        good = (F.size(found) == 8) & F.forall(found, lambda x: F.regexp_like(x, F.lit("^[0-9a-f]{1,4}$")))
        return F.when(good, F.array_join(F.transform(found, lambda x: F.lpad(x, 4, "0")), ""))

    return bound(bound(halves, whole), joined)


def is_public_v4(value: Column) -> Column:
    return F.coalesce(~_within_4(value, RESERVED_4) | _within_4(value, PUBLIC_4), F.lit(False))


def is_public_v6(digits: Column) -> Column:
    """Whether 32 hex digits are a public host's; where they hold an IPv4 address, whether that is one's."""
    own = _within_6(digits, UNICAST_6) & (~_within_6(digits, RESERVED_6) | _within_6(digits, PUBLIC_6))
    held = F.conv(F.substring(digits, 25, 8), 16, 10).cast("long")
    return F.coalesce(F.when(_within_6(digits, HOLDS_4), is_public_v4(held)).otherwise(own), F.lit(False))


def is_public_ip(s: Column) -> Column:
    """Whether a text is the address of a public host; brackets and an IPv6 zone are left out of it."""
    bare = F.split(F.regexp_replace(F.trim(s), r"^[\[\]]+|[\[\]]+$", ""), "%")[0]
    public = lambda x: F.when(F.contains(x, F.lit(":")), bound(ipv6(x), is_public_v6)).otherwise(bound(ipv4(x), is_public_v4))
    return F.coalesce(bound(bare, public), F.lit(False))


def blocked(url: Column) -> Column:
    """Why a URL may not be fetched: scheme, credentials, host, internal or address; null if it may, or if its name is to be resolved first.

    Addresses that a name resolves to are tested with is_public_ip.
    """
    scheme = F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)

    def reason(place: Column) -> Column:
        # a host ends before its port; an IPv6 address stands in brackets
        host = F.lower(F.coalesce(F.nullif(F.regexp_extract(place, r"^\[([^\]]*)\]", 1), F.lit("")), F.regexp_extract(place, r"^([^:]*)", 1)))
        return bound(F.regexp_replace(host, r"\.+$", ""), of_host)

    def of_host(host: Column) -> Column:
        number = F.regexp_like(host, F.lit("^[0-9a-fx.]*[0-9][0-9a-fx.]*$"))
        private = F.when(F.contains(host, F.lit(":")), ~is_public_ip(host)).when(number, bound(legacy_ipv4(host), lambda v: v.isNotNull() & ~is_public_v4(v))).otherwise(F.lit(False))
        return F.when(host == "", "host").when(F.regexp_like(host, F.lit(INTERNAL)), "internal").when(private, "address")

    return F.when(url.isNull() | ~scheme.isin("http", "https"), "scheme").when(F.contains(authority, F.lit("@")), "credentials").otherwise(bound(authority, reason))
