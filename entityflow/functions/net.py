"""Addresses and URLs."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Address blocks that are not publicly routable, and public blocks inside them.
CLOSED_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
OPEN_V4 = ("192.0.0.9/32", "192.0.0.10/32")
CLOSED_V6 = (
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "2001::/23", "2001:db8::/32", "2002::/16",
    "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6",
    "fc00::/7", "fe00::/9", "fe80::/10", "ff00::/8",
)
OPEN_V6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once instead of wherever the body names it."""
    return F.transform(F.array(value), body)[0]


def _inside(address: Column, blocks: Sequence[str]) -> Column:
    """Is a 32-digit hex address in one of the blocks? (text order is number order)"""
    out = F.lit(False)
    for block in blocks:
        net = ipaddress.ip_network(block)
        low, high = (format(int(a), "032x") for a in (net[0], net[-1]))
        out = out | address.between(low, high)
    return out


def _v4_hex(ip: Column) -> Column:
    """Dotted quad as eight hex digits; NULL if malformed."""
    parts = F.split(ip, r"\.")
    byte = F.transform(parts, lambda p: F.lpad(F.lower(F.hex(p.cast("int"))), 2, "0"))
    shape = F.regexp_like(ip, F.lit(r"^(0|[1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}$"))
    return F.when(shape & F.forall(parts, lambda p: p.cast("int") <= 255), F.array_join(byte, ""))


def _v6_hex(ip: Column) -> Column:
    """IPv6 text, with or without a dotted tail, as 32 hex digits; NULL if malformed."""
    quad = r"\d{1,3}(\.\d{1,3}){3}$"

    def plain(text: Column) -> Column:
        tail = _v4_hex(F.regexp_extract(text, f"({quad})", 1))
        groups = F.concat(F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4))
        return F.when(F.regexp_like(text, F.lit(quad)), F.concat(F.regexp_replace(text, quad, ""), groups)).otherwise(text)

    def pieces(text: Column) -> Column:
        return F.filter(F.split(text, ":", -1), lambda g: F.length(text) > 0)

    def expand(halves: Column) -> Column:
        left, right = pieces(halves[0]), pieces(F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit("")))
        given, gap = F.size(left) + F.size(right), F.size(halves) == 2
        full = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - given, F.lit(0))), right)
        shape = (F.size(halves) <= 2) & F.when(gap, given <= 7).otherwise(given == 8)
        clean = F.forall(full, lambda g: F.regexp_like(g, F.lit("^[0-9a-f]{1,4}$")))
        return F.when(shape & clean, F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""))

    return _let(F.split(plain(F.lower(ip)), "::", -1), expand)


def is_public(ip: Column) -> Column:
    """True only for a well-formed, publicly routable IPv4 or IPv6 address; mapped IPv6 counts as its IPv4."""
    v4_prefix = "0" * 20 + "ffff"

    def judge(address: Column) -> Column:
        v4 = F.concat(F.lit("0" * 24), F.substring(address, 25, 8))
        mapped = _inside(v4, OPEN_V4) | ~_inside(v4, CLOSED_V4)
        return F.when(address.startswith(v4_prefix), mapped).otherwise(_inside(address, OPEN_V6) | ~_inside(address, CLOSED_V6))

    address = F.coalesce(F.concat(F.lit(v4_prefix), _v4_hex(ip)), _v6_hex(ip))
    return F.coalesce(_let(address, judge), F.lit(False))
