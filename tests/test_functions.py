"""Exact-number checks of the scalar functions."""

import ipaddress
import random
import uuid

import pytest
from pyspark.sql import functions as F

from entityflow.functions import fingerprint, money, net, text, vectors


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_is_public_agrees_with_stdlib(spark):
    def public(s):
        try:
            ip = ipaddress.ip_address(s)
        except ValueError:
            return False
        if isinstance(ip, ipaddress.IPv6Address) and ip.ipv4_mapped is not None:
            ip = ip.ipv4_mapped
        bad = ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified
        return not bad and not (ip.version == 4 and ip in ipaddress.ip_network("100.64.0.0/10"))

    rng = random.Random(5)
    ips = [
        "8.8.8.8", "10.0.0.1", "172.15.0.1", "172.16.0.1", "192.0.0.9", "192.0.0.8", "100.64.0.1", "100.128.0.1", "0.0.0.0",
        "255.255.255.255", "1.2.3", "1.2.3.256", "01.2.3.4", "", "x", "::", "::1", "::ffff:8.8.8.8", "::ffff:10.0.0.1",
        "::ffff:0a00:1", "2001:4860:4860::8888", "2001:db8::1", "2001:3::1", "2001:1::1", "2001:1::3", "2002::1", "fe80::1",
        "fc00::1", "ff02::1", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8", "2606:4700:0:0:0:0:0:1111", "2606:4700::1.2.3.4", "g::1",
        "fec0::1", "64:ff9b::1",
    ]
    ips += [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(200)]
    ips += [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(100)]
    ips += [str(ipaddress.IPv6Address((0x2001 << 112) | rng.getrandbits(112) >> rng.randrange(40))) for _ in range(100)]
    got = one(spark, [(i,) for i in ips], "ip string", "ip", net.is_public(F.col("ip")))
    assert {i: p for i, p in got} == {i: public(i) for i in ips}


def test_numbers_and_names(spark):
    rows = [("Illus. 012/198 SWSH039",), ("SWSH039",), ("none",), ("170 HP Porygon2  HP 60",), ("Zygarde 10% Forme hp",)]
    got = one(spark, rows, "t string", text.parse_number(F.col("t")), text.clean_name(F.col("t")))
    assert [g[0] for g in got] == ["012/198", "SWSH039", None, None, None]
    assert got[3][1] == "Porygon2" and got[4][1] == "Zygarde 10% Forme"
    norm = one(spark, [("012/198",), ("000/010",), ("SM012",), ("1 / 2",)], "t string", text.norm_number(F.col("t")))
    assert [n[0] for n in norm] == ["12/198", "0/10", "SM012", "1/2"]


def test_stable_id_is_uuid5(spark):
    ns = uuid.uuid5(uuid.NAMESPACE_URL, "x")
    names = ["base1-4", "é", "", "a" * 100]
    got = one(spark, [(n,) for n in names], "n string", text.stable_id(F.col("n"), ns))
    assert [g[0] for g in got] == [str(uuid.uuid5(ns, n)) for n in names]


def test_signed64_round_trip(spark):
    values = [0, 1, 2**63 - 1, 2**63, 2**64 - 1]
    got = one(
        spark, [(str(v),) for v in values], "u string",
        fingerprint.signed64(F.col("u").cast("decimal(20,0)")),
        fingerprint.unsigned64(fingerprint.signed64(F.col("u").cast("decimal(20,0)"))).cast("string"),
    )
    assert [g[0] for g in got] == [v - 2**64 if v >= 2**63 else v for v in values]
    assert [g[1] for g in got] == [str(v) for v in values]


def test_fingerprint_bits(spark):
    rng = random.Random(1)
    rows = [([rng.uniform(-1, 1) for _ in range(64)],) for _ in range(20)] + [([0.0] * 64,)]
    got = one(spark, rows, "c array<double>", "c", fingerprint.bits_from_coefficients(F.col("c")))
    for c, bits in got:
        median = sorted(c[1:])[31]
        want = 0
        for i in range(64):
            want = want * 2 + (1 if i and c[i] > median else 0)
        assert bits == want


def test_money(spark):
    got = one(spark, [(1234,), (5,), (0,), (None,)], "c int", money.format_cents(F.col("c")), money.export_price_display(F.col("c")))
    assert got == [("$12.34", "$12.34"), ("$0.05", "$0.05"), ("$0.00", "$0.00"), (None, "no price data")]
    cents = one(spark, [(9.5,), (0.125,), (None,)], "m double", money.cents_from_market(F.col("m")))
    assert [c[0] for c in cents] == [950, 12, None]


def test_vectors(spark):
    got = one(spark, [([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>", vectors.l2_normalise(F.col("v")))
    assert got[0][0] == pytest.approx([0.6, 0.8]) and got[1][0] == [0.0, 0.0]


def test_email(spark):
    rows = [(" A.b+c@X.example.COM ",), ("a@b",), (".a@b.co",), ("a..b@c.co",), ("x" * 250 + "@c.co",)]
    email, ok = text.norm_email(F.col("e"))
    got = one(spark, rows, "e string", email, ok)
    assert got[0] == ("a.b+c@x.example.com", True) and [g[1] for g in got[1:]] == [False] * 4


def test_json_block(spark):
    rows = [('x {"a": {"b": 1}} y',), ("{bad}",), ("[1]",), (None,), ('{"a":1} {"b":2}',)]
    got = one(spark, rows, "t string", text.json_block(F.col("t")))
    assert [g[0] for g in got] == ['{"a": {"b": 1}}', None, None, None, None]
