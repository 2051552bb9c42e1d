"""Addresses in ranges, by order and by blocks, against plain answers."""

from __future__ import annotations

import ipaddress
import random

import pytest
from build import dicts
from pyspark.sql import functions as F

from tallyroom.functions import address_key
from tallyroom.plans.asof import in_ranges
from tallyroom.sources import batches


def disjoint(draw, n, most):
    cuts = sorted(draw.sample(range(most), 2 * n))
    return [(a, b, f"c{i}") for i, (a, b) in enumerate(zip(cuts[::2], cuts[1::2]))]


@pytest.mark.parametrize("n, most", [(0, 100), (1, 100), (40, 400), (300, 10**9)])
def test_in_ranges(spark, n, most):
    draw = random.Random(n)
    ranges = disjoint(draw, n, most)
    keys = [draw.randrange(most) for _ in range(500)] + [x for a, b, _ in ranges[:50] for x in (a, b, b + 1)]
    got = in_ranges(
        spark.createDataFrame([(k,) for k in keys + [None]], "k long"),
        spark.createDataFrame(ranges, "lo long, hi long, v string"), "k", "v")
    wanted = {k: v for k in keys for a, b, v in ranges if a <= k <= b}
    assert sorted((r["k"], r["v"]) for r in dicts(got)) == sorted(wanted.items())


def test_a_range_costs_few_rows_however_wide(spark):
    ranges = spark.createDataFrame(
        [(0, 2**31 - 1, "half"), (2**31, 2**31 + 2**24 - 1, "eight"), (3 * 2**30, 3 * 2**30 + 5, "few"),
         (2**32 - 2**25, 2**32 - 1, "end")], "lo long, hi long, country string")
    rows = {r["country"]: r["n"] for r in dicts(batches._listed(ranges).groupBy("country").agg(F.count("*").alias("n")))}
    assert rows == {"half": 1, "eight": 1, "few": 1, "end": 1}


@pytest.mark.parametrize("small", [True, False])
def test_ranges_of_all_widths(spark, small):
    draw = random.Random(8)
    ranges = disjoint(draw, 60, 2**32) + [(2**32 - 4, 2**32 - 1, "last")]
    ranges = [r for i, r in enumerate(ranges) if i == 0 or r[0] > ranges[i - 1][1]]
    ips = [str(ipaddress.ip_address(x)) for a, b, _ in ranges for x in (a, b, (a + b) // 2, max(a - 1, 0))]
    ips += ["1.2.3.4"] * 50 + [None, "127.0.0.1", "no", "1.2.3", "::1", "256.1.1.1"]
    events = spark.createDataFrame(list(enumerate(ips)), "id long, ip_address string").withColumn("country", F.lit("old"))
    table = spark.createDataFrame(ranges, "lo long, hi long, country string")
    got = {r["id"]: r["country"] for r in dicts(batches.ip_to_country(events, table, small=small))}

    def plain(ip):
        try:
            x = int(ipaddress.IPv4Address(ip)) if ip != "127.0.0.1" else -1
        except ipaddress.AddressValueError:
            x = -1
        return next((c for a, b, c in ranges if a <= x <= b), None)
    assert got == {i: plain(ip) for i, ip in enumerate(ips)}


def hex_key(ip):
    ip = ipaddress.ip_address(ip)
    return f"{0xFFFF << 32 | int(ip):032x}" if ip.version == 4 else f"{int(ip):032x}"


def test_address_keys(spark):
    good = ["1.2.3.4", "255.255.255.255", "::", "::1", "1::", "2001:db8::8a2e:370:7334", "fe80::1:0:0:5",
            "1:2:3:4:5:6:7:8", "ABCD:ef::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8"]
    bad = ["", "1", ":1", "1:", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", "12345::", ":::", "g::", "1:2:3:4:5:6:7::8", None,
           "1.2.3.4:80", ":1:2:3:4:5:6:7:8"]
    df = spark.createDataFrame([(x,) for x in good + bad], "ip string").select("ip", address_key(F.col("ip")).alias("k"))
    assert {r["ip"]: r["k"] for r in dicts(df)} == {**{g: hex_key(g) for g in good}, **dict.fromkeys(bad)}


def test_ranges_of_both_kinds_of_address(spark):
    ranges = [("10.0.0.0", "10.255.255.255", "AA"), ("2001:db8::", "2001:db8:ffff:ffff:ffff:ffff:ffff:ffff", "BB")]
    table = spark.createDataFrame([(hex_key(a), hex_key(b), c) for a, b, c in ranges], "lo string, hi string, country string")
    ips = ["10.1.2.3", "11.0.0.0", "2001:db8::7", "2001:db9::", "::ffff:a00:1", "x", None]
    events = spark.createDataFrame(list(enumerate(ips)), "id long, ip_address string")
    got = {r["id"]: r["country"] for r in dicts(batches.ip_to_country(events, table))}
    assert got == dict(enumerate(["AA", None, "BB", None, "AA", None, None]))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_an_address_is_parsed_once_however_many_rows_have_it(spark, kind):
    lo, hi = ("10.0.0.0", "10.0.255.255")
    edges = [hex_key(a) if kind == "string" else int(ipaddress.ip_address(a)) for a in (lo, hi)]
    table = spark.createDataFrame([(*edges, "AA")], f"lo {kind}, hi {kind}, country string")
    ips = ["10.0.0.1"] * 40 + ["127.0.0.1", None, "x", "11.0.0.1"] * 5
    events = spark.createDataFrame(list(enumerate(ips)), "id long, ip_address string")
    got = batches.ip_to_country(events, table, small=False)
    assert {r["id"]: r["country"] for r in dicts(got)} == {i: "AA" if ip == "10.0.0.1" else None for i, ip in enumerate(ips)}
    # What parses an address reads the stored distinct ones and not the events.
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    parsed = [line for line in plan.splitlines() if "rlike" in line]
    assert parsed and not [line for line in parsed if "ip_address#" in line]
