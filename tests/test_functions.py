from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyroom import functions as fn


def value(spark, build, dtype="string", *inputs):
    """The expression over each input, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {dtype}")
    return [r["out"] for r in df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


def test_rounding_of_ties_and_signs(spark):
    halves = (2.5, -2.5, 0.125, None)
    assert value(spark, fn.js_round, "double", *halves) == [3.0, -2.0, 0.0, None]
    fixed = value(spark, lambda v: fn.to_fixed(v, 1), "double", 12.25, -12.25, -0.01, 1.0)
    assert fixed == [12.3, -12.3, 0.0, 1.0]
    assert str(fixed[2]) == "0.0"
    assert value(spark, lambda v: fn.to_fixed(v, 2), "double", 1.005) == [1.0]


def test_ratios_without_a_divisor(spark):
    assert value(spark, lambda v: fn.ratio(F.lit(3), v), "int", 2, 0, None) == [1.5, 0.0, 0.0]
    assert value(spark, lambda v: fn.percent(F.lit(1), v, 1, empty=100.0), "int", 3, 0) == [33.3, 100.0]
    assert value(spark, lambda v: fn.conversion_rate(F.lit(1), v), "int", 8, 0) == [13, 0]
    assert value(spark, lambda v: fn.hybrid_metric(v, F.lit(9)), "int", 4, 0, None) == [4, 9, 9]


def test_duration_text(spark):
    out = value(spark, fn.duration_text, "double", 0.0, 59.4, 125.0, -3.0)
    assert out == ["0s", "0m 59s", "2m 5s", "0s"]


def test_properties(spark):
    bags = ('{"k":true}', '{"k":null}', "{}", "not json", '{"k":"1.50"}', None)
    assert value(spark, lambda v: fn.prop("k", "v"), "string", *bags) == ["true", None, None, None, "1.50", None]
    with pytest.raises(ValueError):
        fn.prop("a'b")


def test_dotted_and_spaced_keys(spark):
    assert value(spark, lambda v: fn.prop("a.b c", "v"), "string", '{"a.b c":7,"a":{"b c":8}}') == ["7"]


def test_casts_give_null_for_bad_text(spark):
    assert value(spark, fn.as_bool, "string", "true", "off", "On", "maybe", None) == [True, False, True, None, None]
    assert value(spark, fn.as_int, "string", "7", "x", None) == [7, None, None]
    assert value(spark, fn.as_double, "string", "1e3", "x") == [1000.0, None]
    assert [str(v) for v in value(spark, fn.as_money, "string", "3.1", "x")] == ["3.10", "None"]


def test_locales(spark):
    codes = ("en_US", "de", "", None)
    assert value(spark, fn.locale_country, "string", *codes) == ["US", "de", "", "Unknown"]
    assert value(spark, fn.locale_language, "string", *codes) == ["en", "de", "", "unknown"]


def test_phones(spark):
    raw = ("(212) 867-5309", "1 212 867 5309", "+44 20 7946 0958", "abc", None)
    assert value(spark, fn.normalize_phone, "string", *raw) == [
        "+12128675309", "+12128675309", "+442079460958", "+1", None]
    assert value(spark, fn.mask_phone, "string", "+12128675309", "+1", "12128675309") == [
        "+1 (***) ***-5309", "+1", "12128675309"]


def test_addresses(spark):
    df = spark.createDataFrame(
        [(0, " ::ffff:1.2.3.4 , 9.9.9.9", "5.5.5.5", "6.6.6.6"), (1, "", "5.5.5.5", "6.6.6.6"),
         (2, None, None, "::1"), (3, None, "", "2001:db8::1"), (4, None, None, None)],
        "i int, xff string, real string, remote string")
    out = df.select("i", fn.client_ip(F.col("xff"), F.col("real"), F.col("remote")).alias("ip"))
    assert [r["ip"] for r in out.orderBy("i").collect()] == [
        "1.2.3.4", "5.5.5.5", "127.0.0.1", "2001:db8::1", None]
    texts = ("255.255.255.255", "1.2.3.4", "256.1.1.1", "1.2.3", "2001:db8::1", "1.2.3.4.5", None)
    assert value(spark, fn.ipv4_number, "string", *texts) == [
        4294967295, 16909060, None, None, None, None, None]


def test_defaults_replace_empty_values(spark):
    assert value(spark, lambda v: fn.or_default(v, "x"), "string", "", None, "y") == ["x", "x", "y"]
    assert value(spark, lambda v: fn.or_default(v, 0), "int", 0, None, 5) == [0, 0, 5]
