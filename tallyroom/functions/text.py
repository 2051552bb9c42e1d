"""Text expressions: defaults, locales, phone numbers, IP addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def or_default(value: Column, default) -> Column:
    """``default`` in place of null and of the empty value of the same type."""
    empty = "" if isinstance(default, str) else 0
    return F.coalesce(F.nullif(value, F.lit(empty)), F.lit(default))


def locale_country(locale: Column) -> Column:
    """Part after the first underscore, else the whole locale."""
    return F.coalesce(
        F.nullif(F.split_part(locale, F.lit("_"), F.lit(2)), F.lit("")), locale, F.lit("Unknown")
    )


def locale_language(locale: Column) -> Column:
    return F.coalesce(F.split_part(locale, F.lit("_"), F.lit(1)), F.lit("unknown"))


def normalize_phone(phone: Column) -> Column:
    """Digits and ``+`` only; ``+1`` in front of numbers without a country code."""
    kept = F.regexp_replace(phone, r"[^\d+]", "")
    return F.when(kept.startswith("+"), kept).otherwise(
        F.concat(F.lit("+1"), F.regexp_replace(kept, "^1", ""))
    )


def mask_phone(phone: Column) -> Column:
    """Country code and last four digits; text of another shape is unchanged.

    The pattern is tied to the start of the text, so only the first number in it
    is masked.
    """
    return F.regexp_replace(
        phone, r"^(.*?\+\d{1,3})(\d{3})(\d{3})(\d{4})", "$1 (***) ***-$4"
    )


def client_ip(forwarded: Column, real_ip: Column, remote_ip: Column) -> Column:
    """First forwarded address, else the proxy's, else the socket's, as plain IPv4
    where it is a mapped one."""
    first = F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))
    raw = F.coalesce(*[F.nullif(c, F.lit("")) for c in (first, real_ip, remote_ip)])
    return F.when(raw == "::1", F.lit("127.0.0.1")).otherwise(
        F.regexp_replace(raw, "^::ffff:", "")
    )


OCTET = r"(25[0-5]|2[0-4]\d|[01]?\d?\d)"


def ipv4_number(ip: Column) -> Column:
    """A dotted IPv4 address as a bigint; null for anything else.

    One pattern checks the whole address, and a fold over its parts keeps the
    generated code short enough for the JIT.
    """
    number = F.aggregate(
        F.split(ip, r"\."), F.lit(0).cast("bigint"), lambda acc, part: acc * 256 + part.try_cast("bigint")
    )
    return F.when(ip.rlike(rf"^({OCTET}\.){{3}}{OCTET}$"), number)


def _ipv6_key(ip: Column) -> Column:
    """The eight groups of an IPv6 address as 32 hex digits; null for anything else."""
    def parts(text: Column) -> Column:
        return F.filter(F.split(text, ":"), lambda g: g != "")
    gap = F.contains(ip, F.lit("::"))
    head, tail = (parts(F.split_part(ip, F.lit("::"), F.lit(i))) for i in (1, 2))
    missing = 8 - F.size(head) - F.size(tail)
    groups = F.when(gap, F.concat(head, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), tail)).otherwise(head)
    sound = (
        ip.rlike("^[0-9A-Fa-f:]+$") & ~ip.rlike(":::|::.*::|[0-9A-Fa-f]{5}|^:[^:]|[^:]:$")
        & F.when(gap, missing > 0).otherwise(F.size(head) == 8)
    )
    key = F.array_join(F.transform(groups, lambda g: F.lpad(F.lower(g), 4, "0")), "")
    return F.when(sound, key)


def address_key(ip: Column) -> Column:
    """An IPv4 or IPv6 address as 32 hex digits, which sort as addresses do; IPv4 ones as the
    IPv6 addresses they are mapped to. Null for anything else."""
    mapped = F.concat(F.lit("0" * 20 + "ffff"), F.lpad(F.lower(F.hex(ipv4_number(ip))), 8, "0"))
    return F.coalesce(mapped, _ipv6_key(ip))
