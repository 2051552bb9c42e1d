from tallyroom.functions.numbers import (
    conversion_rate,
    duration_text,
    hybrid_metric,
    js_round,
    percent,
    ratio,
    to_fixed,
)
from tallyroom.functions.properties import as_bool, as_double, as_int, as_money, prop
from tallyroom.functions.text import (
    address_key,
    client_ip,
    ipv4_number,
    locale_country,
    locale_language,
    mask_phone,
    normalize_phone,
    or_default,
)

__all__ = [
    "address_key", "as_bool", "as_double", "as_int", "as_money", "client_ip", "conversion_rate",
    "duration_text", "hybrid_metric", "ipv4_number", "js_round", "locale_country",
    "locale_language", "mask_phone", "normalize_phone", "or_default", "percent",
    "prop", "ratio", "to_fixed",
]
