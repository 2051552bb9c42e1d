"""Pieces of SQL that several queries of this subpackage are checked by."""

from __future__ import annotations

#: CRC-32 of UTF-8 bytes, byte by byte.
CRC_STEPS = """
    byte_step AS (
        SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, x:
            CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS step
        FROM range(256) AS r(i)
    )
"""


def crc(text: str) -> str:
    """SQL for the unsigned CRC-32 of ``text``, with ``step`` of byte_step at hand."""
    return f"""xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'),
            lambda p: ('0x' || p)::BIGINT)),
        lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])))"""
