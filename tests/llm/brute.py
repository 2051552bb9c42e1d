"""Plain answers to compare the operators with, one row at a time."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def remainder(doc_id, modulus: int) -> int:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % modulus


def shingles(text) -> frozenset:
    found = words(text)
    if len(found) < 5:
        return frozenset([tuple(found)]) if found else frozenset()
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4))


class Groups:
    """Union of members by links; the smallest member names a group."""

    def __init__(self, members):
        self.parent = {m: m for m in members}

    def find(self, m):
        while self.parent[m] != m:
            self.parent[m] = self.parent[self.parent[m]]
            m = self.parent[m]
        return m

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def base_scores(rows) -> dict:
    """doc_id to (n_tokens, n_known, N, base score) of rows (doc_id, text)."""
    tokens = [(i, [*words(t), None]) for i, t in rows]
    counts = Counter(w for i, ws in tokens if i is None or remainder(i, 7) != 2 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    return {
        i: (len(ws), sum(counts[w] > 0 for w in ws), total,
            sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws))
        for i, ws in tokens
    }


def targets(sizes: dict, repeat=3, weights=(5, 2, 1)) -> dict:
    """Targets of sources by resharing the excess until none is above its stop."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_sources, out = float(sum(sizes.values())), set(order), {}
    while open_sources:
        total = sum(weight[s] for s in open_sources)
        over = {s for s in open_sources if left * weight[s] / total > repeat * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_sources}
        for s in over:
            out[s] = float(repeat * sizes[s])
        left -= sum(out[s] for s in over)
        open_sources -= over
    return out


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0


def personal(text) -> list[tuple[int, int, str, int]]:
    """(start, kind number, kind, end) of the four patterns."""
    def digits(m):
        return re.sub("[^0-9]", "", m.group())
    text = text or ""
    out = [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text)
            if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, "card", m.end()) for m in CARD.finditer(text)
            if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def written(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
