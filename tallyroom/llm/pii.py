"""Personal data in whole texts: patterns, and spans added by a character tagger."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tallyroom.llm import tagger
from tallyroom.llm.tables import bounded_batches, map_rows, whole_text
from tallyroom.llm.tagger import KINDS

# The patterns of the four kinds.
EMAIL = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: What an added span must look like beyond the patterns: the tagger finds, these confirm.
_AT, _DOT = r"(?:@|\s?[\[({]\s?(?:at|AT|@)\s?[\])}]\s?)", r"(?:\.|\s?[\[({]\s?(?:dot|DOT|\.)\s?[\])}]\s?)"
CONFIRM = {
    "email": re.compile(rf"[A-Za-z0-9][A-Za-z0-9._%+-]*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+"),
    "ip": re.compile(rf"[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}"),
    "card": re.compile(r"[0-9]{4}(?:[ ./_-]{1,3}[0-9]{2,6}){2,4}"),
    "phone": re.compile(r"(?:00[0-9]{1,3}[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"),
}
#: Every span holds one of these; nothing is looked for elsewhere.
TRIGGER = re.compile(r"[0-9@\[({]")
#: Characters of a window, what neighbouring windows share, and what is read around a trigger.
WINDOW, OVERLAP, AROUND = 96, 48, 40
#: Windows decoded at once.
DECODED = 1024
#: Documents whose windows are drawn from, windows learned from, training steps and batch.
SAMPLE_DOCS, SAMPLE_WINDOWS, STEPS, BATCH = 20_000, 1024, 220, 64


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the whole pattern, found from their @: the leftmost start is that of the
    run of local characters before it, and if the rest does not match, no start of the run
    does."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = EMAIL.match(text, at) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        at = max(at + 1, done)


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start, then kind."""
    found = [Span(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                found.append(Span(m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = _digits(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(Span(m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(_digits(m.group())) <= 15:
                    found.append(Span(m.start(), 3, m.end()))
    return sorted(found)


def confirmed(kind: int, text: str) -> bool:
    if not CONFIRM[KINDS[kind]].fullmatch(text):
        return False
    if kind == 1:
        return all(int(p) <= 255 for p in re.findall(r"[0-9]+", text))
    return kind != 2 or 12 <= len(_digits(text)) <= 19 and luhn(_digits(text))


def window_starts(text: str) -> list[int]:
    """Starts of overlapping windows over all that is near a trigger."""
    starts, end = [], -1
    for m in TRIGGER.finditer(text):
        low, high = max(0, m.start() - AROUND), min(len(text), m.start() + AROUND)
        if low >= end:
            starts.append(low)
            end = low + WINDOW
        while end < high:
            starts.append(end - OVERLAP)
            end += WINDOW - OVERLAP
    return starts


def spans_of(tags: np.ndarray, lead: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """(start, kind, end, confidence) of the runs of a window's tags."""
    opens = np.flatnonzero(tags % 2 == 1)
    for a in opens:
        b = a + 1
        while b < len(tags) and tags[b] == tags[a] + 1:
            b += 1
        yield int(a), int(tags[a]) // 2, int(b), float(lead[a:b].mean())


def reconciled(proposals: list[tuple[int, int, int, float]]) -> list[Span]:
    """Of overlapping proposals of all windows of a text, the disjoint set of greatest total
    confidence, weighed by length; repeated ones count once with their best."""
    best: dict[tuple[int, int, int], float] = {}
    for a, k, b, w in proposals:
        best[a, k, b] = max(w, best.get((a, k, b), 0.0))
    order = sorted(best, key=lambda s: (s[2], s))
    ends = [s[2] for s in order]
    total = [0.0]
    chosen: list[int | None] = []
    for i, s in enumerate(order):
        before = int(np.searchsorted(ends[:i], s[0], "right"))
        gain = total[before] + best[s] * (s[2] - s[0])
        chosen.append(before if gain > total[-1] else None)
        total.append(max(gain, total[-1]))
    out, i = [], len(order)
    while i:
        if chosen[i - 1] is None:
            i -= 1
        else:
            out.append(Span(*order[i - 1]))
            i = chosen[i - 1]
    return sorted(out)


def all_spans(model: tagger.Tagger, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Per text, the base spans and all spans: the base ones and those of the tagger that
    are confirmed and touch none of them."""
    base = [base_spans(t) for t in texts]
    proposals: list[list] = [[] for _ in texts]
    pending: list[tuple[int, int]] = []

    def run():
        codes = np.stack([tagger.codes(texts[i][s : s + WINDOW], WINDOW) for i, s in pending])
        for (i, s), tags, lead in zip(pending, *tagger.decode(model, codes)):
            for a, k, b, w in spans_of(tags, lead):
                if confirmed(k, texts[i][s + a : s + b]):
                    proposals[i].append((s + a, k, s + b, w + 1e-6))
        pending.clear()

    for i, text in enumerate(texts):
        for start in window_starts(text):
            pending.append((i, start))
            if len(pending) == DECODED:
                run()
    if pending:
        run()
    out = []
    for mine, new in zip(base, proposals):
        new = [p for p in new if all(p[2] <= s.start or p[0] >= s.end for s in mine)]
        out.append((mine, sorted(mine + reconciled(new)) if new else mine))
    return out


def _made_up(rng: np.random.Generator) -> tuple[int, str]:
    """A kind and a made-up span of it, in the spellings the tagger is to learn."""
    def pick(*options):
        return options[rng.integers(len(options))]

    def number(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def name(low: int, high: int) -> str:
        return "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(low, high)))

    kind = int(rng.integers(4))
    if kind == 0:
        at = pick("@", "@", "[at]", " [at] ", "(at)", " (at) ", " [AT] ", "{at}")
        dot = pick(".", ".", "[dot]", " [dot] ", "(dot)", " (dot) ") if at != "@" else "."
        local = name(3, 10) + pick("", "." + name(2, 6), "." + number(2), "_" + name(2, 5), number(2))
        return kind, f"{local}{at}{name(3, 9)}{pick('', number(1))}{dot}{pick('com', 'org', 'net', 'de', 'example' + dot + 'com')}"
    if kind == 1:
        dot = pick(".", ".", "[.]", "(.)", "[dot]", " [.] ")
        return kind, dot.join(str(n) for n in rng.integers(0, 256, 4))
    if kind == 2:
        digits = pick("4", "5") + number(14)
        last = next(str(d) for d in range(10) if luhn(digits + str(d)))
        gap = pick("", "", " ", "-", ".", "/", "_", " - ")
        return kind, gap.join((digits + last)[i : i + 4] for i in range(0, 16, 4))
    area, mid, end, gap = number(3), number(3), number(4), pick(" ", "-", ".")
    head = pick("+1 ", "+1-", "+44 ", "", "", "00" + number(2) + gap)
    return kind, head + pick(f"({area}) {mid}{gap}{end}", f"{area}{gap}{mid}{gap}{end}")


def training_rows(texts: list[str], seed: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Labelled windows: each sampled window with its base spans, and SAMPLE_WINDOWS times a
    window, in turn, with a made-up span set between its words."""
    rng = np.random.default_rng(seed)
    codes, tags = [], []

    def add(text: str, spans: list[Span]):
        row = np.zeros(WINDOW, dtype=np.int64)
        for s in spans:
            row[s.start : s.end] = 2 + 2 * s.kind
            row[s.start : s.start + 1] = 1 + 2 * s.kind
        codes.append(tagger.codes(text, WINDOW))
        tags.append(row)

    for text in texts:
        spans = base_spans(text)
        kept: list[Span] = []
        for s in spans:
            if not kept or s.start >= kept[-1].end:
                kept.append(s)
        add(text, kept)
    for n in range(SAMPLE_WINDOWS if texts else 0):
        text = texts[n % len(texts)]
        kind, span = _made_up(rng)
        gaps = [m.start() for m in re.finditer(r"\s", text) if m.start() + len(span) + 2 < WINDOW]
        at = gaps[rng.integers(len(gaps))] if gaps else 0
        mixed = f"{text[:at]} {span}{text[at:]}"
        clean = [s for s in base_spans(text[:at]) if s.end < at]
        if not clean:
            add(mixed, [Span(at + 1, kind, at + 1 + len(span))])
    return np.array(codes).reshape(-1, WINDOW), np.array(tags).reshape(-1, WINDOW)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows to learn from: about the first spans of a text, and one at its middle."""
    for batch in batches:
        out = []
        for text in batch["text"].to_pylist():
            about = [max(0, s.start - 30) for s in base_spans(text)[:2]]
            out += [text[a : a + WINDOW] for a in [*about, len(text) // 2] if text]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["text"])


def fit(docs: DataFrame) -> tagger.Tagger:
    """A tagger for ``docs``: SAMPLE_WINDOWS windows of up to about SAMPLE_DOCS hashed
    documents, the spans of the patterns as labels, and made-up spans in more spellings."""
    total = max(1, docs.count())
    text = docs.where(F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(total)) < SAMPLE_DOCS)
    text = text.select(whole_text(F.col("text")).alias("text")).mapInArrow(_windows, "text string")
    rare = F.when(F.col("text").rlike("[0-9@]"), 0).otherwise(1)
    half = text.withColumn("rare", rare).distinct()
    rows = half.where("rare = 0").orderBy(F.xxhash64("text"), "text").limit(SAMPLE_WINDOWS // 2).unionAll(
        half.where("rare = 1").orderBy(F.xxhash64("text"), "text").limit(SAMPLE_WINDOWS // 2)
    )
    return tagger.train(*training_rows(sorted(r["text"] for r in rows.collect())), STEPS, BATCH, seed=6)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and the digest are of the spans of the four patterns, matched over the
    whole text; ``spans`` adds those of a bidirectional LSTM with CRF transitions, which
    reads overlapping windows over everything near a digit, an @ or a bracket, without
    which no span can be. Spans that windows propose are reconciled over the whole text;
    those that touch a pattern's span, or that look like nothing of their kind, are left
    out. Offsets are code points, ends exclusive.

    A null or empty text has no spans; repeated rows and equal or null ids are rows of
    their own; no documents give no rows.
    """
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = all_spans(model.value, batch["text"].to_pylist())
            counts = [[sum(s.kind == k for s in base) for base, _ in found] for k in range(len(KINDS))]
            digest = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], *[pa.array(c, pa.int64()) for c in counts],
                    pa.array(digest, pa.string()), pa.array([written(s) for _, s in found], pa.string()),
                ],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    read = docs.select("doc_id", whole_text(F.col("text")).alias("text"))
    return read.mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    out, end = [], 0
    for s in spans:
        if s.start >= end:
            out += [text[end : s.start], f"<{KINDS[s.kind].upper()}>"]
        end = max(end, s.end)
    return "".join([*out, text[end:]])


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind, and ``n_chars``, if there, made
    to fit where a text has changed. Null texts stay null; all columns are kept."""
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    counted = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            found = all_spans(model.value, [t or "" for t in texts])
            new = [t if not s else masked(t, s) for t, (_, s) in zip(texts, found)]
            at = batch.schema.get_field_index("text")
            if counted:
                n = batch.schema.get_field_index("n_chars")
                sizes = [c if a == b else len(b) for c, a, b in zip(batch["n_chars"].to_pylist(), texts, new)]
                batch = batch.set_column(n, "n_chars", pa.array(sizes, batch.schema.field(n).type))
            yield batch.set_column(at, "text", pa.array(new, batch.schema.field(at).type))

    return map_rows(docs, run, T.StructType(docs.schema.fields))
