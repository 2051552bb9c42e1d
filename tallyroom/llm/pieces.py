"""SentencePiece encoding and decoding, with the N best segmentations of whole texts."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tallyroom.llm.ranks import free_names
from tallyroom.llm.tables import bounded_batches, map_rows, whole_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Segmentations per text.
BEST = 4
SPACE = "▁"
#: A character without a piece is spelled in bytes, at this much below the worst piece.
BYTES_BELOW = 10.0
#: Longer units are segmented one by one; texts are worked on in groups of so many characters,
#: their distinct units in groups of so many characters, filled up to the longest.
UNIT, GROUP, TOGETHER = 32, 3 << 20, 1 << 18
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_UNITS = re.compile(f"{SPACE}+[^{SPACE}]*")


class Pieces:
    """The pieces of a model: scores, the lattice's edges, and the way back to text."""

    def __init__(self, model: bytes):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        #: What each id stands for; bytes from 128 on as Python escapes them in text.
        self.texts: list[str] = []
        self.known: dict[str, tuple[float, int]] = {}
        self.byte_ids = [0] * 256
        for i in range(processor.get_piece_size()):
            text = processor.id_to_piece(i)
            hidden = processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i)
            if processor.is_byte(i):
                value = int(text[1:-1], 16)
                self.byte_ids[value] = i
                self.texts.append(bytes([value]).decode("utf-8", "surrogateescape"))
            else:
                self.texts.append(text.replace(SPACE, " "))
                if not hidden:
                    self.known[text] = (processor.get_score(i), i)
        self.longest = max(map(len, self.known))
        self.bytes_score = min(s for s, _ in self.known.values()) - BYTES_BELOW
        #: Texts fall apart before runs of spaces if no piece reaches over such a place.
        self.parts = not any(SPACE in t.lstrip(SPACE) for t in self.known)
        #: Hashes of all pieces and their beginnings, with score (or none) and id.
        self.begun = {t[:k] for t in self.known for k in range(1, len(t) + 1)}
        rows = sorted((self._key(t), *self.known.get(t, (-np.inf, -1))) for t in self.begun)
        self.keys = np.array([r[0] for r in rows], dtype=_U)
        self.scores = np.array([r[1] for r in rows])
        self.ids = np.array([r[2] for r in rows], dtype=np.int32)
        #: Table of places by the top bits of a hash, to start a search near its end.
        self.jump = np.searchsorted(self.keys, np.arange(1 << 18, dtype=_U) << _U(46))
        self.jump = np.append(self.jump, len(self.keys)).astype(np.int64)
        self.run = int(np.diff(self.jump).max())

    @staticmethod
    def _key(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_BASE) + ord(c) + 1) % 2**64
        return h * int(_BASE) % 2**64

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each running hash among ``keys``, -1 where it is none."""
        h = h * _BASE
        at = np.minimum(self.jump[(h >> _U(46)).astype(np.int64)], len(self.keys) - 1)
        key = self.keys[at]
        out = np.where(key == h, at, -1)
        todo = np.flatnonzero(key < h)
        for _ in range(self.run):
            if not len(todo):
                break
            here = np.minimum(at[todo] + 1, len(self.keys) - 1)
            at[todo] = here
            key = self.keys[here]
            hit = key == h[todo]
            out[todo[hit]] = here[hit]
            todo = todo[(key < h[todo]) & (here < len(self.keys) - 1)]
        return out


_LOADED: dict[int, Pieces] = {}


def load(model: bytes) -> Pieces:
    key = hash(model)
    if key not in _LOADED:
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def units(pieces: Pieces, text: str) -> list[str]:
    """The text with a space before it, cut before runs of spaces; of each unit, what
    follows its first space, further ones as SPACE. A SPACE of the text itself stands as
    ``_SELF``."""
    if SPACE in text:
        text = text.replace(SPACE, _SELF)
    if not pieces.parts:
        return [text.replace(" ", SPACE)]
    if "  " in text or text[:1] == " ":
        return [u[1:] for u in _UNITS.findall(SPACE + text.replace(" ", SPACE))]
    return text.split(" ")


class _Numbers(dict):
    """Numbers keys in the order they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


#: Stands for a SPACE that is part of the text; a code point no text can hold.
_SELF = "\udfff"


def edges(pieces: Pieces, unit: str) -> list[list[tuple[int, float, int]]]:
    """Per end, the (start, score, id) of the pieces that end there; id -1 for bytes."""
    into: list[list] = [[] for _ in range(len(unit) + 1)]
    for a in range(len(unit)):
        for b in range(a + 1, min(len(unit), a + pieces.longest) + 1):
            part = unit[a:b]
            if part not in pieces.begun:
                break
            hit = pieces.known.get(part)
            if hit:
                into[b].append((a, *hit))
        if unit[a] not in pieces.known:
            into[a + 1].append((a, pieces.bytes_score, -1))
    return into


def forward(into: list) -> list[float]:
    best = [0.0]
    for b in range(1, len(into)):
        best.append(max(best[a] + s for a, s, _ in into[b]))
    return best


def search(into: list, best: list[float], count: int) -> Iterator[tuple[float, list[tuple[int, int]]]]:
    """(score, [(end, id)]) of the ``count`` best paths, by A-star from the end: what is
    still to come is known exactly from the forward scores, so only parts of the paths
    returned are ever taken from the heap first. Equal scores come longer pieces last
    first, then smaller ids."""
    heap = [(-best[-1], (), len(into) - 1, 0.0)]
    while heap and count:
        _, path, at, done = heapq.heappop(heap)
        if at == 0:
            count -= 1
            yield done, [(e, i) for e, i in reversed(_unlinked(path))]
            continue
        for a, s, i in into[at]:
            heapq.heappush(heap, (-(best[a] + s + done), (a - at, i, at, path), a, done + s))


def _unlinked(path: tuple) -> list[tuple[int, int]]:
    out = []
    while path:
        _, i, end, path = path
        out.append((end, i))
    return out[::-1]


class Segmented:
    """The best segmentation of each of some units: ids (bytes as -1 - code point) of unit u
    between offsets u and u + 1, its score, and what its second best loses."""

    def __init__(self, pieces: Pieces, texts: list[str]):
        self.scores, self.losses = np.zeros(len(texts)), np.full(len(texts), np.inf)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        short = np.flatnonzero(sizes <= UNIT)
        order = short[np.argsort(-sizes[short], kind="stable")]
        counts = np.zeros(len(texts), dtype=np.int64)
        long = {int(i): self._alone(pieces, texts[i], i) for i in np.flatnonzero(sizes > UNIT)}
        for i, ids in long.items():
            counts[i] = len(ids)
        flat, first = [np.empty(0, np.int64)], 0
        while first < len(order):
            some = order[first : first + max(1, TOGETHER // max(1, int(sizes[order[first]])))]
            own, counts[some] = self._together(pieces, [texts[i] for i in some], sizes[some], some)
            flat.append(own)
            first += len(some)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        ids = np.empty(offsets[-1], dtype=np.int64)
        ids[ranges(offsets[order], counts[order])] = np.concatenate(flat)
        for i, own in long.items():
            ids[offsets[i] : offsets[i + 1]] = own
        self.ids, width = spelled(pieces, ids)
        self.offsets = np.concatenate([[0], np.cumsum(width)])[offsets]

    def _alone(self, pieces: Pieces, text: str, i: int) -> np.ndarray:
        into = edges(pieces, text)
        best = forward(into)
        behind = [-np.inf] * len(into)
        behind[-1] = 0.0
        for b in range(len(into) - 1, 0, -1):
            for a, s, _ in into[b]:
                behind[a] = max(behind[a], s + behind[b])
        at, ids, on = len(text), [], set()
        while at:
            # As in ``_together``: of equal ways the earliest start.
            a, s, k = min(into[at], key=lambda e: (-(best[e[0]] + e[1]), e[0]))
            ids.append(k if k >= 0 else -1 - ord(text[a]))
            on.add((a, at))
            at = a
        off = [best[a] + s + behind[b] for b in range(1, len(into)) for a, s, _ in into[b] if (a, b) not in on]
        self.scores[i], self.losses[i] = best[-1], best[-1] - max(off, default=-np.inf)
        return np.array(ids[::-1], dtype=np.int64)

    def _together(self, pieces: Pieces, texts: list[str], sizes: np.ndarray, order: np.ndarray):
        """All short units, longest first, place by place: of those that reach a place, the
        first so many rows."""
        n, width = len(texts), int(sizes[0])
        joined = "".join(t.ljust(width, "\0") for t in texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, width).astype(_U)
        reach = np.searchsorted(-sizes, -np.arange(width + 2), "right")
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        came = np.zeros((n, width + 1), dtype=np.int8)
        label = np.zeros((n, width + 1), dtype=np.int64)
        steps = []
        with np.errstate(over="ignore", invalid="ignore"):
            for a in range(width):
                rows = np.arange(reach[a + 1])
                h = np.zeros(len(rows), dtype=_U)
                for b in range(a + 1, min(width, a + pieces.longest) + 1):
                    live = rows < reach[b]
                    rows, h = rows[live], h[live]
                    h = h * _BASE + points[rows, b - 1] + _U(1)
                    at = pieces.find(h)
                    score = np.where(at >= 0, pieces.scores[at], -np.inf)
                    number = pieces.ids[at].astype(np.int64)
                    if b == a + 1:
                        bare = np.isneginf(score)
                        score = np.where(bare, pieces.bytes_score, score)
                        number = np.where(bare, -1 - points[rows, a].astype(np.int64), number)
                    way = best[rows, a] + score
                    better = way > best[rows, b]
                    r = rows[better]
                    best[r, b], came[r, b], label[r, b] = way[better], b - a, number[better]
                    some = score > -np.inf
                    steps.append((a, b, rows[some], score[some]))
                    on = at >= 0
                    rows, h = rows[on], h[on]
                    if not len(rows):
                        break
        behind = np.full((n, width + 1), -np.inf)
        behind[np.arange(n), sizes] = 0
        for a, b, rows, score in reversed(steps):
            behind[rows, a] = np.maximum(behind[rows, a], score + behind[rows, b])
        ends = np.zeros((n, width + 1), dtype=bool)
        at, rows = sizes.copy(), np.arange(n)
        while len(rows):
            ends[rows, at[rows]] = True
            at[rows] -= came[rows, at[rows]]
            rows = rows[at[rows] > 0]
        total = best[np.arange(n), sizes]
        other = np.full(n, -np.inf)
        for a, b, rows, score in steps:
            off = ~(ends[rows, b] & (came[rows, b] == b - a))
            r = rows[off]
            other[r] = np.maximum(other[r], best[r, a] + score[off] + behind[r, b])
        self.scores[order], self.losses[order] = total, total - other
        return label[ends], ends.sum(1)


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first .. first + count - 1 of each, one after the other."""
    before = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else count
    return np.repeat(first - before, count) + np.arange(count.sum())


def spelled(pieces: Pieces, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids with code points that have no piece spelled in bytes, and how many each became."""
    width = np.ones(len(ids), dtype=np.int64)
    bare = np.flatnonzero(ids < 0)
    points, which = np.unique(ids[bare], return_inverse=True)
    chars = [SPACE if chr(-1 - p) == _SELF else chr(-1 - p) for p in points.tolist()]
    bytes_of = [[pieces.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")] for c in chars]
    size = np.array([len(b) for b in bytes_of], dtype=np.int64)
    width[bare] = size[which] if len(bare) else 1
    out, start = np.repeat(ids, width), np.cumsum(width) - width
    for k in range(int(size.max(initial=0))):
        there = bare[size[which] > k]
        table = np.array([b[k] if len(b) > k else 0 for b in bytes_of], dtype=np.int64)
        out[start[there] + k] = table[which[size[which] > k]]
    return out, width


def decode(pieces: Pieces, ids) -> str:
    """The text of a segmentation: pieces joined, runs of byte pieces read as UTF-8, SPACE
    in pieces as a space, and the space before the text taken off."""
    of = pieces.texts
    text = "".join([of[i] for i in ids])[1:]
    return text if text.isascii() else text.encode("utf-8", "surrogateescape").decode("utf-8")


def encode_all(pieces: Pieces, texts: list[str], count: int) -> Iterator[tuple[np.ndarray, float, list]]:
    """Per text: ids of the best segmentation, its score, and the ``count`` best as (score,
    [(place, unit, ids)]): the units segmented otherwise than in the best.

    Units do not touch, so the best segmentation is the best of each. One that differs in
    a unit loses at least that unit's second-best loss; so beyond the ``count`` - 1 units
    of least loss none can differ, and the search runs over the lattice of these alone.
    """
    number = _Numbers()
    places = [np.array([number[u] for u in units(pieces, t)], dtype=np.int64) for t in texts]
    names = [SPACE + u for u in number]
    done = Segmented(pieces, names)
    sizes = np.diff(done.offsets)
    known: dict[int, list] = {}
    for at in places:
        ids = done.ids[ranges(done.offsets[at], sizes[at])]
        score = float(done.scores[at].sum())
        yield ids, score, _others(pieces, names, done, at, score, count, known)


def _others(
    pieces: Pieces, names: list[str], done: Segmented, at: np.ndarray, score: float, count: int, known: dict
) -> list:
    """The ``count`` best of a text with units ``at``; ``known`` keeps the edges of units."""
    lost = done.losses[at]
    least = np.argpartition(lost, count - 2)[: count - 1] if 1 < count <= len(lost) else np.arange(len(lost))
    least = sorted(least[np.isfinite(lost[least])].tolist())
    if count < 2 or not least:
        return [(score, [])][:count]
    into: list[list] = [[]]
    starts = []
    for i in least:
        base = len(into) - 1
        starts.append(base)
        own = known.get(at[i])
        if own is None:
            own = known[at[i]] = edges(pieces, names[at[i]])
        into += [[(base + a, s, k) for a, s, k in e] for e in own[1:]]
    best = forward(into)
    out = []
    for total, path in search(into, best, count):
        changed = []
        for i, base, stop in zip(least, starts, [*starts[1:], len(into) - 1]):
            unit, last, ids = names[at[i]], base, []
            for end, k in path:
                if base < end <= stop:
                    ids.append(k if k >= 0 else -1 - ord(unit[last - base]))
                    last = end
            if min(ids) < 0:
                ids = spelled(pieces, np.array(ids, dtype=np.int64))[0].tolist()
            if ids != done.ids[done.offsets[at[i]] : done.offsets[at[i] + 1]].tolist():
                changed.append((i, names[at[i]], ids))
        out.append((score - best[-1] + total, changed))
    return out


def text_groups(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a column in groups of about GROUP characters."""
    held, size = [], 0
    for text in column:
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= GROUP:
            yield held
            held, size = [], 0
    if held:
        yield held


ENCODED = "ids array<int>, score double, others array<struct<score: double, changes: array<struct<unit: int, ids: array<int>>>>>"


def encoded(docs: DataFrame, count: int = BEST, model: str = MODEL) -> DataFrame:
    """The documents with ``ids``, ``score`` and ``others`` (columns of these names are
    replaced; all else is kept).

    ``ids`` is the segmentation of the whole text of greatest total piece score, ``others``
    the ``count`` best, that one first, by falling score: each with the units, numbered
    through the text, that it segments otherwise, and their ids. Units are runs of spaces
    with what follows. Forward Viterbi scores are found for all distinct units of a group
    of texts at once; they are the exact heuristic of a backward A-star search over the
    lattice of the units that can differ. Characters without a piece are spelled in byte
    pieces, so every text is got back by ``decode``, a literal U+2581 included.

    A null or empty text is the space before it alone. Texts with fewer segmentations than
    ``count`` have them all. Repeated rows are rows of their own; no rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    with open(model, "rb") as file:
        proto = docs.sparkSession.sparkContext.broadcast(file.read())
    names = [c for c in docs.columns if c not in ("ids", "score", "others")]
    read = free_names(docs, "read")["read"]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], whole_text(F.col("text")).alias(read))
    extra = T.StructType.fromDDL(ENCODED) if hasattr(T.StructType, "fromDDL") else None
    schema = T.StructType([*rows.schema.fields[:-1], *extra.fields])
    changes = pa.list_(pa.struct([("unit", pa.int32()), ("ids", pa.list_(pa.int32()))]))
    others_type = pa.list_(pa.struct([("score", pa.float64()), ("changes", changes)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(proto.value)
        for batch in batches:
            first = 0
            for texts in text_groups(batch[read]):
                ids, scores, others = [], [], []
                for own, score, best in encode_all(pieces, texts, count):
                    ids.append(own.astype(np.int32))
                    scores.append(score)
                    others.append([
                        {"score": s, "changes": [{"unit": u, "ids": i} for u, _, i in c]} for s, c in best
                    ])
                part = batch.slice(first, len(texts))
                first += len(texts)
                ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], flat, pa.array(scores, pa.float64()), pa.array(others, others_type)],
                    names=[*part.schema.names[:-1], "ids", "score", "others"],
                )

    return map_rows(rows, run, schema)


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """``rows`` (doc_id, ids) with ``text`` got back from the ids; null ids give null."""
    bounded_batches(rows.sparkSession)
    with open(model, "rb") as file:
        proto = rows.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(proto.value)
        for batch in batches:
            texts = [None if i.as_py() is None else decode(pieces, i.as_py()) for i in batch["ids"]]
            yield batch.append_column("text", pa.array(texts, pa.string()))

    rows = rows.select("doc_id", "ids")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("text", T.StringType())]))


def digest(docs: DataFrame, count: int = BEST, model: str = MODEL) -> DataFrame:
    """What ``encoded`` gives, in short: doc_id, n_pieces, ids_sha256 (of the ids as 32-bit
    little-endian numbers), score, scores (of the ``count`` best) and whether decoding
    the ids gives back the text."""
    bounded_batches(docs.sparkSession)
    rows = encoded(docs.select("doc_id", "text"), count, model)
    with open(model, "rb") as file:
        proto = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(proto.value)
        for batch in batches:
            ends = np.asarray(batch["ids"].offsets)
            flat = batch["ids"].values.to_numpy()
            hashes, same = [], []
            for a, b, text in zip(ends[:-1], ends[1:], batch["text"]):
                hashes.append(hashlib.sha256(flat[a:b].astype("<i4").tobytes()).hexdigest())
                same.append(decode(pieces, flat[a:b].tolist()) == (text.as_py() or ""))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(np.diff(ends).astype(np.int64)), pa.array(hashes, pa.string()),
                 batch["score"], batch["scores"], pa.array(same)],
                names=["doc_id", "n_pieces", "ids_sha256", "score", "scores", "decoded"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = rows.select("doc_id", "text", "ids", "score", F.col("others.score").alias("scores"))
    return rows.mapInArrow(
        run, f"doc_id {kind}, n_pieces long, ids_sha256 string, score double, scores array<double>, decoded boolean"
    )
