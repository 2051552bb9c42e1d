"""Scoring documents by a causal self-attention model and corpus word counts."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from tallyroom.llm import attention, tokens
from tallyroom.llm.attention import CONTEXT, SCORED, SIDE, SIZE, START, WINDOW, Model
from tallyroom.llm.pieces import ranges
from tallyroom.llm.tables import bounded_batches, held_out, keep_freed_memory, stored, whole_text
from tallyroom.llm.words import Texts, groups, mix, powers, word_hashes, words
from tallyroom.session import scratch_path

#: Rows learned from leave another remainder of crc32(doc_id) modulo 7.
FOLDS, HELD_OUT = 7, 2
#: Steps of the subword model at least (all windows are learned from in any case), windows a step.
STEPS, BATCH = 900, 128
#: Every so manyth learned document tunes the mixture instead of teaching the subword model.
TUNING = 16
#: Subwords that travel together; words for which one more task learns, tasks at most;
#: rounds after which tasks' models are averaged; pieces of a model while averaged.
STRETCH, TASK_WORDS, TASKS, ROUNDS, CHUNKS = 16 * SCORED, 1 << 20, 2048, 16, 8
#: What stands for no subword and for the start of a text before a stretch.
NONE_ID, START_ID = 65535, 65534
#: Words at least this often per so many are sent to all tasks: at most so many words.
FREQUENT = 1 << 20
#: The vocabulary id of the end of a text, a token like a word.
END = 50256
#: Words counted together before they are moved; bytes of subwords worked on together.
COUNTED, CODED_BYTES = 4_000_000, 1 << 19


class Scorer(NamedTuple):
    """The subword model with its map from vocabulary ids to its own, how rare ids share an
    id's probability, how many of its first classes hold the ids that begin a word or end the
    text (and no others), the share of the model in the mixture, and the counts of frequent words."""

    model: Model
    own: np.ndarray
    rare: np.ndarray
    opening: int
    part: float
    frequent: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int

    def base(self, c):
        return np.log10((c + 1.0) / (self.total + self.distinct + 1.0))

    def mixed(self, c, log_model):
        told = self.part * np.exp(log_model.astype(np.float64))
        share = np.asarray(c, dtype=np.float64) / max(1, self.total)
        usual = (1 - self.part) * share if self.total else 0.0
        with np.errstate(divide="ignore"):
            low = (log_model.astype(np.float64) + np.log(self.part)) / np.log(10)
            return np.where(usual > 0, np.log10(usual + told), low)


_LOWERED = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: White space but for spaces, around which the encoder may cut by what follows; bytes that are no text.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\udc80-\udcff]")
_NO_TEXT = re.compile("([\udc80-\udcff])")


@cache
def _opening(encoder) -> np.ndarray:
    """Which vocabulary ids of an encoder begin a word, that is with a space, or end a text."""
    out = np.zeros(END + 1, dtype=bool)
    for token in encoder.token_byte_values():
        out[encoder.encode_single_token(token)] = token.startswith(b" ")
    out[END] = True
    return out


def _one_coded(encoder, word: str) -> list[int]:
    """The ids of a word with a space before it; a byte that is no text is an id of its own."""
    out = []
    for part in _NO_TEXT.split(" " + word):
        if _NO_TEXT.match(part):
            out.append(encoder.encode_single_token(part.encode("utf-8", "surrogateescape")))
        elif len(part) < tokens.PIECE:
            out += encoder.encode_ordinary(part)
        else:
            out += tokens.encode(encoder, part).tolist()
    return out


def _coded_words(encoder, data: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words of ``data``, with a space before each, and their offsets. Plain words
    are encoded in one text: the encoder cuts before the space in any case."""
    at = np.arange(size.sum()) + np.repeat(np.arange(1, len(size) + 1), size)
    spaced = np.full(len(at) + len(size), 32, dtype=np.uint8)
    spaced[at] = np.frombuffer(data, np.uint8)[ranges(start, size)]
    text = spaced.tobytes().decode("utf-8", "surrogateescape")
    plain = np.ones(len(size), dtype=bool)
    if _ODD.search(text) or (size >= tokens.PIECE).any():
        each = text[1:].split(" ") if len(size) else []
        plain = np.array([len(x) < tokens.PIECE and not _ODD.search(x) for x in each])
        text = "".join([" " + x for x, p in zip(each, plain.tolist()) if p])
    ids = [np.array(encoder.encode_ordinary(text), dtype="<u2")]
    first, number = np.empty(len(size), dtype=np.int64), np.empty(len(size), dtype=np.int64)
    first[plain] = np.flatnonzero(_opening(encoder)[ids[0]])
    number[plain] = np.diff(np.append(first[plain], len(ids[0])))
    for i in np.flatnonzero(~plain).tolist():
        ids.append(np.array(_one_coded(encoder, each[i]), dtype="<u2"))
        number[i] = len(ids[-1])
    first[~plain] = len(ids[0]) + np.cumsum(number[~plain]) - number[~plain]
    ids = np.concatenate(ids)
    return ids if plain.all() else ids[ranges(first, number)], np.concatenate([[0], np.cumsum(number)])


def subwords(encoder, texts: Texts, found, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct words: their hashes, and for each word which of them it is; and the
    vocabulary ids of the distinct words, each with a space before it, with their offsets."""
    distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    start = found.start[first]
    data = texts.data.tobytes().translate(_LOWERED)
    return distinct, which, *_coded_words(encoder, data, start, found.end[first] - start)


class Streams(NamedTuple):
    """Texts as subwords: vocabulary ids with an end after each text, where texts and words
    begin, and per word (ends included) its text and a hash of its ids."""

    ids: np.ndarray
    text_start: np.ndarray
    text_size: np.ndarray
    word_start: np.ndarray
    word_text: np.ndarray
    word_hash: np.ndarray


_SPREAD = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))
#: Subwords whose words are hashed together, at most but for a longer word.
_HASHED = 1 << 18


def sequence_hashes(ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words that begin at ``start``: polynomials in their ids, spread.
    Different words have different ids, as these spell the word."""
    out = np.empty(len(start), dtype=np.uint64)
    end = np.append(start[1:], len(ids))
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _HASHED, "right")))
        size = end[i:j] - start[i:j]
        first = start[i:j] - start[i]
        place = np.arange(end[j - 1] - start[i]) - np.repeat(first, size)
        terms = _SPREAD.take(ids[start[i] : end[j - 1]])
        terms *= powers(1 << int(size.max()).bit_length())[0].take(place)
        out[i:j] = mix(np.add.reduceat(terms, first))
        i = j
    return out.view(np.int64)


def _framed(ids: np.ndarray, text_size: np.ndarray, word_start: np.ndarray) -> Streams:
    ends = np.cumsum(text_size)
    word_text = np.searchsorted(ends, word_start, "right")
    return Streams(ids, ends - text_size, text_size, word_start, word_text, sequence_hashes(ids, word_start))


def _coded(encoder, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of texts with an end after each, how many each text has, and where words begin."""
    found = words(texts)
    count = len(texts.offsets) - 1
    distinct, which, flat, offsets = subwords(encoder, texts, found, word_hashes(texts, found))
    flat = np.append(flat, np.uint16(END))
    offsets = np.append(offsets, len(flat))
    # The end of each text stands behind its words.
    place = np.searchsorted(found.text, np.arange(count), "right")
    which = np.insert(which, place, len(distinct))
    text = np.insert(found.text, place, np.arange(count))
    size = np.diff(offsets)[which]
    return (
        flat[ranges(offsets[which], size)], np.bincount(text, weights=size, minlength=count).astype(np.int64),
        np.cumsum(size) - size,
    )


def streams(encoder, texts: Texts) -> Streams:
    return _framed(*_coded(encoder, texts))


def stored_streams(column: pa.Array, opens: np.ndarray) -> Iterator[tuple[int, Streams]]:
    """Texts that are subwords already, some at a time, and the number of the first: a word
    begins at each id that begins with a space, and at the end."""
    for t in groups(column, CODED_BYTES):
        ids = t.data.view("<u2")
        yield t.first, _framed(ids, np.diff(t.offsets) // 2, np.flatnonzero(opens[ids]))


def _coding(vocabulary):
    """The subwords of whole texts, an end after each, in place of the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        encoder = tokens.encoding(vocabulary.value)
        for batch in batches:
            other = batch.drop_columns(["text"])
            for t in groups(batch["text"]):
                ids, size, _ = _coded(encoder, t)
                offsets = np.concatenate([[0], 2 * np.cumsum(size)]).astype(np.int32)
                coded = pa.Array.from_buffers(
                    pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u2"))]
                )
                yield other.slice(t.first, len(size)).append_column("ids", coded)
    return run


def word_log_probabilities(scorer: Scorer, s: Streams) -> np.ndarray:
    """Natural logarithm of the model's probability of each word after the words before it:
    all its subwords, each told once, and that the next one begins a word or ends the text,
    given that the word before had ended."""
    own = scorer.own[s.ids]
    out, opening = (np.empty(len(own), dtype=np.float32) for _ in range(2))
    ids, told, at = attention.windows(own, s.text_start, s.text_size)
    there = at >= 0
    some, opens = attention.log_probabilities_and_opening(scorer.model, ids, told, scorer.opening)
    out[at[there]], opening[at[there]] = some[there], opens[there]
    out += scorer.rare[s.ids]
    if not len(out):
        return out
    begun = opening[s.word_start]
    ended = np.append(begun[1:], np.float32(0))
    # Nothing follows the end of a text.
    ended[np.append(s.word_text[1:] != s.word_text[:-1], True)] = 0
    return np.add.reduceat(out, s.word_start) + ended - begun


def _counted(opens):
    """(word, n), ends included, of COUNTED words or more at a time."""
    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        word, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        held, size = [], 0
        for batch in batches:
            for _, s in stored_streams(batch["ids"], opens.value):
                held.append(s.word_hash)
                size += len(held[-1])
                if size >= COUNTED:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)
    return run


def _cut(vocabulary):
    """All subwords of each text, or of each text's ids, in stretches, with what stands
    before each, and a hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        before = np.array([NONE_ID] * CONTEXT + [START_ID], dtype="<u2")
        for batch in batches:
            row, tuning = batch["row"].to_numpy(), batch["tuning"].to_numpy(zero_copy_only=False)
            if "ids" in batch.schema.names:
                parts = ((t.first, t.data.view("<u2"), np.diff(t.offsets) // 2) for t in groups(batch["ids"], CODED_BYTES))
            else:
                encoder = tokens.encoding(vocabulary.value)
                parts = ((t.first, *_coded(encoder, t)[:2]) for t in groups(batch["text"]))
            for top, ids, size in parts:
                number = -(-size // STRETCH)
                place = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
                text = np.repeat(np.arange(len(number)), number) + top
                hashes = mix(mix(row[text].astype(np.uint64)) + place.astype(np.uint64)).view(np.int64)
                out = []
                for first, n in zip((np.cumsum(size) - size).tolist(), size.tolist()):
                    led = np.concatenate([before, ids[first : first + n]])
                    out += [led[a : a + len(before) + STRETCH].tobytes() for a in range(0, n, STRETCH)]
                # Some thousand stretches at a time, however long a text is.
                for a in range(0, len(out), 4096):
                    z = slice(a, a + 4096)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashes[z]), pa.array(tuning[text[z]]), pa.array(out[z], pa.binary())],
                        names=["stretch", "tuning", "ids"],
                    )
    return run


def _stretches(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The subwords of some stretches, where those to tell begin, and how many they are."""
    raw = column.to_pylist()
    size = np.array([len(x) // 2 for x in raw], dtype=np.int64)
    return np.frombuffer(b"".join(raw), "<u2"), np.cumsum(size) - size + CONTEXT + 1, size - CONTEXT - 1


def _windows(own: np.ndarray, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of some stretches: ids read, ids to tell, and which of these are there."""
    flat, first, count = _stretches(column)
    number = -(-count // SCORED)
    which = np.repeat(np.arange(len(count)), number)
    start = first[which] + (np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number)) * SCORED
    end = (first + count)[which][:, None]
    read = start[:, None] - CONTEXT - 1 + np.arange(WINDOW)
    told = start[:, None] + np.arange(SCORED)
    there = told < end
    flat = own[flat]
    ids = np.where(read < end, flat[np.minimum(read, len(flat) - 1)], -1)
    return ids, np.where(there, flat[np.minimum(told, len(flat) - 1)], 0), there


def _summed(name: str, size: int, numbers):
    """(name, n): how often each of ``size`` numbers occurs in all of a task's stretches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            if len(batch):
                total += np.bincount(numbers(*_stretches(batch["ids"])), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=[name, "n"])
    return run


def _totals(stretches: DataFrame, size: int, numbers) -> np.ndarray:
    # Each task has a row for each number: not one for each small file.
    each, least = stretches.rdd.getNumPartitions(), 2 * stretches.sparkSession.sparkContext.defaultParallelism
    some = stretches.select("ids").coalesce(max(1, min(each, max(least, each // 8))))
    counts = some.mapInArrow(_summed("number", size, numbers), "number long, n long")
    counts = counts.groupBy("number").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, dtype=np.int64)
    out[counts["number"].to_numpy()] = counts["n"].to_numpy()
    return out


class Ids(NamedTuple):
    """The map of vocabulary ids to the model's, the logarithm of each one's share of its
    model id (0 but for rare ones), the classes of those that begin a word or end the text,
    and the counts of the model's ids."""

    own: np.ndarray
    rare: np.ndarray
    opening: int
    sizes: np.ndarray


def model_ids(stretches: DataFrame, opens: np.ndarray) -> Ids:
    """The model's ids from the counts of all ``stretches``: the most frequent subwords that
    begin a word or end the text (``opens``), and the rest of these as one; then the others."""
    counts = _totals(stretches, len(opens), _told)
    ranked = np.argsort(-counts, kind="stable")
    first = min(SIDE - 1, max(1, round((opens[ranked[: SIZE - 2]].sum() + 1) / SIDE))) * SIDE
    own, rare = np.empty(len(opens), dtype=np.int64), np.zeros(len(opens), dtype=np.float32)
    for kind, start, places in ((opens, 0, first), (~opens, first, SIZE - first)):
        mine = ranked[kind[ranked]]
        own[mine] = start + np.minimum(np.arange(len(mine)), places - 1)
        rest = mine[places - 1 :]
        rare[rest] = np.log((counts[rest] + 1) / (counts[rest] + 1).sum())
    sizes = np.bincount(own, weights=counts, minlength=SIZE)
    # Classes hold ids that follow the same frequent ones.
    column = np.full(SIZE, -1)
    column[np.argsort(-sizes, kind="stable")[:256]] = np.arange(256)
    follow = _totals(stretches, SIZE * 256, _pairs(own, column)).reshape(SIZE, 256)
    order = [attention.arranged(sizes[z], follow[z]) + z.start for z in (slice(0, first), slice(first, SIZE))]
    order = np.concatenate(order)
    place = np.empty(SIZE, dtype=np.int64)
    place[order] = np.arange(SIZE)
    return Ids(place[own], rare, first // SIDE, sizes[order])


def _told(flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return flat[ranges(first, count)]


def _pairs(own: np.ndarray, column: np.ndarray):
    def numbers(flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        at = ranges(first, count)
        before, at = flat[at - 1], at[flat[at - 1] < len(own)]
        before = column[own[before[before < len(own)]]]
        return own[flat[at[before >= 0]]] * 256 + before[before >= 0]
    return numbers


def _read_map(own: np.ndarray) -> np.ndarray:
    """``own`` for all 16-bit numbers, what stands before a text included."""
    out = np.full(1 << 16, -1, dtype=np.int32)
    out[: len(own)] = own
    out[START_ID] = START
    return out


def _learning(given, own, number: int, rounds: int, expected: float, seed: int):
    """A task's model after learning from all its stretches, in pieces, with its windows'
    number. The only task of the only round learns at least STEPS steps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        mine = given.value.filled(given.value.flat())
        seen = step = 0
        held: list[tuple] = []

        def joined():
            return [np.concatenate(x) for x in zip(*held)]

        for batch in batches:
            for a in range(0, len(batch), 256):
                held.append(_windows(own.value, batch["ids"][a : a + 256]))
                seen += len(held[-1][0])
                if rounds == 1:
                    continue
                now = joined()
                whole = len(now[0]) // BATCH * BATCH
                for b in range(0, whole, BATCH):
                    step += 1
                    done = (number + min(1.0, step / expected)) / rounds
                    mine.learn(int(number * expected) + step, min(done, 1 - 0.5 / rounds / expected),
                               *[x[b : b + BATCH] for x in now])
                held = [tuple(x[whole:] for x in now)]
        if not seen:
            return
        now = joined()
        if rounds == 1:
            steps = max(STEPS, -(-seen // BATCH))
            mine = attention.learner(attention.train(mine.model, *now, steps, BATCH, seed))
        elif len(now[0]):
            mine.learn(int(number * expected) + step + 1, min(1.0, number / rounds + 0.5 / rounds), *now)
        pieces = [x.tobytes() for x in np.array_split(mine.flat(), CHUNKS)]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(CHUNKS), pa.int32()), pa.array([task] * CHUNKS, pa.int32()),
             pa.array([seen] * CHUNKS, pa.int64()), pa.array(pieces, pa.binary())],
            names=["chunk", "task", "windows", "numbers"],
        )
    return run


_PIECES = "chunk int, task int, windows long, numbers binary"


def _averaged(table: pa.Table) -> pa.Table:
    """One piece of the tasks' models, by their numbers of windows, in the tasks' order."""
    table = table.sort_by("task")
    weights, total = table["windows"].to_pylist(), 0.0
    for w, x in zip(weights, table["numbers"]):
        total = total + np.frombuffer(x.as_py(), np.float32).astype(np.float64) * w
    piece = (total / sum(weights)).astype(np.float32).tobytes()
    return pa.table(
        [table["chunk"][:1].combine_chunks(), pa.array([0], pa.int32()), pa.array([sum(weights)], pa.int64()),
         pa.array([piece], pa.binary())],
        names=["chunk", "task", "windows", "numbers"],
    )


def learned_model(stretches: DataFrame, ids: Ids, tasks: int, rounds: int, seed: int = 1) -> tuple[Model, int]:
    """The model, and the number of windows learned from: all of those of ``stretches``
    (round, ids). In each round tasks learn from their windows, step by step from one
    model, and the average of theirs is the next one. Where there are few, one task goes
    over them until it has made STEPS steps; more rounds go over the data again."""
    spark = stretches.sparkSession
    mine = attention.learner(attention.new_model(ids.sizes, seed))
    own = spark.sparkContext.broadcast(_read_map(ids.own))
    size = F.ceil((F.octet_length("ids") / 2 - CONTEXT - 1) / SCORED)
    total = stretches.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    workers = min(tasks, max(1, spark.sparkContext.defaultParallelism))
    again = max(1, -(-STEPS * BATCH * workers // max(1, total))) if rounds > 1 else 1
    expected = max(1.0, total / (rounds * BATCH * workers))
    seen = 0
    for number in range(rounds * again):
        given = spark.sparkContext.broadcast(mine)
        part = stretches.where(F.col("round") == number % rounds).select("ids")
        part = part.coalesce(1) if rounds == 1 else part
        run = _learning(given, own, number, rounds * again, expected, seed)
        pieces = part.mapInArrow(run, _PIECES).groupBy("chunk").applyInArrow(_averaged, _PIECES).toArrow()
        given.unpersist()
        if len(pieces):
            pieces = pieces.sort_by("chunk")
            mine = mine.filled(np.frombuffer(b"".join(pieces["numbers"].to_pylist()), np.float32))
            seen += pieces["windows"][0].as_py()
    return mine.model, seen


def opening_ids(vocabulary: bytes) -> np.ndarray:
    """Which vocabulary ids begin a word, that is with a space, or end a text."""
    lines = [line.split() for line in vocabulary.splitlines() if line]
    out = np.zeros(len(lines) + 1, dtype=bool)
    for word, number in lines:
        out[int(number)] = base64.b64decode(word).startswith(b" ")
    out[-1] = True
    return out


def fitted(coded: DataFrame, counts: DataFrame, vocabulary: bytes) -> Scorer:
    """A scorer for ``coded`` texts (row, learned, tuning, ids) and the ``counts`` (word, n)
    of what is learned.

    Subwords are counted over all learned documents. The subword model learns from all
    windows of these but for one document in TUNING, by hash; its part in the mixture is
    the one that gives those the greatest probability, their own words taken from the counts."""
    spark = coded.sparkSession
    opens = opening_ids(vocabulary)
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = counts.where(F.col("n") * FREQUENT >= total).toArrow().sort_by("word")
    frequent, n = frequent["word"].to_numpy(), frequent["n"].to_numpy()
    tasks = min(TASKS, max(1, total // TASK_WORDS))
    rounds = ROUNDS if tasks > 1 else 1
    learned = coded.where("learned").select("row", "tuning", "ids")
    stretches = learned.mapInArrow(_cut(None), "stretch long, tuning boolean, ids binary")
    stretches = stretches.repartition(tasks, "stretch").select(
        F.when(F.col("tuning"), -1).otherwise(F.pmod(F.shiftright("stretch", 20), F.lit(rounds))).cast("int").alias("round"),
        "stretch", "ids",
    )
    path = scratch_path(spark, "stretches")
    stretches.sortWithinPartitions("round", "stretch").write.partitionBy("round").parquet(path)
    stretches = spark.read.schema("stretch long, ids binary, round int").parquet(path)
    ids = model_ids(stretches, opens)
    model, _ = learned_model(stretches.where("round >= 0"), ids, tasks, rounds)
    scorer = Scorer(model, ids.own, ids.rare, ids.opening, 0.5, frequent, n, total, distinct)
    return scorer._replace(part=_best_part(scorer, counts, learned.where("tuning").select("ids"), opens))


#: Shares of the model among which the best is taken.
_SHARES = [i / 20 for i in range(1, 20)]


def _tuned(scorer, opens):
    """The scores of the frequent words of each text, summed for each of _SHARES, and a row
    for each other word. What a text adds to the counts itself does not speak for its words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        told = scorer.value
        each = [told._replace(part=p) for p in _SHARES]
        for batch in batches:
            for _, s in stored_streams(batch["ids"], opens.value):
                log_model = word_log_probabilities(told, s)
                order = np.lexsort((s.word_hash, s.word_text))
                new = np.ones(len(order), dtype=bool)
                new[1:] = (np.diff(s.word_hash[order]) != 0) | (np.diff(s.word_text[order]) != 0)
                times = np.empty(len(order), dtype=np.int64)
                times[order] = np.diff(np.append(np.flatnonzero(new), len(order)))[np.cumsum(new) - 1]
                at = np.minimum(np.searchsorted(told.frequent, s.word_hash), max(0, len(told.frequent) - 1))
                known = told.frequent[at] == s.word_hash if len(told.frequent) else np.zeros(len(at), bool)
                c = told.counts[at[known]] - times[known] if len(told.counts) else at[known]
                sums = [float(x.mixed(np.maximum(c, 0), log_model[known]).sum()) for x in each]
                word, times, log_model = s.word_hash[~known], times[~known], log_model[~known]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(word, word_key(s))), pa.array(np.append(times, 0)),
                     pa.array(np.append(log_model, np.float32(np.nan)), pa.float32()),
                     pa.array([None] * len(word) + [sums], pa.list_(pa.float64()))],
                    names=["word", "times", "log_model", "sums"],
                )
    return run


def word_key(s: Streams) -> int:
    """A number for some texts that falls on a word's hash but by chance."""
    with np.errstate(over="ignore"):
        return int(mix(s.word_hash.view(np.uint64).sum(keepdims=True) + np.uint64(len(s.ids))).view(np.int64)[0])


def _best_part(scorer: Scorer, counts: DataFrame, texts: DataFrame, opens: np.ndarray) -> float:
    """The part of the model among _SHARES that suits all tuning texts best."""
    context = counts.sparkSession.sparkContext
    parts = texts.mapInArrow(_tuned(context.broadcast(scorer), context.broadcast(opens)), "word long, times long, log_model float, sums array<double>")
    less = counts.where(F.col("n") * FREQUENT < scorer.total)
    parts = parts.join(less, "word", "left")
    c = F.greatest(F.coalesce("n", F.lit(0)) - F.col("times"), F.lit(0))
    word, told = ~F.isnan("log_model"), F.col("log_model").cast("double")
    sums = []
    for i, p in enumerate(_SHARES):
        score = _mixed(c, told, p, scorer.total)
        sums.append(F.sum(F.when(word, score).otherwise(F.col("sums")[i])))
    sums = parts.agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)]).first()
    return max(zip(sums, _SHARES))[1] if sums[0] is not None else scorer.part


def _mixed(c, log_model, part: float, total: int):
    """Scorer.mixed as a column."""
    share = F.lit((1 - part) / max(1, total)) * c
    return F.when(c > 0, F.log10(share + F.lit(part) * F.exp(log_model))).otherwise(
        (log_model + F.lit(float(np.log(part)))) / F.lit(float(np.log(10)))
    )


def _scored(scorer, opens):
    """Per text a row of what its frequent words add, and a row for each other word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        told = scorer.value
        for batch in batches:
            row = batch["row"].to_numpy()
            for first, s in stored_streams(batch["ids"], opens.value):
                count = len(s.text_size)
                log_model = word_log_probabilities(told, s)
                at = np.minimum(np.searchsorted(told.frequent, s.word_hash), max(0, len(told.frequent) - 1))
                known = told.frequent[at] == s.word_hash if len(told.frequent) else np.zeros(len(at), bool)
                text, c = s.word_text[known], told.counts[at[known]] if len(told.counts) else at[known]

                def summed(x):
                    return np.bincount(text, weights=x, minlength=count)

                mine = row[first : first + count]
                some = ~known
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([mine, mine[s.word_text[some]]])),
                        pa.array(np.concatenate([mix(mine.astype(np.uint64)).view(np.int64), s.word_hash[some]])),
                        pa.array(np.concatenate([np.full(count, np.nan, np.float32), log_model[some]]), pa.float32()),
                        pa.array(np.concatenate([np.bincount(s.word_text, minlength=count), np.zeros(some.sum(), int)])),
                        pa.array(np.concatenate([summed(np.ones(len(c))).astype(int), np.zeros(some.sum(), int)])),
                        pa.array(np.concatenate([summed(told.base(c)), np.zeros(some.sum())])),
                        pa.array(np.concatenate([summed(told.mixed(c, log_model[known])), np.zeros(some.sum())])),
                    ],
                    names=["row", "word", "log_model", "n_tokens", "n_known", "base", "score"],
                )
    return run


def scored(docs: DataFrame, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score (logarithms to base 10).

    Tokens are the words, A-Z in lower case, and an end. Their counts are taken over all
    documents that are not held out. ``score`` mixes two probabilities of each word: its
    share of the counts, and the product over its subwords, and of its end, from a causal
    self-attention model, which reads the whole text in overlapping windows and tells every
    subword once from what stands before it; both sum to at most 1 over all words. Frequent words, at most FREQUENT of them, are looked up in
    the tasks; the others of each text meet their counts in a join by word, which no
    frequent word can make uneven, and their sums meet the text again.

    A null or empty text is its end alone; a null id is not held out; repeated rows are
    scored and counted again; where nothing is learned, all counts are 0 and the model is
    untrained; no documents give no rows.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    text = whole_text(F.col("text"))
    out = held_out(F.col("doc_id"), FOLDS, HELD_OUT)
    row = F.monotonically_increasing_id()
    rows = docs.select(
        row.alias("row"), "doc_id", (~out).alias("learned"), text.alias("text")
    ).withColumn("tuning", F.pmod(F.xxhash64(F.lit(17), "row"), F.lit(TUNING)) == 0)
    data = tokens.load(vocabulary)
    # Every text is turned into subwords once; all that follows reads these.
    schema = T.StructType([f for f in rows.schema if f.name != "text"]).add("ids", "binary")
    coded = stored(rows.mapInArrow(_coding(spark.sparkContext.broadcast(data)), schema), "subwords")
    opens = spark.sparkContext.broadcast(opening_ids(data))
    counts = coded.where("learned").select("ids").mapInArrow(_counted(opens), "word long, n long")
    counts = stored(counts.groupBy("word").agg(F.sum("n").alias("n")), "words")
    scorer = fitted(coded, counts, data)
    parts = coded.select("row", "ids").mapInArrow(
        _scored(spark.sparkContext.broadcast(scorer), opens),
        "row long, word long, log_model float, n_tokens long, n_known long, base double, score double",
    )
    less = counts.where(F.col("n") * FREQUENT < scorer.total)
    parts = parts.join(less, "word", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    word = ~F.isnan("log_model")
    mixed = _mixed(F.col("c"), F.col("log_model").cast("double"), scorer.part, scorer.total)
    base = F.log10((F.col("c") + 1.0) / F.lit(scorer.total + scorer.distinct + 1.0))
    sums = parts.groupBy("row").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(word & (F.col("c") > 0), 1).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(word, base).otherwise(0.0)).alias("base_score"),
        F.sum(F.col("score") + F.when(word, mixed).otherwise(0.0)).alias("score"),
    )
    return coded.select("row", "doc_id", (~F.col("learned")).alias("held_out")).join(sums, "row").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(scorer.total).cast("long").alias("train_tokens"),
        "base_score", "score",
    )
