"""Removal of passages that stand in an earlier document too, by level-wise doubling.

Windows of half the wanted length come first: of those within a wanted window the one with
the smallest hash stands for it, whatever the document, so only that one's repetitions are
counted. Windows whose half is repeated in another document are extended to the wanted
length and compared there; those repeated at a length are extended to twice that length,
until no candidates survive. Equal texts are one class before any of this.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyroom.llm import spans
from tallyroom.llm.ranks import matched
from tallyroom.llm.tables import bounded_batches, discard, stored, whole_text
from tallyroom.llm.words import groups

WINDOW = 50
#: Odd bases of the hashes of words and windows, any large odd numbers.
_WORD_BASE, _BASES = 0x9E3779B97F4A7C15, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[32, *range(9, 14)]] = False


def _texts(batch: pa.RecordBatch, column: str):
    """Per text of a batch: its row, its bytes, first and past-last bytes of its words."""
    for texts in groups(batch.column(column)):
        found = spans.find(texts, _IS_WORD)
        cuts = np.searchsorted(found.text, np.arange(len(texts.offsets)))
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            yield texts.first + i, texts.data, found.start[a:b], found.end[a:b]


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values (of which there must be as many)."""
    out, reach = values, 1
    while 2 * reach <= width:
        out, reach = np.minimum(out[:-reach], out[reach:]), 2 * reach
    over = width - reach
    return np.minimum(out[: len(out) - over], out[over:]) if over else out


def _numbers(values) -> pa.Array:
    return pa.array(values.view(np.int64)) if len(values) else pa.array([], pa.int64())


def _joined_arrays(parts: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts)]
    return pa.RecordBatch.from_arrays([_numbers(c) for c in columns], names)


def halves(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, unit, half, low, high): windows from word ``low`` to ``high`` of a text have
    ``half`` as the smallest hash among their parts of half their length."""
    length = (window + 1) // 2
    names = ["doc_id", "unit", "half", "low", "high"]

    def found(batches):
        for batch in batches:
            doc, unit, parts = batch.column("doc_id").to_numpy(), batch.column("unit").to_numpy(), []
            for row, data, start, end in _texts(batch, "text"):
                if len(start) < window:
                    continue
                words = spans.hashes(data, start, end, _WORD_BASE)
                least = sliding_minimum(spans.window_hashes(words, length, _BASES[0]), window - length + 1)
                low = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
                high = np.append(low[1:], len(least)) - 1
                n = len(low)
                parts.append((np.full(n, doc[row]), np.full(n, unit[row]), least[low].view(np.int64), low, high))
            if parts:
                yield _joined_arrays(parts, names)

    return rows.mapInArrow(found, ", ".join(f"{n} long" for n in names))


def extended(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, unit, place, a, b): the 128-bit hashes of the whole windows that begin at
    the words of ``runs`` (low, high) of each text."""
    names = ["doc_id", "unit", "place", "a", "b"]

    def hashed(batches):
        for batch in batches:
            doc, unit, parts, many = batch.column("doc_id").to_numpy(), batch.column("unit").to_numpy(), [], 0
            runs = batch.column("runs")
            for row, data, start, end in _texts(batch, "text"):
                here = runs[row].values
                low, high = (here.field(i).to_numpy() for i in (0, 1))
                size = high - low + 1
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - low, size)
                words = spans.hashes(data, start, end, _WORD_BASE)
                both = [spans.window_hashes(words, window, base)[place].view(np.int64) for base in _BASES]
                parts.append((np.full(len(place), doc[row]), np.full(len(place), unit[row]), place, *both))
                many += len(place)
                if many > 1 << 18:
                    yield _joined_arrays(parts, names)
                    parts, many = [], 0
            if parts:
                yield _joined_arrays(parts, names)

    return rows.mapInArrow(hashed, ", ".join(f"{n} long" for n in names))


def _shared(rows: DataFrame, key: list[str], label: str) -> DataFrame:
    """A table of those of ``rows``, a table that is given up, whose key stands in two
    documents or more, with the least of these."""
    least = rows.groupBy(key).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
    repeated = stored(least.where("least < most").select(*key, "least", "n"), "repeated")
    out = stored(matched(rows, repeated, key, "n").drop("n"), label)
    discard(repeated)
    discard(rows)
    return out


def _copies(ids: DataFrame) -> DataFrame:
    """(doc_id, unit) of texts that also stand under a smaller id."""
    classes = ids.groupBy("unit", "other").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    classes = stored(classes.where("first < last").drop("last"), "classes")
    copies = matched(ids, classes, ["unit", "other"], "n").where("doc_id > first")
    return copies.select("doc_id", "unit").distinct()


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(doc_id, unit, starts, longest) of the texts with windows that stand in a document of
    smaller id as well, and (doc_id, unit) of the texts that as a whole do. ``unit`` is a hash
    of the text; ``starts`` are the first words of such windows, ``longest`` is the greatest
    of the lengths ``window``, 2 ``window``, 4 ``window``, … at which there are any."""
    text = whole_text(F.col("text"))
    rows = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("unit"), text.alias("text")
    )
    ids = stored(rows.select("doc_id", "unit", F.xxhash64(F.lit(1), "text").alias("other")).distinct(), "ids")
    copies = stored(_copies(ids), "copies")

    bounded_batches(docs.sparkSession)
    key = ["doc_id", "unit"]
    level = stored(halves(rows, window).join(copies, key, "left_anti"), "halves")
    # Sets, as rows with the same id and text give the same runs and windows.
    shared = _shared(level, ["half"], "shared")
    runs = shared.groupBy(key).agg(F.collect_set(F.struct("low", "high")).alias("runs"))
    level, length, found = stored(extended(rows.join(runs, key), window), "windows"), window, []
    discard(shared)
    while True:
        alive = _shared(level, ["a", "b"], "survivors")
        here = alive.where("least < doc_id")
        if length == window:
            here = here.groupBy(key).agg(F.collect_set("place").alias("starts"))
        else:
            here = here.select(*key, F.lit(None).cast("array<bigint>").alias("starts")).distinct()
        found.append(stored(here.withColumn("longest", F.lit(length)), "found"))
        if alive.isEmpty():
            break
        level, length = stored(_doubled(alive, length), "windows"), 2 * length
        discard(alive)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    # Starts are there for one row of each text, so the greatest is that one.
    starts = F.max(F.when(F.col("starts").isNotNull(), F.struct("longest", "starts")))["starts"]
    every = every.groupBy(key).agg(starts.alias("starts"), F.max("longest").cast("long").alias("longest"))
    return every, copies


def _doubled(alive: DataFrame, length: int) -> DataFrame:
    """Windows of twice the length: those whose first and second half both survive."""
    key = ["doc_id", "unit", "place"]
    first = alive.select(*key, "a", "b", *[F.lit(None).cast("long").alias(c) for c in ("c", "d")])
    second = alive.select(
        "doc_id", "unit", (F.col("place") - length).alias("place"),
        *[F.lit(None).cast("long").alias(c) for c in ("a", "b")], F.col("a").alias("c"), F.col("b").alias("d"),
    ).where("place >= 0")
    both = first.unionByName(second).groupBy(key).agg(*[F.max(c).alias(c) for c in "abcd"])
    return both.where("a IS NOT NULL AND c IS NOT NULL").select(
        *key, F.xxhash64("a", "c").alias("a"), F.xxhash64("b", "d").alias("b")
    )


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text, n_words, n_removed, kept, longest) for every row of ``docs``: ``kept``
    is the text without the words that a window of ``window`` words covers whose words also
    stand, in this order, in a document of smaller id; words are joined by one space.

    Windows are judged on the texts as given. Null texts are empty; texts of fewer words than
    a window stay. Rows without an id neither lose words nor take any from others; rows of
    one id take none from each other. ``longest`` tells of how long the repeated passages
    are (see ``repeated_windows``; 0 if none). Other columns are not read.
    """
    found, copies = repeated_windows(docs, window)
    marks = found.withColumn("copy", F.lit(False)).unionByName(
        copies.withColumn("copy", F.lit(True)), allowMissingColumns=True
    )
    rows = docs.select("doc_id", whole_text(F.col("text")).alias("text"))
    rows = rows.withColumn("unit", F.xxhash64("text")).join(marks, ["doc_id", "unit"], "left")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            n = batch.num_rows
            words, removed, longest = (np.zeros(n, dtype=np.int64) for _ in range(3))
            starts, copy, most = batch.column("starts"), batch.column("copy").to_pylist(), batch.column("longest")
            kept = [""] * n
            for row, data, start, end in _texts(batch, "text"):
                words[row] = count = len(start)
                stays = np.ones(count, dtype=bool)
                if copy[row] and count >= window:
                    stays[:] = False
                    longest[row] = window << int(count // window).bit_length() - 1
                elif starts[row].is_valid:
                    place = starts[row].values.to_numpy()
                    change = np.bincount(place, minlength=count + window) - np.bincount(
                        place + window, minlength=count + window)[: count + window]
                    stays = np.cumsum(change[:count]) == 0
                    longest[row] = most[row].as_py()
                removed[row] = count - stays.sum()
                kept[row] = bytes(spans.joined(data, start[stays], end[stays])[0][:-1]).decode()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array(words), pa.array(removed),
                 pa.array(kept, pa.string()), pa.array(longest)],
                ["doc_id", "text", "n_words", "n_removed", "kept", "longest"],
            )

    bounded_batches(docs.sparkSession)
    schema = f"doc_id {kind}, text string, n_words long, n_removed long, kept string, longest long"
    return rows.mapInArrow(cut, schema)


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, longest) of ``without_repeats``."""
    return without_repeats(docs, window).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "longest"
    )


ORACLE = """
    WITH cut AS (
        SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents
    ),
    win AS (
        SELECT n, doc_id, unnest(list_transform(range(1, len(w) - 48), lambda i:
            {'i': i, 'h': sha256(array_to_string(w[i:i + 49], ' '))})) AS x
        FROM cut WHERE len(w) >= 50
    ),
    least AS (SELECT x.h AS h, min(doc_id) AS least FROM win GROUP BY x.h HAVING min(doc_id) < max(doc_id)),
    gone AS (
        SELECT DISTINCT n, unnest(range(x.i, x.i + 50)) AS i
        FROM win JOIN least ON win.x.h = least.h WHERE least < doc_id
    ),
    word AS (SELECT n, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM cut),
    stay AS (
        SELECT n, count(*) AS n_kept, string_agg(v, ' ' ORDER BY i) AS kept
        FROM word ANTI JOIN gone USING (n, i) GROUP BY n
    )
    SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed,
        sha256(coalesce(kept, '')) AS kept_sha256
    FROM cut LEFT JOIN stay USING (n)
"""
