"""Target-distribution importance resampling: documents drawn as if from another corpus.

Runs of one and two words are hashed into buckets by CRC-32 (``crc``: XOR of a table of
bytes by distance from the end over feature spans). A bucket's gain compares how common it
is in the target with how common it is in the documents; a document's weight is the mean
gain of its features, and Gumbel noise from a hash of its id makes the highest scores a draw
without replacement by weight. The corpus is read twice; what passes between the readings
is one count a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyroom.llm import spans
from tallyroom.llm.crc import crc32_spans
from tallyroom.llm.ranks import numbered
from tallyroom.llm.sql import CRC_STEPS, crc
from tallyroom.llm.tables import bounded_batches, stored, whole_text
from tallyroom.llm.words import Texts, groups

BUCKETS = 10_000
#: Words hashed together at most; a text with more is worked through in slices.
SLICE = 1 << 17

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A word: digits, lower-cased letters and everything beyond ASCII.
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def features(texts: Texts, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the features of some texts: number of the text, whether one word, bucket."""
    lowered = Texts(texts.first, _LOWER[texts.data], texts.offsets)
    found = spans.find(lowered, _IS_WORD)
    for i in range(0, len(found.start), SLICE):
        # One word more than the slice, for the pair that begins with its last one.
        text, start, end = (x[i : i + SLICE + 1] for x in found)
        data, begin = spans.joined(lowered.data, start, end)
        stop = begin + end - start
        single = min(SLICE, len(text))
        yield text[:single], np.ones(single, dtype=bool), crc32_spans(data, begin[:single], stop[:single]) % buckets
        for odd in (0, 1):
            first = np.arange(odd, len(text) - 1, 2)
            crc = crc32_spans(data, begin[first], stop[first + 1]) % buckets
            pair = text[first] == text[first + 1]
            yield text[first][pair], np.zeros(pair.sum(), dtype=bool), crc[pair]


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket, added up within each task first."""
    def counted(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for texts in groups(batch.column(0)):
                for _, _, bucket in features(texts, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(total[filled])], ["bucket", "n"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(whole_text(F.col("text")).alias("text")).mapInArrow(counted, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln of the smoothed share of each bucket in ``target`` over ``docs``)."""
    found = np.zeros((2, buckets), dtype=np.int64)
    for side, table in enumerate((docs, target)):
        for row in bucket_counts(table, buckets).collect():
            found[side, row["bucket"]] = row["n"]
    (s, t), (all_s, all_t) = found.tolist(), found.sum(axis=1).tolist()
    return np.array(
        [
            math.floor(1000 * math.log(float((t[b] + 1) * (all_s + buckets)) / float((s[b] + 1) * (all_t + buckets))))
            for b in range(buckets)
        ],
        dtype=np.int64,
    )


def weighted(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_features, n_words, weight): the floored mean gain of all features."""
    def measured(batches):
        for batch in batches:
            n = batch.num_rows
            features_, words, total = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for texts in groups(batch.column(1)):
                here = slice(texts.first, texts.first + len(texts.offsets) - 1)
                size = len(texts.offsets) - 1
                for text, single, bucket in features(texts, len(gain)):
                    features_[here] += np.bincount(text, minlength=size)
                    words[here] += np.bincount(text[single], minlength=size)
                    # Sums of integers below 2 ** 53, so exact as doubles.
                    total[here] += np.bincount(text, gain[bucket], minlength=size).astype(np.int64)
            weight = np.floor_divide(total, np.maximum(features_, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, (features_, words, weight))],
                ["doc_id", "n_features", "n_words", "weight"],
            )

    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", whole_text(F.col("text")).alias("text"))
    return rows.mapInArrow(measured, f"doc_id {kind}, n_features long, n_words long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of sha256 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of ``docs``.

    Documents of ``least_words`` or more are drawn from, ``percent`` of a hundred of them,
    rounded down; rank counts the drawn ones from 1, highest score first, ties to the smaller
    id, and is null for all others. Null texts count as empty; texts without a word have no
    features and weight 0. A null id hashes as an empty text and comes last among ties; equal
    rows are drawn one by one. Empty tables give no rows (``docs``) or no counts (``target``:
    gains then favour what is rare). Other columns are not read.
    """
    gain = gains(docs, target, buckets)
    rows = stored(weighted(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weighted")
    open_ = F.col("n_words") >= least_words
    drawn = percent * rows.where(open_).count() // 100
    ranked = numbered(rows.where(open_), [F.desc("score"), F.asc_nulls_last("doc_id")], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    everyone = ranked.unionByName(rows.where(~open_).withColumn("rank", F.lit(None).cast("long")))
    return everyone.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = f"""
    WITH {CRC_STEPS.strip()},
    texts AS (
        SELECT 'd' AS side, row_number() OVER () AS n, doc_id, text FROM documents
        UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark
    ),
    cut AS (
        SELECT side, n, doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
        FROM texts
    ),
    feature AS (
        SELECT side, n, unnest(w) AS f FROM cut
        UNION ALL
        SELECT side, n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM cut
    ),
    known AS (SELECT f, {crc('f')} % 10000 AS bucket FROM (SELECT DISTINCT f FROM feature), byte_step),
    hit AS (SELECT side, n, bucket FROM feature JOIN known USING (f)),
    counted AS (
        SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM hit GROUP BY bucket
    ),
    gain AS (
        SELECT bucket, floor(1000 * ln(
            ((t + 1)::DOUBLE * (sum(s) OVER () + 10000)) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)))) AS g
        FROM counted
    ),
    mean AS (
        SELECT n, count(*) AS n_features, floor(sum(g) / count(*))::BIGINT AS weight
        FROM hit JOIN gain USING (bucket) WHERE side = 'd' GROUP BY n
    ),
    scored AS (
        SELECT doc_id, n, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + floor(-1000 * ln(-ln(
                (('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
                / 4294967296.0::DOUBLE)))::BIGINT AS score
        FROM cut LEFT JOIN mean USING (n) WHERE side = 'd'
    ),
    placed AS (
        SELECT n, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 25 * count(*) OVER () // 100 AS drawn
        FROM scored WHERE n_words >= 20
    )
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank
    FROM scored LEFT JOIN placed USING (n)
"""
