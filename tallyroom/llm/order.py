"""Training-order materialisation: token sequences in a keyed order, in fixed-stride shards."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyroom.llm import tokens
from tallyroom.llm.tables import bounded_batches, stored, whole_text
from tallyroom.session import scratch_path

#: Tokens of a sequence and sequences of a shard: a shard has 1 MB, a slot 4 KB.
LENGTH, SHARD_SLOTS = 2048, 256
#: Ends a document; fills the last sequence of a partition.
END, FILL = 50256, 65535
ROUNDS = 6
#: Documents, characters of each and bytes of the compression dictionary of the sequences.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY = 1024, 20_000, 65_536
_U = np.uint64


def _round(half: np.ndarray, key: np.ndarray, mask: np.uint64) -> np.ndarray:
    h = (half + key) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(29))) * _U(0x94D049BB133111EB)
    return (h ^ (h >> _U(32))) & mask


def permuted(index: np.ndarray, count: int, key: int) -> np.ndarray:
    """A keyed one-to-one map of 0 .. count - 1: a Feistel network over the next even
    number of bits, walked on until it is back below ``count``, at most four steps in the
    mean."""
    bits = max(2, (max(1, count - 1)).bit_length())
    half = _U(-(-bits // 2))
    mask = _U((1 << int(half)) - 1)
    keys = np.random.default_rng([key, 3]).integers(0, 2**64 - 1, ROUNDS, dtype=_U)
    out = np.asarray(index).astype(_U)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> half, out[todo] & mask
            for k in keys:
                left, right = right, left ^ _round(right, k, mask)
            out[todo] = (left << half) | right
            todo = todo[out[todo] >= _U(count)]
    return out.astype(np.int64)


def _compressor(dictionary: bytes):
    import zstandard

    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=6, dict_data=known), zstandard.ZstdDecompressor(dict_data=known)


def _sequences(vocabulary, dictionary, length: int):
    """Texts to sequences, packed end to end within a task's rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoding(vocabulary.value)
        pack, _ = _compressor(dictionary)
        part, number = TaskContext.get().partitionId(), 0
        open_ids, open_size, ids, starts = [], 0, [], []
        rows: list[tuple] = []

        def close(fill: bool):
            nonlocal open_ids, open_size, ids, starts, number
            flat = np.concatenate(open_ids).astype("<u2")
            if fill:
                flat = np.concatenate([flat, np.full(length - len(flat), FILL, "<u2")])
            rows.append((part, number, pack.compress(flat.tobytes()), ids, starts))
            number, open_ids, open_size, ids, starts = number + 1, [], 0, [], []

        def flush():
            cols = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()),
                    pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.list_(pa.int32())),
                ],
                names=["part", "number", "packed", "doc_ids", "starts"],
            )

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                coded = np.append(tokens.encode(encoder, text.as_py()), np.uint16(END))
                while len(coded):
                    take = coded[: length - open_size]
                    ids.append(doc_id)
                    starts.append(open_size)
                    open_ids.append(take)
                    open_size += len(take)
                    coded = coded[len(take) :]
                    if open_size == length:
                        close(False)
                        if len(rows) >= 2000:
                            yield flush()
        if open_size:
            close(True)
        if rows:
            yield flush()

    return run


def _write_shards(folder: str, dictionary: bytes, length: int, shard_slots: int):
    """Rows in slot order to one file a shard, each written aside and then moved to its
    place: a task that runs again writes the same bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        _, unpack = _compressor(dictionary)
        store, root = fs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        shard, out, expected, done = None, None, 0, []

        def finish():
            out.close()
            store.move(f"{root}/.{shard}-{attempt}", f"{root}/{shard_name(shard)}")
            done.append((shard, expected - shard * shard_slots))

        for batch in batches:
            for slot, packed in zip(batch["slot"].to_pylist(), batch["packed"]):
                if slot // shard_slots != shard:
                    if out:
                        finish()
                    shard = slot // shard_slots
                    out, expected = store.open_output_stream(f"{root}/.{shard}-{attempt}"), shard * shard_slots
                if slot != expected:
                    raise ValueError(f"slot {slot} where {expected} belongs")
                out.write(unpack.decompress(packed.as_py(), max_output_size=2 * length))
                expected += 1
        if out:
            finish()
        cols = list(zip(*done)) or [(), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())], names=["shard", "slots"]
        )

    return run


def shard_name(shard: int) -> str:
    return f"shard-{shard:010d}.u16"


def _folder(spark: SparkSession, path: str) -> str:
    """``path`` as a URI, made if need be."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(hadoop)
    uri = files.makeQualified(hadoop).toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def write_training_order(
    docs: DataFrame,
    folder: str,
    key: int = 0,
    length: int = LENGTH,
    shard_slots: int = SHARD_SLOTS,
    vocabulary: str = tokens.VOCABULARY,
) -> DataFrame:
    """Writes ``docs`` (doc_id, text) as token sequences in training order to ``folder`` and
    returns the index: slot, shard, doc_ids and starts (the documents of the sequence and
    the place where each begins or goes on).

    Whole texts are encoded, each followed by END, and packed end to end into sequences of
    ``length`` little-endian 16-bit ids within each input partition; FILL completes the
    last. Sequences are numbered through by partition and place; a keyed Feistel
    permutation of those numbers gives every sequence its slot. Slot s lies in shard
    s // shard_slots, at byte 2 * length * (s % shard_slots): readers seek to any slot and
    resume there. Tasks get ranges of whole shards and write them in order.

    The order depends on the rows, their partitions and the key. A null or empty text is
    END alone; a null doc_id is listed as null; repeated rows are written again; no
    documents write no shards.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    words = tokens.load(vocabulary)
    text = whole_text(F.col("text"))
    sample = docs.select(F.substring(text, 1, SAMPLE_CHARS).alias("text")).limit(SAMPLE_DOCS).toArrow()
    dictionary = _trained_dictionary(words, sample["text"].to_pylist(), length)
    run = _sequences(spark.sparkContext.broadcast(words), dictionary, length)
    schema = "part long, number long, packed binary, doc_ids array<long>, starts array<int>"
    packed = stored(docs.select("doc_id", text.alias("text")).mapInArrow(run, schema), "sequences")

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = packed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    parts = stored(parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "parts")
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    @F.arrow_udf("long")
    def slot_of(index: pa.Array) -> pa.Array:
        return pa.array(permuted(index.to_numpy(), total, key))

    numbered = packed.join(parts.select("part", "base"), "part").withColumn("slot", slot_of(F.col("base") + F.col("number")))
    shard = F.floor(F.col("slot") / shard_slots)
    numbered = numbered.withColumn("shard", shard)
    ranged = numbered.select("shard", "slot", "packed").repartitionByRange("shard").sortWithinPartitions("slot")
    writer = _write_shards(_folder(spark, folder), dictionary, length, shard_slots)
    written = stored(ranged.mapInArrow(writer, "shard long, slots long"), "shards")
    slots = written.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    if slots != total:
        raise RuntimeError(f"{slots} of {total} slots were written")
    return numbered.select("slot", "shard", "doc_ids", "starts")


def _trained_dictionary(vocabulary: bytes, texts: list[str], length: int) -> bytes:
    """A compression dictionary for sequences on their way to the shards; empty where the
    sample is too small for one."""
    import zstandard

    encoder = tokens.encoding(vocabulary)
    flat = b"".join(tokens.encode(encoder, t).astype("<u2").tobytes() for t in texts)
    rows = [flat[i : i + 2 * length] for i in range(0, len(flat), 2 * length)]
    if len(rows) < 64:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY, rows).as_bytes()
    except zstandard.ZstdError:
        return b""


def read_slots(
    spark: SparkSession, folder: str, length: int = LENGTH, shard_slots: int = SHARD_SLOTS, first: int = 0
) -> DataFrame:
    """slot and ids (16-bit, little endian) of all slots from ``first`` on; shards before it
    are not opened, nor bytes of its shard before it used."""
    stride = 2 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch["shard"].to_pylist(), batch["content"]):
                data = memoryview(content.as_buffer())
                rows = [(shard * shard_slots + i, bytes(data[i * stride : (i + 1) * stride]))
                        for i in range(max(0, first - shard * shard_slots), len(data) // stride)]
                cols = list(zip(*rows)) or [(), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary())], names=["slot", "ids"]
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.u16").load(folder)
    number = F.regexp_extract("path", r"shard-(\d+)\.u16", 1).cast("long")
    files = files.withColumn("shard", number).where(F.col("shard") >= first // shard_slots)
    return files.select("shard", "content").mapInArrow(run, "slot long, ids binary")


def training_order(docs: DataFrame, key: int = 0, **how) -> DataFrame:
    """Writes ``docs`` below the shared folder and reads the shards back: slot, shard,
    byte_offset, n_tokens (without FILL), checksum (crc32 of the slot's bytes) and doc_ids."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "training-order")
    index = write_training_order(docs, folder, key, **how)
    shape = {k: v for k, v in how.items() if k in ("length", "shard_slots")}
    stride = 2 * shape.get("length", LENGTH)
    slots = shape.get("shard_slots", SHARD_SLOTS)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x.as_buffer() for x in batch["ids"]]
            used = [int((np.frombuffer(x, "<u2") != FILL).sum()) for x in rows]
            yield pa.RecordBatch.from_arrays(
                [batch["slot"], pa.array(used, pa.int64()), pa.array([zlib.crc32(x) for x in rows], pa.int64())],
                names=["slot", "n_tokens", "checksum"],
            )

    if index.isEmpty():
        return index.selectExpr(
            "slot", "shard", "slot AS byte_offset", "slot AS n_tokens", "slot AS checksum", "doc_ids"
        )
    read = read_slots(spark, folder, **shape).mapInArrow(digest, "slot long, n_tokens long, checksum long")
    return index.select("slot", "shard", "doc_ids").join(read, "slot").select(
        "slot", "shard", ((F.col("slot") % slots) * stride).alias("byte_offset"), "n_tokens", "checksum", "doc_ids"
    )
