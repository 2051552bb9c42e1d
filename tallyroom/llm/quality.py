"""Text quality by similarity-weighted votes of labelled latent-semantic neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tallyroom.llm.ranks import free_names
from tallyroom.llm.tables import bounded_batches, held_out, map_rows, whole_text
from tallyroom.llm.words import Texts, groups

#: Hashed terms (byte triples), latent dimensions, labelled rows fitted on at most, and
#: neighbours that vote.
TERMS, LATENT, LABELLED, NEIGHBOURS = 8192, 96, 4096, 15
#: Similarities weigh by this power, so that close neighbours outvote far ones.
SHARPNESS = 4
#: Rows learned from leave another remainder of crc32(doc_id) modulo 3.
FOLDS, HELD_OUT = 3, 1
_BYTES = 1 << 20


def term_counts(texts: Texts) -> np.ndarray:
    """(texts, TERMS) counts of the byte triples of each text, hashed."""
    n = len(texts.offsets) - 1
    out = np.zeros((n, TERMS), dtype=np.float32)
    for i in range(n):
        data = texts.data[texts.offsets[i] : texts.offsets[i + 1]]
        for s in range(0, max(0, len(data) - 2), _BYTES):
            b = data[s : s + _BYTES + 2].astype(np.uint32)
            term = (b[:-2] * np.uint32(0x01000193) ^ b[1:-1] * np.uint32(0x85EBCA6B)) + b[2:] * np.uint32(0xC2B2AE35)
            out[i] += np.bincount((term * np.uint32(0x9E3779B1)) >> np.uint32(19), minlength=TERMS)
    return out


class Model(NamedTuple):
    """Term weights, the projection to latent space, labelled unit rows and their labels."""

    idf: np.ndarray
    project: np.ndarray
    rows: np.ndarray
    labels: np.ndarray

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return unit(weighted(counts, self.idf) @ self.project)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """The weighted share of label 1 among the nearest; the share among all labelled
        rows where nothing is similar, and one half without labels."""
        if not len(self.rows):
            return np.full(len(counts), 0.5)
        near = self.latent(counts) @ self.rows.T
        k = min(NEIGHBOURS, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, best, 1), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(1)
        votes = (weight * self.labels[best]).sum(1)
        return np.where(total > 1e-12, votes / np.maximum(total, 1e-12), self.labels.mean())


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit(np.log1p(counts) * idf)


def latent_axes(rows: np.ndarray, dims: int, seed: int = 9) -> np.ndarray:
    """Leading right singular vectors, by subspace iteration."""
    rng = np.random.default_rng(seed)
    basis = rng.standard_normal((rows.shape[1], min(dims + 16, *rows.shape))).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    left, _, _ = np.linalg.svd(basis.T @ (rows.T @ (rows @ basis)))
    return (basis @ left[:, :dims]).astype(np.float32)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, in how many texts each term occurs; the last row has the texts."""
    seen, rows = np.zeros(TERMS + 1, dtype=np.int64), 0
    for batch in batches:
        for texts in groups(batch["text"], _BYTES):
            seen[:-1] += (term_counts(texts) > 0).sum(0)
        seen[-1] += len(batch)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(seen)], names=["term", "n"])


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places, packed = [], []
        for texts in groups(batch["text"], _BYTES):
            for row in term_counts(texts):
                places.append(np.flatnonzero(row).astype("<u2").tobytes())
                packed.append(row[row > 0].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["quality"], pa.array(places, pa.binary()), pa.array(packed, pa.binary())],
            names=["doc_id", "quality", "places", "counts"],
        )


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model:
    """Term statistics from all of ``docs``; neighbours from the ``labelled`` rows of least
    id hash whose label is 0 or 1 and which are not held out."""
    found = docs.select(whole_text(F.col("text")).alias("text")).mapInArrow(_frequencies, "term long, n long")
    found = found.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(TERMS + 1)
    seen[found["term"].to_numpy()] = found["n"].to_numpy()
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])).astype(np.float32) + np.float32(0.1)
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"), FOLDS, HELD_OUT))
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL")
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", whole_text(F.col("text")).alias("text")).join(F.broadcast(known), "doc_id")
    # Of rows of one id, however many, one speaks: that of least text hash.
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = rows.mapInArrow(_labelled, f"doc_id {kind}, quality int, places binary, counts binary").toArrow()
    rows = rows.sort_by([("doc_id", "ascending")]).slice(0, labelled)
    tfidf = np.zeros((len(rows), TERMS), dtype=np.float32)
    for i, (at, n) in enumerate(zip(rows["places"], rows["counts"])):
        tfidf[i, np.frombuffer(at.as_buffer(), "<u2")] = np.frombuffer(n.as_buffer(), "<f4")
    for s in range(0, len(rows), 256):
        tfidf[s : s + 256] = weighted(tfidf[s : s + 256], idf)
    axes = latent_axes(tfidf, LATENT) if len(rows) else np.zeros((TERMS, 1), np.float32)
    return Model(idf, axes, unit(tfidf @ axes), rows["quality"].to_numpy().astype(np.float64))


def scored(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """The rows of ``docs`` with ``held_out``, ``score`` and ``predicted``, all columns kept
    (columns of these names are replaced).

    Every text becomes a latent-semantic vector of its byte triples: logarithmic counts
    weighed by how rare a term is over all of ``docs``. Exact cosines to all labelled
    vectors are computed block by block; the NEIGHBOURS nearest vote for their label,
    weighed by similarity. What is sent to the tasks has a fixed bound: ``labelled``
    rows of LATENT numbers and the projection.

    A null or empty text is similar to nothing and gets the share of label 1 among the
    labelled rows; without labels all get one half and are predicted 1. Labels other than
    0 and 1 teach nothing, repeated ones count once with the greater; of rows that share a
    labelled id one teaches. A null doc_id is
    not held out.
    """
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, labelled))
    names = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    read = free_names(docs, "read")["read"]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], whole_text(F.col("text")).alias(read))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [model.value.score(term_counts(t)) for t in groups(batch[read], _BYTES)]
            at = batch.schema.get_field_index(read)
            column = pa.array(np.concatenate(score) if score else np.empty(0), pa.float64())
            yield batch.set_column(at, "score", column)

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType())])
    out = map_rows(rows, run, schema)
    return out.select(
        *[F.col(f"`{c}`") for c in names],
        held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
